"""Models that a caller gives: scoring and translation as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_batches(predict: Callable[..., list], returns: str, batch: int = 64) -> Callable[..., Column]:
    """A function of columns that calls ``predict`` with lists of at most ``batch`` values of each; nulls are handed on as None."""

    @F.pandas_udf(returns)
    def called(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for given in columns:
            many = given if isinstance(given, tuple) else (given,)
            rows = list(zip(*[[None if v is None or v != v else v for v in c] for c in many], strict=True))
            made = [v for k in range(0, len(rows), batch) for v in predict(*map(list, zip(*rows[k : k + batch], strict=True)))]
            yield pd.Series(made, dtype="float64" if returns == "double" else "object")

    return called


def scored_sides(rows: DataFrame, predict: Callable[[list, list], list], source: str, sides: list[str], batch: int = 64) -> DataFrame:
    """rows with a column score_x for each side x: the score of (source, x), null for rows without that side."""
    score = in_batches(predict, "double", batch)
    return rows.withColumns({f"score_{side}": F.when(F.col(side).isNotNull(), score(F.col(source), F.col(side))) for side in sides})


def score_summary(scores: DataFrame, model: str, score: str, spans: str) -> DataFrame:
    """model, mean of its scores, how many it gave, and how many of them have spans."""
    return scores.groupBy(model).agg(F.avg(score).alias("mean"), F.count(score).alias("n"), F.count_if(F.size(spans) > 0).alias("with_spans"))
