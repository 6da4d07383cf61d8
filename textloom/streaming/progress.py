"""Logs and events as streams; every function takes a stream or a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of log files as they are added to a folder; the checkpoint remembers which were read."""
    return spark.readStream.text(folder)


def stages(lines: DataFrame, patterns: list[tuple[str, str]], run: str = "run", order: str = "line_no") -> DataFrame:
    """The present stage of each run: the last pattern of the last line in square brackets that matches any."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in patterns]))
    found = lines.filter(F.col("line").startswith("[")).withColumn("stage", F.try_element_at(hits, F.lit(-1))).filter("stage is not null")
    return found.groupBy(run).agg(F.max_by("stage", order).alias("stage"))


def counters(lines: DataFrame, run: str = "run", order: str = "line_no") -> DataFrame:
    """The latest ``done/total [`` of each run."""
    done, total = (F.try_to_number(F.regexp_extract("line", r"(\d+)/(\d+) \[", k), F.lit("999999999")).cast("long") for k in (1, 2))
    found = lines.select(run, order, done.alias("done"), total.alias("total")).filter("total is not null")
    return found.groupBy(run).agg(F.max_by("done", order).alias("done"), F.max_by("total", order).alias("total"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Runs of activity: a gap ends one.  With ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.col(user), F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def rates(events: DataFrame, user: str, ts: str, order: str, samples: int = 60) -> DataFrame:
    """Events a second over the last ``samples`` of each run up to each event."""
    by = Window.partitionBy(user).orderBy(ts, order)
    span = by.rowsBetween(-(samples - 1), 0)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return events.select(user, order, (F.count("*").over(span) - 1).alias("steps"), (seconds - F.min(seconds).over(span)).alias("took")).withColumn("rate", F.when(F.col("took") > 0, F.round(F.col("steps") / F.col("took"), 6)))


def tumbling(events: DataFrame, ts: str, width: str, key: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), key, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, key: str, late: str | None = None) -> DataFrame:
    """Events of each key in windows that overlap; with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "n")


def first_events(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """One row for each of ``keys`` among those that arrive within ``late``; of a table, one row for each."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def followed(first: DataFrame, second: DataFrame, key: str, ts: str, within: str, late: str) -> DataFrame:
    """key, ts and followed_at: rows of two streams of which the second comes within a time after the first."""
    a = first.withWatermark(ts, late).select(F.col(key), F.col(ts))
    b = second.withWatermark(ts, late).select(F.col(key).alias("_key"), F.col(ts).alias("followed_at"))
    soon = (F.col(key) == F.col("_key")) & (F.col("followed_at") >= F.col(ts)) & (F.col("followed_at") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, soon).drop("_key")


def scored_in_batches(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, done: Callable[[], DataFrame | None], key: str, folder: str):
    """Starts a stream that scores what ``done`` doesn't have yet, batch by batch, and appends each before the next."""

    def write(batch: DataFrame, number: int) -> None:
        seen = done()
        fresh = batch if seen is None else batch.join(seen.select(key), key, "left_anti")
        score(fresh).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()


def idle(gauges: DataFrame, run: str, ts: str, now: Column, after: str = "120 seconds") -> DataFrame:
    """Runs without a row for so long: what may be unloaded."""
    return gauges.groupBy(run).agg(F.max(ts).alias("last")).filter(F.col("last") + F.expr(f"INTERVAL {after}") <= now)
