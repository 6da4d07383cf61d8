"""Jobs, their states, files and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_state(*rules: tuple[Column, str], otherwise: str = "not started") -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in rules], F.lit(otherwise))


def stage_by_files(files: DataFrame, job: str, name: str, artefacts: list[tuple[str, str]]) -> DataFrame:
    """The stage of the latest artefact that a job has; artefacts are (file, stage) from first to last."""
    seen = files.groupBy(job).agg(F.collect_set(name).alias("names"))
    return seen.select(job, F.coalesce(*[F.when(F.array_contains("names", file), F.lit(stage)) for file, stage in reversed(artefacts)], F.lit("started")).alias("stage"))


def coverage(pairs: DataFrame, book: str, source: str, target: str) -> DataFrame:
    """Chapters done and in all: done if the source has 50 Latin letters and over 30 per cent of the target's are Cyrillic."""
    latin = lambda c: F.regexp_count(c, F.lit("[A-Za-z]"))
    cyrillic = F.regexp_count(target, F.lit("[А-Яа-яЁё]"))
    real = latin(source) >= 50
    return pairs.filter(real).groupBy(book).agg(F.count_if(cyrillic * 10 > 3 * (cyrillic + latin(target))).alias("done"), F.count("*").alias("total"))


def pick_summary(rows: DataFrame, why: str, size: str, kinds: list[str]) -> DataFrame:
    """Number, size and share of picked rows, and how many were picked for each reason."""
    picked = F.col(why).isNotNull()
    return rows.agg(
        F.count("*").alias("paragraphs"), F.sum(size).alias("total_chars"), F.count_if(picked).alias("n"), F.coalesce(F.sum(F.when(picked, F.col(size))), F.lit(0)).cast("long").alias("chars"),
        F.round(100.0 * F.coalesce(F.sum(F.when(picked, F.col(size))), F.lit(0)) / F.nullif(F.sum(size), F.lit(0)), 4).alias("pct"), *[F.count_if(F.col(why) == k).alias(f"why_{k}") for k in kinds]
    )


def adapter_summary(journal: DataFrame) -> DataFrame:
    """Paragraphs, retries, mismatched marks and replies that were no JSON."""
    return journal.agg(F.count("*").alias("paragraphs"), F.sum("retries").alias("retries"), F.count_if(~F.col("marks_ok")).alias("marks_bad"), F.count_if(~F.col("json")).alias("no_json"))


def best_version(scores: DataFrame, page: str, round_: str, score: str) -> DataFrame:
    """Of each page's versions the one with the least score, the earliest of equals."""
    return scores.groupBy(page).agg(F.min_by(F.struct(round_, score), F.struct(score, round_)).alias("b")).select(page, F.col(f"b.{round_}"), F.col(f"b.{score}"))


def page_ranges(pages: DataFrame, book: str, page: str, most: int) -> DataFrame:
    """Runs of consecutive pages, cut to at most ``most`` pages each: book, first, last."""
    by = Window.partitionBy(book).orderBy(page)
    marked = pages.select(book, page).distinct().withColumn("_island", F.col(page) - F.row_number().over(by))
    within = Window.partitionBy(book, "_island").orderBy(page)
    cut = marked.withColumn("_part", F.floor((F.row_number().over(within) - 1) / most))
    return cut.groupBy(book, "_island", "_part").agg(F.min(page).alias("first"), F.max(page).alias("last")).select(book, "first", "last")


def tail(lines: DataFrame, run: str, order: str, n: int) -> DataFrame:
    """The last n lines of each run."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))
    return lines.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def caught_by_kind(rows: DataFrame, kind: str, caught: Column) -> DataFrame:
    return rows.groupBy(kind).agg(F.count_if(caught).alias("caught"), F.count("*").alias("total"))


def better_version(rows: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    """How often the second of two versions scores higher, by kind; null scores choose the first."""
    return rows.groupBy(kind).agg(F.count_if(F.col(b) > F.col(a)).alias("second"), F.count_if(~F.coalesce(F.col(b) > F.col(a), F.lit(False))).alias("first"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    """n rows in an order that a hash of seed and key gives, the same in any engine, without those used."""
    left = rows.join(used.select(key), key, "left_anti") if used is not None else rows
    return left.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def listed_models(models: DataFrame, preferred: list[str], hidden: list[str]) -> DataFrame:
    """name and place of models (name): the preferred ones first, in order, then by name; without those of hidden prefixes."""
    shown = models.filter(~F.coalesce(*[F.when(F.col("name").startswith(p), F.lit(True)) for p in hidden], F.lit(False)))
    rank = F.coalesce(*[F.when(F.col("name") == n, F.lit(k)) for k, n in enumerate(preferred)], F.lit(len(preferred)))
    # A list of models is short: one task orders it.
    return shown.select("name", F.row_number().over(Window.orderBy(rank, "name")).cast("long").alias("place"))


def listed_outputs(files: DataFrame) -> DataFrame:
    """Files (folder, name, size) that a user is shown: neither hidden nor working files, with their place among the folder's."""
    shown = files.filter(~F.col("name").startswith(".") & ~F.col("name").startswith("work"))
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("name")).cast("long"))


def text_sources(books: DataFrame, derived: DataFrame, sampled: DataFrame) -> DataFrame:
    """books (book) with text and whole: the derived text if there is one, else the sampled original (both: book, text)."""
    one, other = derived.select("book", F.col("text").alias("_derived")), sampled.select("book", F.col("text").alias("_sampled"))
    joined = books.join(one, "book", "left").join(other, "book", "left")
    return joined.withColumns({"text": F.coalesce("_derived", "_sampled"), "whole": F.col("_derived").isNotNull()}).drop("_derived", "_sampled")


def resumable(jobs: DataFrame, interrupted: DataFrame) -> DataFrame:
    """jobs (book, model, fresh) with conflict: the book's interrupted run had another model and the job isn't to begin anew.

    interrupted: book, model; a model that was not recorded (null) is no conflict.
    """
    before = interrupted.select("book", F.col("model").alias("interrupted"))
    conflict = ~F.col("fresh") & F.coalesce(F.col("interrupted") != F.col("model"), F.lit(False))
    return jobs.join(before, "book", "left").withColumn("conflict", conflict)
