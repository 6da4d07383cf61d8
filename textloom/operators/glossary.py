"""Dictionaries: override, conflicts, plural forms, and joined terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import acronym_plural, plurals


def override(entries: DataFrame) -> DataFrame:
    """One row for each source, lower-cased: the last file's last row.  entries: source, target, prio, ord."""
    key = F.lower("source")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("prio"), F.desc("ord")))
    return entries.withColumns({"key": key, "_rn": rank}).filter("_rn = 1").drop("_rn")


def conflicts(entries: DataFrame) -> DataFrame:
    """Rows whose target differs from the row before of the same source."""
    before = F.lag("target").over(Window.partitionBy(F.lower("source")).orderBy("prio", "ord"))
    return entries.withColumn("previous", before).filter("previous is not null and previous <> target")


def with_plurals(entries: DataFrame, keep: str = "keep") -> DataFrame:
    """The plural forms that are not entries themselves; terms that are kept as they are have none but for acronyms."""
    forms = F.when(F.col(keep), F.array().cast("array<string>")).otherwise(plurals(F.col("source")))
    acronym = acronym_plural(F.col("source"))
    every = F.array_distinct(F.concat(forms, F.when(acronym.isNotNull(), F.array(acronym)).otherwise(F.array().cast("array<string>"))))
    made = entries.select("source", "target", F.explode(every).alias("form"))
    return made.join(entries.select(F.col("source").alias("form")), "form", "left_anti")


def coordinations(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Phrases "a and b head" of which both "a head" and "b head" are terms, with their counts."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])([a-z]+ (?:and|or) [a-z]+ [a-z]+)(?![a-z])"), 1)).alias("phrase"))
    counts = found.groupBy("phrase").agg(F.count("*").alias("n"))
    parts = F.split("phrase", " ")
    split = counts.select("phrase", "n", F.concat_ws(" ", parts[0], parts[3]).alias("first"), F.concat_ws(" ", parts[2], parts[3]).alias("second"))
    known = terms.select("term").distinct()
    return split.join(known.withColumnRenamed("term", "first"), "first").join(known.withColumnRenamed("term", "second"), "second").select("phrase", "n")
