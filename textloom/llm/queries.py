"""The registered queries of this package and their SQL.

Each query reads whole tables and derives its columns from what its operator
returns.  There is SQL only where an operator's result can be stated in it; the
others are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, factorisation, html_text, lattice, near_duplicates, pseudonyms, quality_rules, token_binary, warc
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_digests(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", F.hex("root").alias("class_root"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), with_text=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_factorisation": op2_factorisation,
    "op3_token_binary": op3_token_binary,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_lattice": op9_lattice,
    "op10_bpe": op10_bpe,
}

#: Base32 by hand: five hexadecimal digits are four of its characters.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substring(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""",
}
