"""The queries of these operators: each applies its operator to the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, mixing, warc
from .common import table


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, mix

    mixed = mix(table(spark, sf_dir, "documents"))
    values = [F.when(F.col(f"_k{i}").startswith("="), F.substring(f"_k{i}", 2, 1 << 30)).alias(d) for i, d in enumerate(TARGETS)]
    return mixed.select("doc_id", *values, F.col("_n").alias("n_tokens"), F.round("probability", 6).alias("probability"), "selected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, secrets

    return secrets(table(spark, sf_dir, "documents")).select("doc_id", *digest())


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import passages

    return passages(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_output, op2_warc, op3_toxicity, op4_mixing, op5_decontamination, op6_secret_scan, op7_nearest_neighbours, op8_html_extraction, op9_substring_dedup, op10_simhash_near_dedup)}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.SQL, "op4_mixing": mixing.SQL, "op5_decontamination": decontamination.SQL}
