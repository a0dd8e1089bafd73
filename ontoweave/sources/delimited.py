"""Tables as tab-separated values, JSON and Parquet, and options."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that stand for a missing value; NULL, null and n/a are labels of their own.
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NaN", "nan")


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """A TSV with a header; without a schema all columns are texts. The texts of missing are null."""
    reader = spark.read.option("sep", "\t").option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(list(missing)), F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in rows.dtypes])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables that write_tables() left; a missing one is an error that names it."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            raise FileNotFoundError(f"{path}/{name}: {e}") from e
    return out


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, values) of a JSON object of lists in one document."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "values"))


def write_json_map(rows: DataFrame, path: str) -> None:
    """(key, values: array of texts) as JSON objects of lists, one a part file; keys are distinct."""
    one = rows.groupBy(F.spark_partition_id().alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("m"))
    one.select(F.to_json("m").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """(word, vec: array of numbers) as lines of a word and its numbers, with blanks between; a word's own blanks become _."""
    word = F.regexp_replace(F.col("word").cast("string"), r"\s", "_")
    rows.select(F.concat_ws(" ", word, F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec: array of doubles) of the lines of a vector file; a first line of two whole numbers, which tells the size, and
    blank lines are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(cells.alias("c")).where((F.size("c") > 2) | ~F.col("c")[0].rlike(r"^\d+$") | ~F.get("c", F.lit(1)).rlike(r"^\d+$"))
    return rows.select(F.col("c")[0].alias("word"), F.transform(F.slice("c", 2, F.size("c")), lambda x: x.cast("double")).alias("vec"))


def write_matrix(cells: DataFrame, path: str) -> None:
    """(i, j, score) as lines of a row's number and its scores by column, comma-separated; missing cells are 0."""
    rows = cells.groupBy("i").agg(F.max("j").alias("n"), F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.col("n").cast("int")), lambda k: F.coalesce(F.try_element_at("m", k.cast(dict(cells.dtypes)["j"])), F.lit(0.0)).cast("string"))
    rows.select(F.concat_ws(",", F.col("i").cast("string"), F.array_join(each, ",")).alias("value")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, score) of the cells that aren't 0 of a similarity matrix: lines of a row's number and its scores."""
    at = F.split("value", ",")
    rows = spark.read.text(path).where("value <> ''").select(at[0].cast("long").alias("i"), F.posexplode(F.slice(at, 2, F.size(at))).alias("j", "s"))
    return rows.select("i", F.col("j").cast("long").alias("j"), F.col("s").cast("double").alias("score")).where("score <> 0")


@dataclass
class Options:
    """What runs can set: thresholds, numbers of candidates and switches."""

    threshold: float = 0.9
    candidates: int = 200
    n_best: int = 1
    seed: int = 0
    pooling: str = "mean"
    similarity: str = "levenshtein"
    legacy: bool = False

    @classmethod
    def read(cls, text: str, **over) -> Options:
        """Options of a JSON object or of key=value lines; named ones win, and unknown keys are left out."""
        text = text.strip()
        found = json.loads(text) if text.startswith("{") else dict(x.split("=", 1) for x in map(str.strip, text.splitlines()) if "=" in x and not x.startswith("#"))
        kinds = {f.name: type(f.default) for f in fields(cls)}
        made = lambda k, v: str(v).strip().lower() == "true" if kinds[k] is bool else kinds[k](str(v).strip())
        return cls(**{k.strip(): made(k.strip(), v) for k, v in (found | over).items() if k.strip() in kinds})
