"""What the operators share: the shared folder, written tables, file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path, open_fs, scratch_dir, shared_dir, written

__all__ = ["BROADCAST_IDS", "dropped", "fresh_path", "only", "open_fs", "shared_dir", "small", "table", "written"]

#: Ids, or rows of a few numbers, that are broadcast at most (some 30 MB).
BROADCAST_IDS = 1_000_000


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables made by written() that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    scratch = scratch_dir(spark).split("//", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        if scratch in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def only(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """df joined (left_semi, left_anti) to ids, a written table, which is broadcast if it is small enough; beyond that
    adaptive execution may split the join."""
    return df.join(small(ids), on, how)


def small(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it is BROADCAST_IDS rows at most."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
