"""The folder that driver and executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local master (tests) gets a temporary folder; on a cluster it is an error,
    as no folder of the driver's could be read by executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.get(sc.applicationId) or f"file://{tempfile.mkdtemp(prefix='ontoweave-')}"
        _LOCAL[sc.applicationId] = base
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder for intermediate tables in the shared folder; it is deleted when the driver ends. What a
    driver that was killed leaves is under names that begin with ontoweave- and can be deleted by hand."""
    path = f"{shared_dir(spark)}/ontoweave-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_delete, path)
    return path


def _delete(uri: str) -> None:
    fs, path = open_fs(uri)
    try:
        fs.delete_dir(path)
    except OSError:  # nothing was written, or the folder is gone
        pass


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; keep: it outlives the application."""
    return f"{shared_dir(spark) if keep else scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the scratch folder and read back: it cuts the lineage, is computed once, and survives lost
    executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path in it) for a URI of the shared folder; imported on executors as well."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
