"""Brings the package to the executors, for sessions that weren't started with it among their Python files."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application's Python files, once an application. The zip lies in
    spark.checkpoint.dir, or in a temporary folder of the driver, which serves it, where that is unset."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    from pyarrow import fs as pafs

    here, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{here.name}/{f.relative_to(here)}"), f.read_bytes())
    base = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{Path(tempfile.mkdtemp(prefix='ontoweave-')).resolve()}").rstrip("/")
    uri = f"{base}/{here.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(data.getvalue())
    fs.move(temp, path)
    sc.addPyFile(uri)
    _DONE.add(sc.applicationId)
