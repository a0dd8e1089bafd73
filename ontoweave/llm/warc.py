"""A deterministic sharded WARC writer, and a reader of its archives."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import lean
from .common import fresh_path, open_fs, written

#: A file is closed once it has this many compressed bytes.
FILE_BYTES = 64 << 20
#: Payloads that are shorter are never revisited.
LEAST_BYTES = 100
#: Repeated digests that are broadcast at most (some 100 MB with a URL each).
BROADCAST_DIGESTS = 500_000
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


# ---- records --------------------------------------------------------------------------------------------------------
def sha256_label(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode().rstrip("=")


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{copy}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as a gzip member of its own, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _safe(url: str | None) -> str:
    """A URL for a header: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def page_record(page_id: int | None, url: str | None, html: bytes | None, first: int | None, first_url: str | None = None, copy: int = 0) -> bytes:
    """The record of a page, a revisit if first (the id of the response with the same payload) is given; digests and
    lengths are made anew from the payload. copy numbers the records of one id and payload, whose record ids differ by it."""
    payload = html or b""
    sha = hashlib.sha256(payload)
    http = HTTP.format(len(payload)).encode()
    block = http + payload if first is None else http
    headers = {
        "WARC-Record-ID": record_id(page_id, sha.hexdigest(), copy),
        "WARC-Date": DATE,
        "WARC-Target-URI": _safe(url) or "urn:page:unknown",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": sha256_label(sha.digest()),
        "WARC-Block-Digest": sha256_label(hashlib.sha256(block).digest()),
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if first is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, sha.hexdigest()), "WARC-Refers-To-Target-URI": _safe(first_url) or "urn:page:unknown", "WARC-Refers-To-Date": DATE, "X-Refers-To-Page": str(first)}
    return record("revisit" if first is not None else "response", headers, block)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset of its member) of each record of a file of gzip members, one member in memory at a time."""
    left, at = b"", 0
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not left and not (left := stream.read(1 << 20)):
                raise ValueError(f"truncated record at {at}")
            parts.append(z.decompress(left))
            used += len(left) - len(z.unused_data)
            left = z.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong at {at}")
        yield headers, rest[:size], at
        at += used


# ---- writing and reading --------------------------------------------------------------------------------------------
def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES, least_bytes: int = LEAST_BYTES, level: int = 6) -> DataFrame:
    """Writes a record per page under path (in the shared folder) in the order of id_col, and a manifest row per file
    (part, seq, file, records, bytes, sha256) as Parquet under path/manifest, which is returned.

    Of equal payloads of least_bytes and more that with the smallest id is the response and the others revisit it; which
    those are comes from a partial aggregate over digests. The digests that repeat are broadcast to the pages if they are few
    enough, else they meet in a join that adaptive execution can split; payloads are then shuffled once. Rows are range-sorted by id and files roll by compressed size. A file gets its name by a
    rename once it is whole; names and bytes depend on the rows alone, so a task that runs again, or twice at once, does no
    harm, and only files of the manifest count.

    A null html is an empty payload, a null URL a placeholder. Rows that repeat the smallest id of a payload are all
    responses, with record ids of their own; null ids come first and are responses, or revisits if another id has the payload. An empty table gives an
    empty manifest; further columns are ignored."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    firsts = (
        rows.where(F.length("html") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("r"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first", F.col("r.url").alias("first_url"))
    )
    firsts = written(firsts, "warc-firsts")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_DIGESTS else firsts, "digest", "left").select("id", "url", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"), "first_url")
    ordered = joined.repartitionByRange(n, "id", "digest").sortWithinPartitions("id", "digest", "url").select("id", "url", "html", "first", "first_url")
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        fs, base = open_fs(path)
        out, before, copy = None, None, 0

        def start() -> dict:
            temp = f"{base}/.{part:06d}-{seq:06d}.{uuid.uuid4().hex}"
            info = member(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'info/{part}/{seq}')}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, f"software: ontoweave\r\nformat: WARC File Format 1.1\r\npart: {part}-{seq}\r\n".encode()), level)
            got = {"temp": temp, "f": fs.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
            put(got, info)
            return got

        def put(o: dict, data: bytes) -> None:
            o["f"].write(data)
            o["sha"].update(data)
            o["bytes"] += len(data)

        def close(o: dict) -> pa.RecordBatch:
            o["f"].close()
            name = f"{part:06d}-{seq:06d}.warc.gz"
            fs.move(o["temp"], f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "records": o["records"], "bytes": o["bytes"], "sha256": o["sha"].hexdigest()}], schema=schema)

        for b in batches:
            for row in zip(*b.columns, strict=True):
                out = out or start()
                row = [x.as_py() for x in row]
                copy, before = (copy + 1 if before == (row[0], row[2]) else 0), (row[0], row[2])  # equal ones are neighbours
                put(out, member(page_record(*row, copy), level))
                out["records"] += 1
                if out["bytes"] >= file_bytes:
                    yield close(out)
                    out, seq = None, seq + 1
        if out:
            yield close(out)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    ordered.mapInArrow(lean(run), "part int, seq int, file string, records long, bytes long, sha256 string").write.parquet(f"{path}/manifest")
    done = spark.read.parquet(f"{path}/manifest")
    with fs.open_output_stream(f"{base}/_MANIFEST.json") as f:
        f.write(json.dumps({"files": "manifest/*.parquet", "format": "WARC/1.1", "members": "gzip per record"}).encode())
    return done


def read_warc(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """A row per page record of the archives that the manifest under path names: id, url, payload_bytes, payload_digest
    (hex SHA-256), record_type, refers_to (the response's id), file and offset. A response's payload and every block are
    held against their digests."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.parquet(f"{path}/manifest").select("file").repartition(n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for h, block, at in read_records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        label = h["WARC-Payload-Digest"]
                        if sha256_label(hashlib.sha256(block).digest()) != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: damaged block at {at}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if h["WARC-Type"] == "response" and (sha256_label(hashlib.sha256(payload).digest()) != label or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{name}: damaged payload at {at}")
                        digest = base64.b32decode(label.removeprefix("sha256:") + "====").hex()
                        number = lambda k, h=h: int(h[k]) if h.get(k) else None
                        rows.append({id_col: number("X-Page-Id"), "url": h["WARC-Target-URI"], "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "file": name, "offset": at})
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(id_col, pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
    return files.mapInArrow(lean(run), f"`{id_col}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """write_warc, then read_warc of the same archives; path: a new one in the shared folder unless given."""
    path = path or fresh_path(pages.sparkSession, "warc", keep=True)
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, options.get("id_col", "page_id"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to
FROM r"""
