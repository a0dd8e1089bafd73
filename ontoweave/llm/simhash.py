"""SimHash near-duplicates by tiled exact comparison of all distinct fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import lean
from .common import dropped, fresh_path, only, open_fs, small, written
from .components import connected_components

SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once, fingerprints of a tile, and of the blocks in which two tiles meet, and tiles that
#: meet one in a row.
CHUNK, TILE, BLOCK, RUN = 1 << 16, 1 << 14, 256, 8


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, word shingles with repeats,
    a bit set if more than half of the shingles' XXH64 (seed 42) have it. Fewer words than a shingle: the whole
    sequence is the only one. None, or no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) of each row; fp holds the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(lean(run), "id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge a node, (node, smallest node of its component), of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x in the order of its quarters' population counts, and the least and largest counts of each block."""
    q = _quarters(x)
    order = np.lexsort(q.T[::-1])
    x, q, at = x[order], q[order], np.arange(0, len(x), BLOCK)
    return x, np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def compare(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the same components as all pairs of left and right (uint64) that differ in radius bits at most.

    Blocks meet by exclusive-or and bit counts unless their population counts, taken over the quarters of a word, differ
    by more than radius: the distance is at least the sum of the quarters' differences. Each block's pairs are reduced to
    a spanning forest, so memory doesn't grow with the square of a group."""
    if not len(left) or not len(right):
        return left[:0], right[:0]
    (a, a_low, a_high), (b, b_low, b_high) = _blocks(left), _blocks(right)
    found, held = [(a[:0], b[:0])], 0
    for i in range(len(a_low)):
        gap = np.maximum(np.maximum(a_low[i] - b_high, b_low - a_high[i]), 0).sum(axis=1)
        x = a[i * BLOCK : (i + 1) * BLOCK]
        for j in np.flatnonzero(gap <= radius):
            y = b[j * BLOCK : (j + 1) * BLOCK]
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if len(r) and (len(r) > 1 or x[r[0]] != y[c[0]]):
                found.append(forest(x[r], y[c]))
                held += len(found[-1][0])
                if held > 1 << 20:
                    found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
                    held = len(found[0][0])
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) that span the components of all pairs within radius bits.

    Fingerprints of one population count are dealt into tiles, each a file in the shared folder; tiles meet if their counts
    differ by radius at most. What is shuffled is the numbers of tiles that meet: a row is a tile and a run of others, which
    its task reads one after another, so memory is two tiles. The pairs of a row are reduced to a spanning forest."""
    spark = fps.sparkSession
    one = fps.withColumn("pc", F.bit_count("fp").cast("int"))
    counts = {r["pc"]: -(-r["n"] // tile) for r in one.groupBy("pc").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    parts = F.coalesce(*[F.when(F.col("pc") == k, F.lit(n)) for k, n in sorted(counts.items())], F.lit(1))
    dealt = one.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int")).groupBy("pc", "part").agg(F.collect_list("fp").alias("fps"))
    path = fresh_path(spark, "tiles")
    fs, base = open_fs(path)
    fs.create_dir(base, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for b in batches:
            for pc, part, x in zip(*b.columns, strict=True):
                temp = f"{base}/.{pc}-{part}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(np.sort(x.values.to_numpy()).tobytes())
                fs.move(temp, f"{base}/{pc}-{part}.i64")
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["pc", "part"])

    written(dealt.mapInArrow(lean(store), "pc int, part int"), "tile-names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)

        def load(pc: int, part: int) -> np.ndarray:
            name = f"{base}/{pc}-{part}.i64"
            if fs.get_file_info(name).type == FileType.NotFound:  # a part that got no fingerprint
                return np.zeros(0, np.uint64)
            with fs.open_input_file(name) as f:
                return np.frombuffer(f.read(), np.uint64)

        for b in batches:
            for l_pc, l_part, pc, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                left = load(l_pc, l_part)
                found = [compare(left, load(pc, part), radius) for part in range(first, last)]
                x, y = forest(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, y)], names=["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(k, n, j, counts[j]) for k, n in sorted(counts.items()) for j in range(k, k + radius + 1) if j in counts]
    # of one population count a tile meets itself and those after it
    meet = spark.createDataFrame(rows, "l_pc int, l_parts int, pc int, parts int").select("l_pc", F.explode(F.sequence(F.lit(0), F.col("l_parts") - 1)).alias("l_part"), "pc", "parts")
    first = F.when(F.col("pc") == F.col("l_pc"), F.col("l_part")).otherwise(0)
    blocks = meet.repartition(n, "l_pc", "l_part").select("l_pc", "l_part", "pc", "parts", F.explode(F.sequence(first, F.col("parts") - 1, F.lit(RUN))).alias("first"))
    spread = blocks.select("l_pc", "l_part", "pc", "first", F.least(F.col("first") + RUN, "parts").alias("last")).repartition(4 * n, "l_pc", "l_part", "pc", "first")
    return spread.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(id_col, fp bigint, component_id) of each row of docs: component_id is the smallest id that is reachable over
    links of fingerprints that differ in radius bits at most.

    Every pair of distinct fingerprints is compared or excluded by a bound, so nothing is lost; equal fingerprints meet
    as one. Null or empty texts have fingerprint 0 and are linked like any other; repeated rows and ids give a row each;
    a null id never is a component's id unless all its ids are null; an empty table gives no rows; further columns are
    ignored."""
    spark = docs.sparkSession
    own = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = written(links(distinct.select("fp"), radius), "links")
    label = written(connected_components(found), "labels")
    labelled = written(distinct.join(small(label), distinct.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    ids = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "component-ids")
    part_of = written(labelled.join(small(ids), "label").select("fp", "component_id"), "components")
    dropped(spark, found, label, labelled, ids, distinct)
    return own.join(small(part_of), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id isn't its component's smallest. Rows with a null id stay if their whole component
    has no other; rows that repeat the smallest id stay, as they can't be told apart by it."""
    gone = near_duplicates(docs, id_col, **options).where(f"{id_col} <> component_id").select(id_col).distinct()
    return only(docs, written(gone, "near-duplicates"), id_col, "left_anti").select(*docs.columns)
