"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import lean
from .common import fresh_path, open_fs, written

#: Links of a node per upper level (twice as many on the lowest), candidates of an insertion, and width of a search.
LINKS, CANDIDATES, WIDTH = 16, 48, 160
#: Vectors of a shard at most, about, queries that a task reads at once, and shards that it holds while it reads them.
SHARD, QUERY_BLOCK, HELD = 16_384, 512, 4


# ---- the graph ------------------------------------------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each integer."""
    with np.errstate(over="ignore"):
        z = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _choose(x: np.ndarray, node: np.ndarray, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of the nodes found (nearest first) those to link: one that is nearer to a chosen one than to the node waits, and
    fills up what is left."""
    if len(found) <= 2:
        return found[:most]
    y = x[found]
    sq = (y * y).sum(axis=1)
    between = sq[:, None] + sq[None, :] - 2 * (y @ y.T)
    alive, chosen = np.ones(len(found), bool), []
    while len(chosen) < most:
        i = int(alive.argmax())
        if not alive[i]:
            break
        chosen.append(i)
        alive &= between[i] > dist
        alive[i] = False
    if len(chosen) < most:
        rest = np.ones(len(found), bool)
        rest[chosen] = False
        chosen += np.flatnonzero(rest)[: most - len(chosen)].tolist()
    return found[np.array(chosen)]


class Graph:
    """x: vectors (float64) in the order of insertion; ids; levels: per level, its nodes and a row of neighbours for each
    (-1: none), the lowest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.x, self.levels = ids, x, levels
        self.place = [{int(v): i for i, v in enumerate(nodes)} for nodes, _ in levels[1:]]
        self.seen, self.stamp = np.zeros(len(x), np.int64), 0

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> Graph:
        """Inserts the vectors one after another, in an order and on levels that their ids' hashes give. A new node is
        linked to diverse ones of the nearest among all that the level has by then, which a matrix product finds exactly
        for a block of new nodes, and these link back; lists that grow too long are thinned by the same rule."""
        h = mixed(ids)
        order = cls.order(ids)
        ids, x, h = ids[order], np.ascontiguousarray(x[order], np.float64), h[order]
        sq = (x * x).sum(axis=1)
        u = (mixed(h.view(np.int64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / math.log(links)).astype(int)
        if len(level):
            level[0] = max(level.max(), 0)  # the first node is the entry
        levels = []
        for at in range(int(level.max()) + 1 if len(level) else 0):
            nodes = np.flatnonzero(level >= at)
            most = 2 * links if at == 0 else links
            near: list[list[int]] = [[] for _ in nodes]
            y, ysq = x[nodes], sq[nodes]
            for start in range(0, len(nodes), 512):
                end = min(start + 512, len(nodes))
                d = ysq[start:end, None] + ysq[None, :end] - 2 * (y[start:end] @ y[:end].T)
                d[np.arange(end)[None, :] >= np.arange(start, end)[:, None]] = np.inf
                k = min(candidates, end)
                best = np.argpartition(d, k - 1, axis=1)[:, :k] if k < end else np.tile(np.arange(end), (end - start, 1))
                for r in range(end - start):
                    found = best[r][best[r] < start + r]
                    dist = d[r, found]
                    o = np.lexsort((found, dist))
                    for v in _choose(y, y[start + r], found[o], dist[o], links).tolist():
                        near[start + r].append(v)
                        near[v].append(start + r)
            flat = np.full((len(nodes), most), -1, np.int32)
            for i, got in enumerate(near):
                got = np.array(got, np.int64)
                if len(got) > most:
                    dist = ((y[got] - y[i]) ** 2).sum(axis=1)
                    o = np.lexsort((got, dist))
                    got = _choose(y, y[i], got[o], dist[o], most)
                flat[i, : len(got)] = nodes[got]
            levels.append((nodes, flat))
        return cls(ids, x, levels)

    @staticmethod
    def order(ids: np.ndarray) -> np.ndarray:
        """The order in which build() inserts."""
        return np.argsort(mixed(ids), kind="stable")

    def search(self, q: np.ndarray, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest that are found, nearest first, ties by id."""
        at, dist = self.places(q, k, width)
        return self.ids[at], dist

    def places(self, q: np.ndarray, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """search(), with places in the graph's arrays for ids."""
        x = self.x
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0)
        now, best = 0, float(((x[0] - q) ** 2).sum())
        for (_, flat), place in zip(self.levels[:0:-1], self.place[::-1], strict=True):
            while True:
                near = flat[place[now]]
                near = near[near >= 0]
                if not len(near):
                    break
                d = ((x[near] - q) ** 2).sum(axis=1)
                i = int(d.argmin())
                if d[i] >= best:
                    break
                now, best = int(near[i]), float(d[i])
        flat = self.levels[0][1]
        self.stamp += 1
        seen, stamp = self.seen, self.stamp
        seen[now] = stamp
        todo, kept = [(best, now)], [(-best, now)]
        while todo:
            d, i = heapq.heappop(todo)
            if d > -kept[0][0] and len(kept) >= width:
                break
            near = flat[i]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            dist = ((x[near] - q) ** 2).sum(axis=1)
            if len(kept) >= width:
                ok = dist < -kept[0][0]
                near, dist = near[ok], dist[ok]
            for e, j in zip(dist.tolist(), near.tolist(), strict=True):
                if len(kept) < width:
                    heapq.heappush(kept, (-e, j))
                elif e < -kept[0][0]:
                    heapq.heapreplace(kept, (-e, j))
                else:
                    continue
                heapq.heappush(todo, (e, j))
        found = np.array([j for _, j in kept])
        dist = np.sqrt(((x[found] - q) ** 2).sum(axis=1))
        o = np.lexsort((self.ids[found], dist))[:k]
        return found[o], dist[o]

    def flat(self) -> dict:
        """Plain arrays, from which load() makes the graph again."""
        return {"ids": self.ids.tobytes(), "x": self.x.tobytes(), "nodes": [n.astype("<i4").tobytes() for n, _ in self.levels], "near": [f.astype("<i4").tobytes() for _, f in self.levels]}

    @classmethod
    def load(cls, row: dict) -> Graph:
        ids = np.frombuffer(row["ids"], "<i8")
        nodes = [np.frombuffer(n, "<i4") for n in row["nodes"]]
        near = [np.frombuffer(f, "<i4").reshape(len(n), -1) for n, f in zip(nodes, row["near"], strict=True)]
        return cls(ids, np.frombuffer(row["x"], "<f8").reshape(len(ids), -1), list(zip(nodes, near, strict=True)))


# ---- on Spark -------------------------------------------------------------------------------------------------------
def usable(vector: Column) -> Column:
    """Whether a vector has components that are all finite and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def build_index(classes: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per shard (dim, shard, and the flat arrays of its graph) of classes (id, h1, h2, vec), with h2 of its nodes as keys, written into the shared
    folder. Every row is indexed; shards are dealt by the hash of the vector, so they are of even size."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per number of dimensions
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // shard))) for d, n in sorted(sizes.items())], F.lit(1))
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("x", pa.binary()), ("nodes", pa.list_(pa.binary())), ("near", pa.list_(pa.binary()))])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, part = (k.as_py() for k in key)
        x = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids, keys = rows.column("id").to_numpy(), rows.column("h2").to_numpy()
        return pa.Table.from_pylist([{"dim": dim, "shard": part, "keys": keys[Graph.order(ids)].tobytes(), **Graph.build(ids, x).flat()}], schema=schema)

    dealt = classes.select("dim", F.pmod("h1", count).cast("int").alias("shard"), "id", "h2", "vec")
    return written(dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, keys binary, ids binary, x binary, nodes array<binary>, near array<binary>"), "ann-index")


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """(q, dim, shard, id, h2, score): for each query (q, dim, vec) the k nearest nodes of every shard that its graph finds. A task
    takes its shards a few at a time, and for those reads the queries once, in blocks, from the shared folder."""
    spark = index.sparkSession
    path = fresh_path(spark, "ann-queries")
    queries.select("q", "dim", "vec").write.parquet(path)

    def blocks() -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector

        fs, base = open_fs(path)
        for info in sorted(fs.get_file_info(FileSelector(base)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)

    def answered(held: list[tuple[int, int, np.ndarray, Graph]]) -> Iterator[pa.RecordBatch]:
        for block in blocks():
            out: list[tuple] = []
            for q, dim, vec in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(2), strict=True):
                for d, part, keys, graph in held:
                    if d == dim:
                        at, dist = graph.places(vec.values.to_numpy(), k, width)
                        out.append((np.full(len(at), q), np.full(len(at), d, np.int32), np.full(len(at), part, np.int32), graph.ids[at], keys[at], dist))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "dim", "shard", "id", "h2", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, Graph]] = []
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                held.append((row["dim"], row["shard"], np.frombuffer(row["keys"], "<i8"), Graph.load(row)))
                if len(held) == HELD:
                    yield from answered(held)
                    held = []
        if held:
            yield from answered(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "dim", "shard").mapInArrow(lean(run), "q long, dim int, shard int, id long, h2 long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id_col, score): of each row for which is_query holds the k nearest other rows that are found, by
    Euclidean distance in double precision on the original vectors, nearest first, ties to the smaller id.

    Equal vectors are one node of the graph, which knows its k + 1 smallest ids, all that an answer can hold; so copies,
    however many, neither crowd the graph nor a task. A vector is known by 128 bits of hashes, so that the joins carry these
    and not the vectors. Shards' results are merged by rank. Rows without an id, and vectors that aren't usable(), take no
    part; vectors of another number of dimensions aren't neighbours; rows that repeat an id with the same vector count once;
    an id with several vectors is asked and found by each, so it may have k ranks for each of them and be named twice in a
    list, but never in its own; fewer rows give fewer neighbours; further columns are ignored."""
    key = ["h1", "h2"]
    rows = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double") + F.lit(0.0)).alias("vec"), "_q")
    rows = written(rows.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec", "_q"), "ann-rows")
    few = rows.select("id", *key).withColumn("r", F.dense_rank().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("r") <= k + 1)
    ids = written(few.groupBy(*key).agg(F.sort_array(F.collect_set("id")).alias("ids")), "ann-ids")
    reps = ids.select(*key, F.col("ids")[0].alias("id"))
    # a row for each vector: that of its smallest id, which partial aggregates make one if it is repeated
    classes = written(rows.join(reps, [*key, "id"], "left_semi").groupBy(*key, "id").agg(F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "ann-classes")
    asked = written(rows.where("_q").select(F.col("id").alias("query_id"), *key).distinct(), "ann-asked")
    index = build_index(classes, shard)
    numbered = written(asked.select(*key).distinct().withColumn("q", F.monotonically_increasing_id()), "ann-numbers")
    queries = classes.join(numbered, key).select("q", "dim", "vec")
    found = search_index(index, queries, k + 1, width)
    nearer = Window.partitionBy("q").orderBy("score", "id", "h2")
    best = written(found.withColumn("r", F.row_number().over(nearer)).where(F.col("r") <= k + 1).select("q", "h2", "dim", "shard", "score"), "ann-best")
    # a node is known by h2 within its shard; of a class's neighbours k + 1 ids are enough for each of its queries
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // shard))) for d, n in sorted(sizes.items())], F.lit(1))
    named = classes.select(*key, "dim", F.pmod("h1", count).cast("int").alias("shard")).join(ids, key).select("h2", "dim", "shard", "ids")
    members = best.join(named, ["h2", "dim", "shard"]).select("q", "score", F.explode("ids").alias("id"))
    top = members.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    own = asked.join(numbered, key).select("query_id", "q").join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x.id != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "n")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias(id_col), F.col("n.score").alias("score"))
