import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoweave.llm import ann


def brute(rows, queries, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            near = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))
            out[q] = near[:k]
    return out


def test_recall_of_a_graph():
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 32))
    x = centres[r.integers(20, size=4000)] + 0.3 * r.normal(size=(4000, 32))
    g = ann.Graph.load(ann.Graph.build(np.arange(4000), x).flat())
    hit = 0
    for q in range(0, 4000, 100):
        want = set(np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:11].tolist())
        hit += len(want & set(g.search(x[q], 11)[0].tolist()))
    assert hit >= 0.95 * 40 * 11
    assert all((flat < 4000).all() for _, flat in g.levels) and len(g.levels) > 1


def test_query_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(700)]
    same = rows[3][1]
    rows += [(700 + i, same) for i in range(300)]  # copies, a third of all
    rows += [(1100, None), (1200, [0.0] * 8), (1300, [float("nan")] + [1.0] * 7), (1400, [None] + [1.0] * 7), (1500, [1.0, 2.0]), (None, same), (1600, []), (5, rows[5][1]), (1700, [float("inf")] * 8)]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for x in ann.nearest(frame, F.col("vec_id") % 100 == 0, 10, shard=256).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    want = brute(rows, range(0, 2000, 100), 10)
    assert set(got) == {q for q, n in want.items() if n}
    hit = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(near) + 1))
        assert [n[1] for n in near] == sorted(n[1] for n in near)
        hit += len({n[2] for n in near} & {i for _, i in want[q]}) / len(want[q])
        if q >= 700:
            assert [n[2] for n in near] == [i for _, i in want[q]], "ties go to the smaller ids"
    assert hit / len(got) >= 0.9
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_on_the_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in v.collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = ann.nearest(v, F.col("vec_id") % 100 == 0).collect()
    hit = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for r in got:
        assert r["score"] == pytest.approx(next((s for s, i in want[r["query_id"]] if i == r["vec_id"]), r["score"]), abs=1e-12)


def test_ties_and_ids_with_several_vectors(spark):
    # four vectors at the same distance of the query, and an id with two vectors
    rows = [(100, [1.0, 1.0])] + [(i, [1.0 + x, 1.0 + y]) for i, (x, y) in zip((7, 3, 9, 5), ((1, 0), (-1, 0), (0, 1), (0, -1)))] + [(4, [8.0, 8.0]), (4, [1.0, 1.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 0.5), (3, 1.0), (5, 1.0)]
    asked = ann.nearest(spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [1.2]), (2, [3.5])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 1).collect()
    assert sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in asked) == [(1, 1, 0.2), (1, 2, 0.5)]


def test_tasks_hold_some_shards(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = ann.nearest(frame, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "HELD", 2)
    assert ann.nearest(frame, F.col("vec_id") % 100 == 0, 10, shard=60).orderBy("query_id", "rank").collect() == one
