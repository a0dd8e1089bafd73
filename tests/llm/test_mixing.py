import pytest

from ontoweave.llm import mixing as M


def test_rake_meets_margins(spark):
    rows = [("=a", "=x", 600), ("=a", "=y", 300), ("=b", "=x", 50), ("=b", "=y", 250), ("-", "=x", 100)]
    cells = spark.createDataFrame(rows, "_k0 string, _k1 string, _n long")
    got = M.rake(cells, {"s": {"a": 0.4, "b": 0.4, None: 0.2}, "l": {"x": 0.5, "y": 0.5}}, budget=0.2, rounds=30).collect()
    w = {(r["_k0"], r["_k1"]): r["w"] for r in got}
    assert w["=a", "=x"] + w["=a", "=y"] == pytest.approx(104, rel=0.01) and w["-", "=x"] == pytest.approx(52, rel=0.01)
    assert sum(v for k, v in w.items() if k[1] == "=y") == pytest.approx(130, rel=0.01)
    assert all(v <= n for (_, _, n), v in zip(rows, (w[a, b] for a, b, _ in rows), strict=True))


def test_margins_of_documents(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    cells = M.keyed(docs, list(M.TARGETS), "text", None).groupBy("_k0", "_k1", "_k2").agg(F.sum("_n").alias("_n"))
    fitted = M.rake(cells, M.TARGETS)
    rows = M.margins(fitted, list(M.TARGETS)).collect()
    assert {r["dimension"] for r in rows} == set(M.TARGETS) and max(r["off"] for r in rows) < 0.001
    total = cells.agg(F.sum("_n")).first()[0]
    assert fitted.agg(F.sum("w")).first()[0] == pytest.approx(M.BUDGET * total, rel=0.001)
    assert fitted.where("w > _n + 1e-6").count() == 0


def test_a_value_gives_no_more_than_it_has(spark):
    cells = spark.createDataFrame([("=a", 10), ("=b", 100), ("=c", 890)], "_k0 string, _n long")
    w = {r["_k0"]: r["w"] for r in M.rake(cells, {"s": 0.0}, budget=0.3).collect()}
    assert w == pytest.approx({"=a": 10, "=b": 100, "=c": 190})
    assert sorted(r["w"] for r in M.rake(cells, {"s": 0.0}, budget=2.0).collect()) == pytest.approx([10, 100, 890])


def test_clashing_names(spark):
    rows = [(i, "some words", "s", 9.0, "mine", 1, 2, i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, probability double, selected string, _n int, _k0 int, `a.b` long")
    got = M.sampled(docs)
    assert got.columns == docs.columns and all(tuple(r) in rows for r in got.collect()) and 0 < got.count() < 50
    assert all(r["probability"] == pytest.approx(0.7) for r in M.mix(docs).collect())


def test_sampling_is_calibrated_and_repeatable(spark):
    rows = [(i, "w " * 20, "en", "big" if i % 10 else "small", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _x int")
    got = M.mix(docs, {"source": 0.0}, budget=0.1).collect()
    share = {s: sum(r["selected"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert share["big"] == pytest.approx(150, abs=40) and share["small"] == pytest.approx(150, abs=30)
    assert {r["doc_id"] for r in M.sampled(docs, targets={"source": 0.0}, budget=0.1).collect()} == {r["doc_id"] for r in got if r["selected"]}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, "", "en", "a"), (None, "x y", "en", "a"), (2, "word " * 50000, "de", "b"), (2, "word " * 50000, "de", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = M.mix(docs).collect()
    assert len(got) == 5 and all(0 <= r["probability"] <= 1 for r in got)
    assert [r["probability"] for r in got if not r["text"]] == [0, 0]
    assert M.mix(docs.limit(0)).count() == 0
    assert M.sampled(docs.drop("lang", "source")).columns == ["doc_id", "text"]


def test_few_and_many_cells_agree(spark, monkeypatch):
    rows = [(f"={i % 7}", f"={i % 3}", f"={i % 5}", 10 + (i * 37) % 400) for i in range(105)]
    cells = spark.createDataFrame(rows, "_k0 string, _k1 string, _k2 string, _n long")
    aims = {"a": 0.3, "b": 0.0, "c": {"0": 3.0, "1": 1.0, "2": 1.0, "3": 1.0}}
    key = lambda df: sorted((r["_k0"], r["_k1"], r["_k2"], round(r["w"], 6)) for r in df.collect())
    few = key(M.rake(cells, aims, 0.5, 6))
    monkeypatch.setattr(M, "BROADCAST_CELLS", 0)
    assert key(M.rake(cells, aims, 0.5, 6)) == few
    assert all(w == 0 for *_, c, w in few if c == "=4")
