import corpus_pipeline
from ontoweave.llm import decontamination, mixing, simhash, toxicity
from ontoweave.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), name))
    columns, ids = docs.columns, [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    assert all(df.columns == columns for df in kept[:-1]) and all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    assert ids[0] - ids[1] == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    groups = {}
    for r in kept[1].select("doc_id", "text").collect():
        groups.setdefault(simhash.fingerprint((r["text"] or "").encode()), []).append(r["doc_id"])
    least = {i: min(v) for v in groups.values() for i in v}
    assert ids[2] <= set(least.values()) and len(ids[2]) >= 0.8 * len(least) * len(groups) / max(len(least), 1)
    assert ids[2] - ids[3] == {r["doc_id"] for r in decontamination.overlaps(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[4] == {r["doc_id"] for r in mixing.mix(kept[3]).where("selected").collect()} == ids[5]
    rows = kept[5].orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert sorted(ids[5]) == [r["doc_id"] for r in corpus_pipeline.run(spark, sf).orderBy("start").collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
