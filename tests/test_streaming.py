from pyspark.sql import functions as F

from ontoweave.streaming import incremental as I


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = lambda: spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    got = run(spark, I.windowed_counts(events(), "1 day"), tmp_path, "w", "complete")
    want = batch.groupBy(F.window("ts", "1 day").start, "event_type").count().count()
    assert len(got) == want and sum(r["n"] for r in got) == batch.count()
    assert sum(r["n"] for r in run(spark, I.sessions(events()), tmp_path, "s", "complete")) == batch.where("user_id is not null").count()
    target = spark.createDataFrame([("t1", "CLICK"), ("t2", "view")], "iri string, label string")
    labels = events().select(F.col("user_id").cast("string").alias("iri"), F.col("event_type").alias("label"), "ts")
    pairs = run(spark, I.first_matches(I.match_new_labels(labels, target), "1000 days"), tmp_path, "m")
    assert len(pairs) == batch.where("event_type in ('click', 'view')").select("user_id", "event_type").distinct().count()
    scored = events().select(F.col("event_type").alias("entity1"), F.col("user_id").cast("string").alias("entity2"), F.col("value").alias("score")).where("score is not null")
    best = run(spark, I.running_best(scored), tmp_path, "b", "update")
    top = {r["event_type"]: r["v"] for r in batch.groupBy("event_type").agg(F.max("value").alias("v")).collect()}
    assert {r["entity1"]: r["score"] for r in best} == top
