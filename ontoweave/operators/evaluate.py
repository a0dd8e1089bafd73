"""Alignments against gold ones: hits, metrics, threshold sweeps, sampled estimates, and matchers side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["entity1", "entity2"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def true_positives(predicted: DataFrame, gold: DataFrame, on: list[str] = PAIR) -> DataFrame:
    """Predicted rows that gold has; repeats stay."""
    return predicted.join(gold.select(*on).distinct(), on, "left_semi")


def false_positives(predicted: DataFrame, gold: DataFrame, on: list[str] = PAIR) -> DataFrame:
    return predicted.join(gold.select(*on), on, "left_anti")


def false_negatives(predicted: DataFrame, gold: DataFrame, on: list[str] = PAIR) -> DataFrame:
    return gold.join(predicted.select(*on), on, "left_anti")


def metrics(predicted: DataFrame, gold: DataFrame, matchers: DataFrame | None = None, on: list[str] = PAIR) -> DataFrame:
    """(matcher, precision, recall, f1, n_tp, n_fp, n_gold) of predictions (matcher, *on), all in one aggregate; matchers
    (matcher) that predict nothing get zeros, and precision and recall of nothing are 0."""
    n_gold = gold.select(*on).distinct().agg(F.count("*").alias("n_gold"))
    hit = gold.select(*on).distinct().withColumn("_hit", F.lit(1))
    rows = predicted.join(hit, on, "left").groupBy("matcher").agg(F.sum(F.coalesce("_hit", F.lit(0))).alias("n_tp"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("n_fp"))
    rows = rows if matchers is None else matchers.join(rows, "matcher", "left").na.fill(0, ["n_tp", "n_fp"])
    rows = rows.join(F.broadcast(n_gold))  # one row
    p, r = ratio(F.col("n_tp"), F.col("n_tp") + F.col("n_fp")), ratio(F.col("n_tp"), F.col("n_gold"))
    return rows.select("matcher", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "n_tp", "n_fp", "n_gold")


def point_metrics(scored: DataFrame, least: float) -> DataFrame:
    """A row (precision, recall, f1, accuracy) of scored rows (score, truth: boolean) at a threshold."""
    says, true = F.col("score") >= least, F.col("truth")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = scored.agg(n(says & true).alias("tp"), n(says & ~true).alias("fp"), n(~says & true).alias("fn"), n(says == true).alias("ok"), F.count("*").alias("n"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("ok"), F.col("n")).alias("accuracy"))


def sweep(scored: DataFrame, steps: int = 50) -> DataFrame:
    """(step, threshold, precision, recall, f1) at 0, 1/steps, ... below 1 of scored rows (score, truth: boolean).

    Rows are first counted by the step up to which they hold, so what meets the thresholds is at most steps + 1 rows."""
    spark = scored.sparkSession
    reach = F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).cast("int")
    by = scored.groupBy(reach.alias("reach")).agg(F.sum(F.col("truth").cast("long")).alias("pos"), F.count("*").alias("n"))
    at = spark.range(steps).select(F.col("id").cast("int").alias("step"))
    n = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    over = F.col("reach") >= F.col("step")
    sums = by.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).groupBy("step").agg(n(over, "pos").alias("tp"), n(over, "n").alias("said"), F.sum("pos").alias("gold"))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("gold"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return at.join(sums, "step", "left").select("step", (F.col("step") / steps).alias("threshold"), zero(p).alias("precision"), zero(r).alias("recall"), zero(f1(p, r)).alias("f1"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of sweep() with the first of the highest F1."""
    return swept.orderBy(F.desc("f1"), "step").limit(1)


def estimates(predicted: DataFrame, gold: DataFrame, annotated: DataFrame, pool: DataFrame, annotated_pool: DataFrame) -> DataFrame:
    """A row (precision, recall, f1): what predicted has beyond gold counts by the share of its annotated sample (correct:
    0/1, null: not annotated) that is correct, and gold is enlarged by that share of the pool of all matchers' pairs beyond
    gold."""
    share = lambda df, name: df.where("correct is not null").agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias(name))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    beyond = lambda df: df.select(*PAIR).distinct().join(gold.select(*PAIR), PAIR, "left_anti")
    one = count(predicted.select(*PAIR).distinct(), "m").join(F.broadcast(count(gold.select(*PAIR).distinct(), "g"))).join(F.broadcast(count(beyond(predicted), "new"))).join(F.broadcast(count(beyond(pool), "pool"))).join(F.broadcast(share(annotated, "s"))).join(F.broadcast(share(annotated_pool, "t")))
    right = F.col("m") - F.col("new") + F.col("s") * F.col("new")
    p, r = ratio(right, F.col("m")), ratio(right, F.col("g") + F.col("t") * F.col("pool"))
    return one.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def side_by_side(predicted: DataFrame, gold: DataFrame, matchers: list[str]) -> DataFrame:
    """(entity1, entity2, is_correct, a boolean per matcher) of every pair of gold and of predictions (matcher, ...)."""
    every = predicted.select(*PAIR, "matcher").union(gold.select(*PAIR, F.lit("")))
    wide = every.groupBy(*PAIR).pivot("matcher", ["", *matchers]).agg(F.max(F.lit(True)))
    return wide.select(*PAIR, *[F.coalesce(F.col(f"`{m}`"), F.lit(False)).alias(m or "is_correct") for m in ["", *matchers]])


def agreement(wide: DataFrame, matchers: list[str], truth: str = "is_correct") -> DataFrame:
    """Whether each matcher is right on a pair, in place of what it says."""
    return wide.select(*PAIR, truth, *[(F.col(m) == F.col(truth)).alias(m) for m in matchers])


def first_labels(labels: DataFrame, single: bool = False) -> DataFrame:
    """(iri, label): the first label by place; with single, classes of several labels show the tail of their IRI."""
    best = labels.groupBy("iri").agg(F.min_by("label", F.struct("pos", "label")).alias("label"), F.count("*").alias("n"))
    return best.select("iri", F.when(F.col("n") == 1, F.col("label")).otherwise(F.regexp_extract("iri", r"([^#/]*)$", 1)).alias("label") if single else F.col("label"))


def with_labels(pairs: DataFrame, labels1: DataFrame, labels2: DataFrame) -> DataFrame:
    """pairs with source and target, the labels (iri, label) of their ends; null where there is none."""
    a, b = labels1.select(F.col("iri").alias("entity1"), F.col("label").alias("source")), labels2.select(F.col("iri").alias("entity2"), F.col("label").alias("target"))
    return pairs.join(a, "entity1", "left").join(b, "entity2", "left")


def ids_of_labels(wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """wanted (label) with iri and n, the number of classes with that label without case: 1 where the answer is clear. A
    label that is a class's IRI stands for it."""
    own = labels.select(F.lower("label").alias("_k"), "iri").union(labels.select("iri", "iri")).distinct().groupBy("_k").agg(F.min("iri").alias("iri"), F.count("*").alias("n"))
    by_id = own.withColumnsRenamed({"iri": "_i", "n": "_n"})
    found = wanted.withColumn("_k", F.lower("label")).join(own, "_k", "left").withColumn("_k", F.col("label")).join(by_id, "_k", "left")
    return found.withColumn("iri", F.coalesce("iri", "_i")).withColumn("n", F.coalesce("n", "_n", F.lit(0))).drop("_k", "_i", "_n")


def ids_of_suffixes(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """wanted (symbol) with iri and n: the smallest IRI of classes (iri) that ends in the symbol, and how many do; only 1 is a
    clear answer. An IRI is cut to the lengths that symbols have, which are few, so symbols meet IRIs by equality."""
    lengths = [r[0] for r in wanted.select(F.length("symbol").alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    ends = classes.select("iri").distinct().withColumn("_l", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).where("length(iri) >= _l")
    ends = ends.join(wanted.select("symbol").distinct(), F.expr("right(iri, _l) = symbol")).groupBy("symbol").agg(F.min("iri").alias("iri"), F.count("*").alias("n"))
    return wanted.join(ends, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def missing(references: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    """Values of references that known doesn't have: a check that passes if it has no rows."""
    return references.select(F.col(column).alias(key)).distinct().join(known.select(key), key, "left_anti")
