"""From scored pairs to alignments, and the set algebra of alignments; pairs are (entity1, entity2, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["entity1", "entity2"]


def at_least(scored: DataFrame, least: float, strict: bool = False) -> DataFrame:
    return scored.where(F.col("score") > least if strict else F.col("score") >= least)


def with_maxima(scored: DataFrame) -> DataFrame:
    """scored with the best score of each row and column of the matrix."""
    return scored.withColumn("row_max", F.max("score").over(Window.partitionBy("entity1"))).withColumn("col_max", F.max("score").over(Window.partitionBy("entity2")))


def mutual_best(scored: DataFrame, zeros: bool = False) -> DataFrame:
    """Pairs that are best in row and column; of a row the first by the other entity. Scores of 0 count only if zeros."""
    best = with_maxima(scored).where("score = row_max and score = col_max" + ("" if zeros else " and score > 0"))
    return best.groupBy("entity1").agg(F.min("entity2").alias("entity2"), F.first("score").alias("score"))


def pseudo_metrics(scored: DataFrame, size1: int, size2: int) -> DataFrame:
    """A row (n, confidence, recall, precision, f1) of mutual_best: n over the smaller ontology, and the mean confidence; 0
    where nothing matches."""
    sums = mutual_best(scored).agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("confidence"))
    r, p = F.col("n") / F.lit(float(max(min(size1, size2), 1))), F.when(F.col("n") > 0, F.col("confidence") / F.col("n")).otherwise(0.0)
    return sums.select("n", "confidence", r.alias("recall"), p.alias("precision"), F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0).alias("f1"))


def best_per(scored: DataFrame, by: str = "entity1", other: str = "entity2", least: float = 0.0) -> DataFrame:
    """The best pair of each entity of by (the smaller ontology's side), if it reaches least; ties go to the smaller IRI."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), other))
    return scored.withColumn("_r", rank).where((F.col("_r") == 1) & (F.col("score") >= least)).drop("_r")


def all_or_best(scored: DataFrame, least: float) -> DataFrame:
    """All pairs of an entity1 that reach least, or its best one if none does."""
    by = Window.partitionBy("entity1")
    ranked = scored.withColumn("_m", F.max("score").over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), "entity2")))
    return ranked.where((F.col("score") >= least) | ((F.col("_m") < least) & (F.col("_r") == 1))).drop("_m", "_r")


def union_all(*alignments: DataFrame) -> DataFrame:
    out = alignments[0]
    for a in alignments[1:]:
        out = out.unionByName(a)
    return out


def union_distinct(*alignments: DataFrame) -> DataFrame:
    """Each pair once, with its highest score."""
    return union_all(*(a.select(*PAIR, "score") for a in alignments)).groupBy(*PAIR).agg(F.max("score").alias("score"))


def both_directions(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """forward, and backward (whose entity1 is the target's) turned round, distinct and without nulls."""
    turned = backward.select(F.col("entity2").alias("entity1"), F.col("entity1").alias("entity2"), "score")
    return union_distinct(forward, turned).na.drop()


def merged(first: DataFrame, *later: DataFrame) -> DataFrame:
    """Pairs of all, a later table's score winning over an earlier one's."""
    every = union_all(*(a.select(*PAIR, "score").withColumn("_o", F.lit(i)) for i, a in enumerate((first, *later))))
    return every.groupBy(*PAIR).agg(F.max_by("score", F.struct("_o", "score")).alias("score"))


def with_anchors(predictions: DataFrame, anchors: DataFrame) -> DataFrame:
    """predictions and those anchors that they lack."""
    return predictions.select(*PAIR, "score").union(anchors.select(*PAIR, "score").join(predictions.select(*PAIR), PAIR, "left_anti"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a that b has as well, whatever its scores; repeats in a stay."""
    return a.join(b.select(*PAIR).distinct(), PAIR, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a that b lacks; repeats in a stay."""
    return a.join(b.select(*PAIR), PAIR, "left_anti")


def uncovered(alignment: DataFrame, covered: DataFrame) -> DataFrame:
    """Pairs an end of which is in no pair of covered."""
    a = covered.select("entity1").distinct().withColumn("_a", F.lit(True))
    b = covered.select("entity2").distinct().withColumn("_b", F.lit(True))
    return alignment.join(a, "entity1", "left").join(b, "entity2", "left").where("_a is null or _b is null").select(*alignment.columns)


def rule_combination(lexical: DataFrame, semantic: DataFrame, strict: float = 0.95) -> DataFrame:
    """What two matchers agree on, with score 1; the lexical one's pairs an end of which that leaves open; and, where the
    semantic matcher says nothing of an end, the lexical pairs above strict. Each pair once."""
    agreed = intersection(lexical, semantic).select(*PAIR, F.lit(1.0).alias("score"))
    open_ends = uncovered(semantic, agreed).select(*PAIR, "score")
    alone = uncovered(at_least(lexical, strict, strict=True), union_all(agreed, open_ends)).select(*PAIR, "score")
    return union_distinct(agreed, open_ends, alone)


def branch_conflicts(pairs: DataFrame, rules: DataFrame, names1: DataFrame, names2: DataFrame) -> DataFrame:
    """pairs without those whose classes' names (iri, name) hold the two texts of a rule (part1, part2); the rules are few
    and broadcast if they are."""
    small = F.broadcast(rules) if rules.count() <= 10_000 else rules
    named = pairs.join(names1.select(F.col("iri").alias("entity1"), F.col("name").alias("n1")), "entity1").join(names2.select(F.col("iri").alias("entity2"), F.col("name").alias("n2")), "entity2")
    bad = named.join(small, F.col("n1").contains(F.col("part1")) & F.col("n2").contains(F.col("part2"))).select(*PAIR)
    return difference(pairs, bad)
