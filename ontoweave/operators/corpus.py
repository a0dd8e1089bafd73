"""Samples, splits and labelled pairs of labels for learned matchers; all chance is a hash of keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(seed: int | str, *keys) -> Column:
    """A number of [0, 1) by the md5 of seed and keys, the same on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(rows: DataFrame, k: int, seed: int | str, *keys: str) -> DataFrame:
    """min(k, all) rows without replacement."""
    return rows.orderBy(chance(seed, *keys), *keys).limit(k)


def shuffled(rows: DataFrame, seed: int | str, *keys: str) -> DataFrame:
    return rows.orderBy(chance(seed, *keys), *keys)


def split(rows: DataFrame, share: float, seed: int | str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(the rest, about a share of the rows), by keys, so equal keys stay together."""
    return rows.where(chance(seed, *keys) >= share), rows.where(chance(seed, *keys) < share)


def other_than(n: int, own: Column, seed: int | str, *keys) -> Column:
    """An integer of 0 .. n - 1 other than own."""
    drawn = F.floor(chance(seed, *keys) * F.lit(max(n - 1, 1))).cast("long")
    return F.when(drawn >= own, drawn + 1).otherwise(drawn)


def synonyms(labels: DataFrame) -> DataFrame:
    """(l1, l2) of different labels of a class, both ways."""
    own = labels.select("iri", F.lower("label").alias("label")).distinct()
    return own.withColumnRenamed("label", "l1").join(own.withColumnRenamed("label", "l2"), "iri").where("l1 <> l2").select("l1", "l2").distinct()


def identities(labels: DataFrame) -> DataFrame:
    return labels.select(F.lower("label").alias("l1")).distinct().select("l1", F.col("l1").alias("l2"))


def hard_negatives(labels: DataFrame, siblings: DataFrame) -> DataFrame:
    """(l1, l2) of labels of sibling classes (c1, c2), both ways."""
    a = siblings.join(labels.select(F.col("iri").alias("c1"), F.lower("label").alias("l1")), "c1").join(labels.select(F.col("iri").alias("c2"), F.lower("label").alias("l2")), "c2").select("l1", "l2")
    return a.union(a.select("l2", "l1")).where("l1 <> l2").distinct()


def places(rows: DataFrame, key: str, size: int, seed: int | str) -> DataFrame:
    """rows with place, one of size places by the hash of key: about one row a place if size is their number."""
    return rows.withColumn("place", F.floor(chance(f"{seed}/place", key) * F.lit(max(size, 1))).cast("long"))


def soft_negatives(labels: DataFrame, n: int, seed: int | str) -> DataFrame:
    """(l1, l2): for each label n draws of a place of the table of labels, and what stands there: about n other labels."""
    own = labels.select(F.lower("label").alias("l1")).distinct()
    total = own.count()
    drawn = own.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("place", F.floor(chance(seed, "l1", "r") * F.lit(max(total, 1))).cast("long"))
    there = places(own.withColumnRenamed("l1", "l2"), "l2", total, seed)
    return drawn.join(there, "place").where("l1 <> l2").select("l1", "l2").distinct()


def valid_negatives(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """Negatives of different labels that are no synonyms either way."""
    both = positives.select("l1", "l2").union(positives.select("l2", "l1")).distinct()
    return negatives.where("l1 <> l2").distinct().join(both, ["l1", "l2"], "left_anti")


def merged_corpus(*labels: DataFrame, siblings: DataFrame | None = None, n_soft: int = 2, seed: int | str = 0) -> DataFrame:
    """(l1, l2, kind, label) of the label tables of several ontologies: identities and synonyms are 1, soft and hard negatives
    that no ontology has for synonyms are 0."""
    every = labels[0].select("iri", "label")
    for other in labels[1:]:
        every = every.union(other.select("iri", "label"))
    positive = identities(every).withColumn("kind", F.lit("identity")).union(synonyms(every).withColumn("kind", F.lit("synonym")))
    negative = valid_negatives(soft_negatives(every, n_soft, seed), positive).withColumn("kind", F.lit("soft"))
    if siblings is not None:
        negative = negative.union(valid_negatives(hard_negatives(every, siblings), positive).withColumn("kind", F.lit("hard")))
    return positive.withColumn("label", F.lit(1)).union(negative.withColumn("label", F.lit(0)))


def counters(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("kind", "label").agg(F.count("*").alias("n"))


def negative_mappings(positives: DataFrame, lefts: DataFrame, rights: DataFrame, seed: int | str = 0) -> DataFrame:
    """(entity1, entity2): per positive pair about one with another right and one with another left entity, by chance,
    none of them positive."""
    a, b = lefts.select("entity1").distinct(), rights.select("entity2").distinct()
    n, m = a.count(), b.count()
    draw = lambda k, s: F.floor(chance(f"{seed}{s}", "entity1", "entity2") * F.lit(max(k, 1))).cast("long").alias("place")
    right = positives.select("entity1", draw(m, "r")).join(places(b, "entity2", m, seed), "place").select("entity1", "entity2")
    left = positives.select("entity2", draw(n, "l")).join(places(a, "entity1", n, seed), "place").select("entity1", "entity2")
    return right.union(left).distinct().join(positives.select("entity1", "entity2"), ["entity1", "entity2"], "left_anti")


def label_clusters(labels: DataFrame) -> DataFrame:
    """(labels, iris, n): classes whose sets of labels are the same."""
    sets = labels.groupBy("iri").agg(F.array_sort(F.collect_set(F.lower("label"))).alias("labels"))
    return sets.groupBy("labels").agg(F.array_sort(F.collect_set("iri")).alias("iris"), F.count("*").alias("n"))


def repeated_labels(labels: DataFrame) -> DataFrame:
    """(label, n, first_iri) of labels that several classes have."""
    return labels.select(F.lower("label").alias("label"), "iri").distinct().groupBy("label").agg(F.count("*").alias("n"), F.min("iri").alias("first_iri")).where("n > 1")


def cluster_gaps(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """cells (id, labels) with missing: the labels of the clusters (labels) that a cell touches which it lacks itself."""
    of = clusters.select(F.explode("labels").alias("l"), F.col("labels").alias("cluster"))
    touched = cells.select("id", "labels", F.explode("labels").alias("l")).join(of, "l").groupBy("id", "labels").agg(F.array_distinct(F.flatten(F.collect_set("cluster"))).alias("c"))
    return touched.select("id", "labels", F.array_sort(F.array_except("c", "labels")).alias("missing")).where(F.size("missing") > 0)


def label_stats(labels: DataFrame, depth: DataFrame) -> DataFrame:
    """A row (longest_label, deepest)."""
    return labels.agg(F.max(F.length("label")).alias("longest_label")).join(F.broadcast(depth.agg(F.max("depth").alias("deepest"))))


def centroids(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vec): the mean vector of each group, a partial sum per dimension."""
    each = vectors.select(by, F.posexplode(vector).alias("i", "v")).groupBy(by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vec"))


def label_batches(labels: DataFrame, budget: int, buckets: int = 1) -> DataFrame:
    """(iri, bucket, batch): classes of labels (iri, label) dealt into batches in order of IRI. A batch takes classes while its
    labels stay below the budget, one class at least. Each of some buckets, by a hash of the IRI, has batches of its own, so
    they are made side by side; rows stream through, and a batch's running count is all that is kept."""
    sized = labels.where("iri is not null").groupBy("iri").agg(F.count("label").alias("n")).withColumn("bucket", F.expr(f"int(pmod(xxhash64(iri), {buckets}))"))

    def deal(batches):
        import pandas as pd

        bucket, batch, held = None, 0, None
        for rows in batches:
            at = []
            for b, n in zip(rows["bucket"], rows["n"]):
                if b != bucket:
                    bucket, batch, held = b, 0, None
                elif held is not None and held + n >= budget:
                    batch, held = batch + 1, None
                held = (held or 0) + n
                at.append(batch)
            yield pd.DataFrame({"iri": rows["iri"], "bucket": rows["bucket"], "batch": at})

    return sized.repartition(buckets, "bucket").sortWithinPartitions("bucket", "iri").mapInPandas(deal, "iri string, bucket int, batch long")
