"""Candidate pairs without a cross product: equal labels, shared tokens, shared grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..scratch import written

#: Target classes of a token beyond which it is common.
COMMON = 10_000


def exact_labels(source: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct (entity1, entity2) whose labels (iri, label) agree without case. Labels are made distinct before they
    meet, so a label that many classes have meets each class once."""
    a = source.select(F.lower("label").alias("k"), F.col("iri").alias("entity1")).where("k is not null").distinct()
    b = target.select(F.lower("label").alias("k"), F.col("iri").alias("entity2")).distinct()
    return a.join(b, "k").select("entity1", "entity2").distinct()


def postings(labels: DataFrame, tokens: Callable[[Column], Column] = text.words, longer_than: int = 0) -> DataFrame:
    """The inverted index (token, iri), with repeats, of tokens of more than some characters."""
    out = labels.select("iri", F.explode(tokens(F.col("label"))).alias("token"))
    return (out.where(F.length("token") > longer_than) if longer_than else out).select("token", "iri")


def idf_candidates(source: DataFrame, target: DataFrame, k: int, tokens: Callable[[Column], Column] = text.words, common: int = COMMON) -> DataFrame:
    """(entity1, entity2, score, rank) of the k best candidates of each source class: the sum, over tokens both have, of
    log10(classes of the target / postings of the token), repeats on either side counted; ties go to the smaller IRI.

    Repeats are counts, so a token is one row a class on either side. Tokens of over common target classes, which would pair
    all with all, are added last, and to those pairs alone that other tokens make: where the k-th best of these outdoes all
    that a class could have from common tokens, no other pair can be among the k best. Only the classes for which this
    doesn't hold, as they have few other tokens, meet all targets of their common ones."""
    index = postings(target, tokens)
    total = target.select("iri").distinct().count()
    a = postings(source, tokens).groupBy("token", F.col("iri").alias("entity1")).agg(F.count("*").alias("n1"))
    b = index.groupBy("token", F.col("iri").alias("entity2")).agg(F.count("*").alias("n2"))
    weight = b.groupBy("token").agg(F.log10(F.lit(float(total)) / F.sum("n2")).alias("idf"), F.count("*").alias("df"), F.max("n2").alias("most"))
    weight = written(weight, "weights")
    share = F.sum(F.col("idf") * F.col("n1") * F.col("n2")).alias("score")
    hot = weight.where(F.col("df") > common)
    if hot.isEmpty():
        scored = a.join(b.join(weight, "token"), "token").groupBy("entity1", "entity2").agg(share)
        return top_k(scored, "entity1", k, F.desc(F.round("score", 9)), "entity2")
    rare = weight.where(F.col("df") <= common)
    a, b = written(a, "source-tokens"), written(b, "target-tokens")
    partial = written(a.join(b.join(rare, "token"), "token").groupBy("entity1", "entity2").agg(share), "partial-scores")
    # what common tokens can add at most, and take off at most (tokens in over all classes' number of postings weigh less than 0)
    ours = a.join(hot, "token").groupBy("entity1").agg(F.sum(F.greatest(F.lit(0.0), F.col("idf")) * F.col("n1") * F.col("most")).alias("up"), F.sum(F.least(F.lit(0.0), F.col("idf")) * F.col("n1") * F.col("most")).alias("down"))
    kth = top_k(partial, "entity1", k, F.desc("score"), "entity2").where(F.col("rank") == k).select("entity1", "score")
    sure = ours.join(kth, "entity1").where(F.col("score") + F.col("down") > F.col("up") + 1e-6).select("entity1")
    sure = written(sure, "sure-classes")
    added = partial.join(sure, "entity1", "left_semi").select("entity1", "entity2").join(a.join(hot.select("token", "idf"), "token"), "entity1").join(b, ["token", "entity2"]).groupBy("entity1", "entity2").agg(share)
    certain = partial.join(sure, "entity1", "left_semi").union(added)
    none = a.join(hot.select("token"), "token", "left_semi").select("entity1").distinct()
    apart = partial.join(none, "entity1", "left_anti")  # classes without common tokens
    open_ = a.join(sure, "entity1", "left_anti").join(none, "entity1", "left_semi")
    rest = open_.join(b.join(weight, "token"), "token").groupBy("entity1", "entity2").agg(share)
    scored = certain.union(apart).union(rest).groupBy("entity1", "entity2").agg(F.sum("score").alias("score"))
    return top_k(scored, "entity1", k, F.desc(F.round("score", 9)), "entity2")


def top_k(scored: DataFrame, by: str, k: int, *order) -> DataFrame:
    """Rows of the first k ranks within by (column rank); Spark limits groups before it shuffles them."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def label_pairs(source: DataFrame, target: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(entity1, entity2, label1, label2) of all labels of the pairs of classes."""
    a, b = source.select(F.col("iri").alias("entity1"), F.col("label").alias("label1")), target.select(F.col("iri").alias("entity2"), F.col("label").alias("label2"))
    return pairs.select("entity1", "entity2").join(a, "entity1").join(b, "entity2")


def near_labels(left: DataFrame, right: DataFrame, least: float, n: int = 2) -> DataFrame:
    """(l1, l2, score) of the pairs of distinct labels (column label) whose normalised Levenshtein similarity is least or
    more; none is lost.

    Each edit changes n grams at most, so labels that are near enough share one of the longer label's grams if it has more
    of them than the allowed edits touch; those meet over their rarest grams and by length, so a gram that all labels have pairs
    none of them unless they have no other. Labels too short to be sure of that
    meet by length alone, of which there are few distinct ones."""
    edits = lambda length: F.floor(length * (1.0 - least) + 1e-9).cast("int")
    own = lambda df, c: df.select(F.lower("label").alias(c)).where(f"{c} is not null").distinct()
    a, b = own(left, "l1"), own(right, "l2")
    sure = lambda c: F.length(c) - (n - 1) > n * edits(F.length(c))
    # of two labels that near each other the longer is sure, or both are short; they share all grams but n for each edit, so
    # of each one's grams in order of rarity, n for each edit that a longer partner may take and one more, at least one
    every = lambda df, c: df.select(c, F.explode(F.array_distinct(text.grams(F.col(c), n))).alias("g"))
    df = every(a, "l1").select("g").union(every(b, "l2").select("g")).groupBy("g").agg(F.count("*").alias("df"))

    def rarest(labels: DataFrame, c: str) -> DataFrame:
        most = n * edits(F.floor(F.length(c) / F.lit(max(least, 0.01)) + 1e-9)) + 1
        grams = every(labels, c).join(df, "g").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
        return grams.select(c, F.explode(F.slice("gs", F.lit(1), most)).alias("x")).select(c, "x.g")

    over = rarest(a, "l1").join(rarest(b, "l2"), "g").select("l1", "l2").distinct()
    longest = F.greatest(F.length("l1"), F.length("l2"))
    short_a, short_b = (df.where(~sure(c)).select(c, F.length(c).alias("n")) for df, c in ((a, "l1"), (b, "l2")))
    spread = short_a.withColumn("m", F.explode(F.sequence(F.floor(F.col("n") * least).cast("int"), F.ceil(F.col("n") / F.lit(max(least, 0.01))).cast("int"))))
    brief = spread.join(short_b.withColumnRenamed("n", "m"), "m").select("l1", "l2")
    mixed_ab = a.where(sure("l1")).select("l1", F.length("l1").alias("n")).withColumn("m", F.explode(F.sequence(F.floor(F.col("n") * least).cast("int"), F.ceil(F.col("n") / F.lit(max(least, 0.01))).cast("int")))).join(short_b.withColumnRenamed("n", "m"), "m").where(F.length("l2") > F.length("l1")).select("l1", "l2")
    mixed_ba = b.where(sure("l2")).select("l2", F.length("l2").alias("n")).withColumn("m", F.explode(F.sequence(F.floor(F.col("n") * least).cast("int"), F.ceil(F.col("n") / F.lit(max(least, 0.01))).cast("int")))).join(short_a.select("l1", F.col("n").alias("m")), "m").where(F.length("l1") > F.length("l2")).select("l1", "l2")
    pairs = over.union(brief).union(mixed_ab).union(mixed_ba).where(F.abs(F.length("l1") - F.length("l2")) <= edits(longest)).distinct()
    return pairs.withColumn("score", similarity.levenshtein_at_least(F.col("l1"), F.col("l2"), least)).where("score is not null")


def class_scores(source: DataFrame, target: DataFrame, label_scores: DataFrame) -> DataFrame:
    """(entity1, entity2, score): the best of label_scores (l1, l2, score; lower-case labels) over two classes' labels."""
    a, b = source.select(F.lower("label").alias("l1"), F.col("iri").alias("entity1")).distinct(), target.select(F.lower("label").alias("l2"), F.col("iri").alias("entity2")).distinct()
    return label_scores.join(a, "l1").join(b, "l2").groupBy("entity1", "entity2").agg(F.max("score").alias("score"))


def gram_pairs(left: DataFrame, right: DataFrame, n: int = 3) -> DataFrame:
    """(l1, l2, jaccard, dice, cosine) of distinct labels (column label) that share a gram of n characters."""
    own = lambda df, c: df.select(F.lower("label").alias(c)).where(f"{c} is not null").distinct().select(c, F.size(text.grams(F.col(c), n)).alias(f"n_{c}"), F.explode(text.grams(F.col(c), n)).alias("g"))
    both = own(left, "l1").join(own(right, "l2"), "g").groupBy("l1", "l2").agg(F.count("*").alias("both"), F.first("n_l1").alias("n1"), F.first("n_l2").alias("n2"))
    return both.select("l1", "l2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"), (2 * F.col("both") / (F.col("n1") + F.col("n2"))).alias("dice"), (F.col("both") / F.sqrt(F.col("n1") * F.col("n2"))).alias("cosine"))


def word_weights(labels: DataFrame) -> DataFrame:
    """(iri, token, n, v): a class's words over all its labels, how often it has them, and their weight ln(tf + 1) ln(idf)
    over the square root of the sum of such weights of the class's words with repeats; tf = 0.5 + 0.5 n / words of the
    class and idf = classes / classes with the word. A class all of whose words every class has weighs 0."""
    words = postings(labels).groupBy("iri", "token").agg(F.count("*").alias("n"))
    total = labels.select("iri").distinct().count()
    df = words.groupBy("token").agg((F.lit(float(total)) / F.count("*")).alias("idf"))
    by = Window.partitionBy("iri")
    raw = words.join(df, "token").withColumn("r", F.ln(0.5 + 0.5 * F.col("n") / F.sum("n").over(by) + 1) * F.ln("idf"))
    whole = F.sum(F.col("r") * F.col("n")).over(by)
    return raw.withColumn("v", F.when(whole > 0, F.col("r") / F.sqrt(whole)).otherwise(0.0)).select("iri", "token", "n", "v")


def soft_tfidf(source: DataFrame, target: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(entity1, entity2, score): the sum over a source class's words, repeats counted, of its weight, that of the target's
    most similar word, and their similarity. similar (w1, w2, score) tells like words of the two vocabularies, compared once
    each; without it words are like themselves alone. Scores may exceed 1."""
    a, b = word_weights(source), word_weights(target)
    a, b = a.select(F.col("iri").alias("entity1"), F.col("token").alias("w1"), "n", F.col("v").alias("v1")), b.select(F.col("iri").alias("entity2"), F.col("token").alias("w2"), F.col("v").alias("v2"))
    if similar is None:
        pairs = a.join(b.withColumnRenamed("w2", "w1"), "w1").withColumn("score", F.lit(1.0)).select("entity1", "entity2", "w1", "n", "v1", "v2", "score")
    else:
        pairs = a.join(similar, "w1").join(b, "w2").groupBy("entity1", "entity2", "w1", "n", "v1").agg(F.max(F.struct("score", "v2")).alias("best")).select("entity1", "entity2", "w1", "n", "v1", "best.v2", "best.score")
    return pairs.groupBy("entity1", "entity2").agg(F.sum(F.col("n") * F.col("v1") * F.col("v2") * F.col("score")).alias("score"))


def scored_candidates(source: DataFrame, target: DataFrame, candidates: DataFrame, similarity_of: Callable[[Column, Column], Column], pooling: str = "mean") -> DataFrame:
    """(entity1, entity2, score, exact) of candidates (entity1, entity2, rank): 1 where two labels are the same, else the
    mean or largest similarity over their labels. Of a class with candidates of the same label the first of those, by
    rank, suppresses all others, and only classes without one go to the similarity."""
    same = candidates.select("entity1", "entity2", "rank").join(exact_labels(source, target), ["entity1", "entity2"])
    first = same.groupBy("entity1").agg(F.min_by("entity2", F.struct("rank", "entity2")).alias("entity2")).select("entity1", "entity2", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    rest = candidates.join(first.select("entity1"), "entity1", "left_anti")
    pool = F.avg if pooling == "mean" else F.max
    scored = label_pairs(source, target, rest).groupBy("entity1", "entity2").agg(pool(similarity_of(F.lower("label1"), F.lower("label2"))).alias("score"))
    return first.union(scored.select("entity1", "entity2", "score", F.lit(False)))


def n_best(scored: DataFrame, k: int, least: float = 0.0, by: str = "entity1", other: str = "entity2") -> DataFrame:
    """The k best of each class that reach least, by number and not by text; ties go to the smaller IRI."""
    return top_k(scored.where(F.col("score") >= least), by, k, F.desc("score"), other)
