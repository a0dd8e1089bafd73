"""Words by their senses: a lexicon is a table senses (word, synset) and a taxonomy of synsets (child, parent), both given by
the caller, since none is shipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def like_words(words1: DataFrame, words2: DataFrame, senses: DataFrame, hypernyms: DataFrame, least: float = 0.95) -> DataFrame:
    """(w1, w2, score) of distinct words (word) whose Wu-Palmer similarity, the best over their senses, is least and more.

    Words meet at common ancestors only, and only at those that are deep enough: an ancestor of depth c of a sense of depth d
    gives 2c / (c + d) at most, so higher ones make no pair. That loses nothing and keeps the root from pairing all with all.
    Words that the lexicon lacks score 0 with every word, so they are in no pair; nulls likewise. Case is the caller's."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and 1 at most")
    known = senses.where("word is not null and synset is not null").select("word", F.col("synset").alias("node")).distinct()
    edges = hypernyms.select("child", "parent").where("child is not null and parent is not null")
    depth = graph.cut(graph.depths(edges, known.select("node")).select("node", (F.col("depth") + 1).alias("depth")))
    up = graph.closure(edges).select("node", "ancestor").union(depth.select("node", F.col("node").alias("ancestor")))
    high = up.join(depth, "node").join(depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("c")), "ancestor")
    high = graph.cut(high.where(2 * F.col("c") >= least * (F.col("c") + F.col("depth")) - 1e-9).select("node", "ancestor", "depth", "c"))

    def meeting(words: DataFrame, word: str, d: str) -> DataFrame:
        # of a word's senses below one ancestor the least deep one scores highest there
        own = words.select("word").distinct().join(known, "word").join(high, "node")
        return own.groupBy(F.col("word").alias(word), "ancestor", "c").agg(F.min("depth").alias(d))

    pairs = meeting(words1, "w1", "d1").join(meeting(words2, "w2", "d2"), ["ancestor", "c"])
    scored = pairs.groupBy("w1", "w2").agg(F.max(2 * F.col("c") / (F.col("d1") + F.col("d2"))).alias("score"))
    return scored.where(F.col("score") >= least - 1e-9)


def single_words(labels: DataFrame) -> DataFrame:
    """(iri, word) of the classes that have one label (iri, label), and that of one word, in lower case."""
    one = labels.where("label is not null").groupBy("iri").agg(F.count("*").alias("n"), F.lower(F.trim(F.min("label"))).alias("word"))
    return one.where("n = 1 and word <> ''").where(~F.col("word").rlike(r"\s")).select("iri", "word")


def semantic_matcher(senses: DataFrame, hypernyms: DataFrame, least: float = 0.95) -> Callable:
    """A matcher (source, target) -> (entity1, entity2, score) of classes named by one word each, whose words are alike in
    the lexicon; for the semantic side of matchers.meta_matcher()."""

    def match(source, target) -> DataFrame:
        a, b = graph.cut(single_words(source.labels)), graph.cut(single_words(target.labels))
        like = like_words(a, b, senses, hypernyms, least)
        return a.toDF("entity1", "w1").join(like, "w1").join(b.toDF("entity2", "w2"), "w2").select("entity1", "entity2", "score")

    return match
