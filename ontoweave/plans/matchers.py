"""Whole matchers: each takes two ontologies and gives (entity1, entity2, measure)."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import words
from ..operators import blocking, corpus, evaluate, graph, select
from ..sources.ontology import Ontology

PAIR = ["entity1", "entity2"]


class Matcher(Protocol):
    """What runs and compares matchers needs of one."""

    def __call__(self, source: Ontology, target: Ontology) -> DataFrame: ...


def _measured(scored: DataFrame) -> DataFrame:
    return scored.select(*PAIR, F.least(F.col("score").cast("double"), F.lit(1.0)).alias("measure"))


def exact_matcher(source: Ontology, target: Ontology) -> DataFrame:
    """Classes that share a label without case."""
    return blocking.exact_labels(source.labels, target.labels).withColumn("measure", F.lit(1.0))


def meta_matcher(source: Ontology, target: Ontology, least: float = 0.9, strict: float = 0.95, semantic: Callable[[Ontology, Ontology], DataFrame] | None = None) -> DataFrame:
    """Classes whose labels are alike by characters, combined with a semantic matcher's pairs (default: equal words in any
    order) by the rules of select.rule_combination()."""
    near = blocking.near_labels(source.labels, target.labels, least)
    lexical = blocking.class_scores(source.labels, target.labels, near)
    if semantic is None:
        bag = lambda o, c: o.labels.select(F.col("iri").alias(c), F.array_join(F.array_sort(words(F.col("label"))), " ").alias("k")).where("k <> ''").distinct()
        other = bag(source, "entity1").join(bag(target, "entity2"), "k").select(*PAIR, F.lit(1.0).alias("score")).distinct()
    else:
        other = semantic(source, target)
    # the rules read both several times
    return _measured(select.rule_combination(graph.cut(lexical), graph.cut(other), strict))


def structural_scores(source: Ontology, target: Ontology, near: float = 0.9) -> DataFrame:
    """(entity1, entity2, score): soft TF-IDF over like words, raised by the best scores of parents and children."""
    vocabulary = lambda o: blocking.postings(o.labels).select(F.col("token").alias("label")).distinct()
    like = blocking.near_labels(vocabulary(source), vocabulary(target), near).select(F.col("l1").alias("w1"), F.col("l2").alias("w2"), "score")
    lexical = graph.cut(blocking.soft_tfidf(source.labels, target.labels, like))
    scored = graph.structural_scores(lexical, source.edges, target.edges)
    return scored.select(*PAIR, similarity.structural(F.col("score"), F.col("above"), F.col("below")).alias("score"))


def structural_matcher(source: Ontology, target: Ontology, least: float = 1.0, solve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The pairs that a selection (default: all of least, or the best one, and then of least) takes from structural_scores()."""
    scored = structural_scores(source, target)
    chosen = solve(scored) if solve else select.all_or_best(scored, least)
    return _measured(select.at_least(chosen, least))


def annealed(scored: DataFrame, least: float, steps: int = 100, inner: int = 100, cooling: float = 0.998, share: float = 0.05, seed: int = 0, most: int = 200_000) -> DataFrame:
    """An assignment of one target to each source by simulated annealing from the greedy one: each step swaps the targets of
    a share of the sources and is accepted if it gains, or by chance exp(gain / temperature). The search's state is the
    driver's, so it takes most candidate pairs of least at most; more are an error, and select.all_or_best() the answer."""
    spark = scored.sparkSession
    rows = select.at_least(scored, least).select(*PAIR, "score").orderBy("entity1", F.desc("score"), "entity2").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} candidate pairs: too many to anneal on the driver")
    score = {(r[0], r[1]): float(r[2]) for r in rows}
    now: dict[str, str] = {}
    for a, b in score:
        now.setdefault(a, b)
    keys, r, heat = sorted(now), np.random.default_rng(seed), 1.0
    value = lambda s: sum(score.get((a, s[a]), 0.0) for a in s)
    best, top, total = dict(now), value(now), value(now)
    for _ in range(steps if len(keys) > 1 else 0):
        for _ in range(inner):
            turned = dict(now)
            for _ in range(max(1, int(len(keys) * share))):
                i, j = r.choice(len(keys), 2, replace=False)
                turned[keys[i]], turned[keys[j]] = turned[keys[j]], turned[keys[i]]
            gain = sum(score.get((a, turned[a]), 0.0) - score.get((a, now[a]), 0.0) for a in keys if turned[a] != now[a])
            if gain >= 0 or r.random() < math.exp(gain / heat):
                now, total = turned, total + gain
                if total > top:
                    best, top = dict(now), total
        heat *= cooling
    found = [(a, b, score[a, b]) for a, b in sorted(best.items()) if (a, b) in score]
    return spark.createDataFrame(found, "entity1 string, entity2 string, score double")


# ---- searched weights -----------------------------------------------------------------------------------------------
def measures(source: Ontology, target: Ontology, names: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """(entity1, entity2, id_<name>, label_<name>...): each measure on the tails of the IRIs, and its best over the labels,
    of candidates (default: pairs that share a gram of three characters)."""
    if candidates is None:
        near = blocking.gram_pairs(source.labels, target.labels).where("jaccard >= 0.2")
        candidates = blocking.class_scores(source.labels, target.labels, near.select("l1", "l2", F.col("jaccard").alias("score"))).select(*PAIR)
    tail = lambda c: F.lower(F.regexp_extract(c, r"([^#/]*)$", 1))
    ids = candidates.select(*PAIR, *[similarity.REGISTRY[n](tail("entity1"), tail("entity2")).alias(f"id_{n}") for n in names])
    labels = blocking.label_pairs(source.labels, target.labels, candidates).groupBy(*PAIR).agg(*[F.max(similarity.REGISTRY[n](F.lower("label1"), F.lower("label2"))).alias(f"label_{n}") for n in names])
    return ids.join(labels, PAIR)


def weighted(scores: DataFrame, names: list[str], genes: Column) -> Column:
    """The two-stage score of weights, and the two thresholds after them, in an array column."""
    at = lambda i: F.element_at(genes, i + 1)
    total = sum((at(i) for i in range(len(names))), F.lit(0.0))
    part = lambda kind: F.when(total > 0, sum((at(i) * F.col(f"{kind}_{n}") for i, n in enumerate(names)), F.lit(0.0)) / total).otherwise(0.0)
    return similarity.two_stage(part("id"), part("label"), at(len(names)), at(len(names) + 1))


def _scores_of(names: list[str], population: list[list[float]]) -> Callable:
    """weighted() of a batch of pairs as an array, a row per pair and a column per individual."""
    genes = np.array(population, dtype=float)
    weights, t1, t2 = genes[:, : len(names)], genes[:, len(names)], genes[:, len(names) + 1]
    total = weights.sum(axis=1)
    shares = np.where(total > 0, 1 / np.where(total > 0, total, 1.0), 0.0)[:, None] * weights

    def score(rows) -> np.ndarray:
        # sums one by one: a matrix product may round a pair otherwise in another batch, and equal scores must stay equal
        part = lambda kind: sum(rows[f"{kind}_{n}"].to_numpy(dtype=float)[:, None] * shares[:, i] for i, n in enumerate(names))
        return similarity.two_stage_array(part("id"), part("label"), t1, t2)

    return score


def fitness(scores: DataFrame, names: list[str], population: list[list[float]], size1: int, size2: int) -> list[float]:
    """The pseudo F1 of each individual: one job scores the whole population. A pair stays one row: its scores under all
    individuals are made twice, a batch at a time, first for the batch's greatest of each class, which are what is shuffled,
    and then to be compared with the greatest of all batches."""
    score, count = _scores_of(names, population), len(population)

    def maxima(batches):
        import pandas as pd

        for rows in batches:
            s = score(rows)
            for side in ("entity1", "entity2"):
                keys, at = np.unique(rows[side].to_numpy(dtype=str), return_inverse=True)
                top = np.full((len(keys), count), -1.0)
                np.maximum.at(top, at, s)
                yield pd.DataFrame({"side": side, "entity": keys, "top": list(top)})

    def mutual(batches):
        import pandas as pd

        for rows in batches:
            s = score(rows)
            hit = (s > 0) & (s == np.stack(rows["row"].to_numpy())) & (s == np.stack(rows["col"].to_numpy()))
            pair, who = np.nonzero(hit)
            yield pd.DataFrame({"who": who.astype("int32"), "entity1": rows["entity1"].to_numpy()[pair], "score": s[pair, who]}).drop_duplicates(["who", "entity1"])

    tops = scores.mapInPandas(maxima, "side string, entity string, top array<double>").select("side", "entity", F.posexplode("top").alias("who", "score")).groupBy("side", "entity", "who").agg(F.max("score").alias("score"))
    tops = graph.cut(tops.groupBy("side", "entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("who", "score"))), lambda x: x["score"]).alias("top")))
    of = lambda side, name: tops.where(F.col("side") == side).select(F.col("entity").alias(side), F.col("top").alias(name))
    found = scores.join(of("entity1", "row"), "entity1").join(of("entity2", "col"), "entity2").mapInPandas(mutual, "who int, entity1 string, score double")
    best = found.groupBy("who", "entity1").agg(F.max("score").alias("score"))
    sums = {r["who"]: (r["n"], r["c"]) for r in best.groupBy("who").agg(F.count("*").alias("n"), F.sum("score").alias("c")).collect()}
    out = []
    for i in range(count):
        n, c = sums.get(i, (0, 0.0))
        r, p = n / max(min(size1, size2), 1), c / n if n else 0.0
        out.append(2 * r * p / (r + p) if r + p > 0 else 0.0)
    return out


def evolve(score_of: Callable[[list[list[float]]], list[float]], genes: int, size: int = 100, generations: int = 10, cross: float = 0.5, mutate: float = 0.01, spread: float = 10.0, seed: int = 123) -> tuple[list[float], list[float]]:
    """(best individual, best fitness of each generation). Individuals survive by fitness ** exp(-(age of the search) /
    spread), mate gene by gene in turn, mutate within [0, 1], and the best is always kept. None is scored twice."""
    r = np.random.default_rng(seed)
    known: dict[tuple[float, ...], float] = {}

    def fitness_of(rows: np.ndarray) -> np.ndarray:
        new = [list(k) for k in dict.fromkeys(map(tuple, rows.tolist())) if k not in known]
        if new:
            known.update(zip(map(tuple, new), score_of(new)))
        return np.array([known[k] for k in map(tuple, rows.tolist())])

    people = r.random((size, genes))
    fit = fitness_of(people)
    history = [float(fit.max())]
    for g in range(1, generations):
        keep = r.random(size) < np.power(np.maximum(fit, 1e-9), math.exp(-g / max(generations / spread, 1e-9)))
        keep[fit.argmax()] = True
        parents = people[keep]
        children = []
        while len(children) < size - 1:
            a, b = parents[r.integers(len(parents))], parents[r.integers(len(parents))]
            child = np.where(np.arange(genes) % 2 == 0, a, b) if r.random() < cross else a.copy()
            hit = r.random(genes) < mutate
            child[hit] = r.random(int(hit.sum()))
            children.append(child)
        people = np.array([people[fit.argmax()], *children])
        fit = fitness_of(people)
        history.append(float(fit.max()))
    return people[fit.argmax()].tolist(), history


def evolutionary_matcher(source: Ontology, target: Ontology, names: tuple[str, ...] = ("levenshtein", "gram_jaccard"), least: float = 0.9, size: int = 100, generations: int = 10, seed: int = 123) -> DataFrame:
    """The best target of each class of the smaller ontology under the weights that evolve() finds."""
    names = list(names)
    scores = graph.cut(measures(source, target, names))
    n, m = source.classes.count(), target.classes.count()
    best, _ = evolve(lambda people: fitness(scores, names, people, n, m), len(names) + 2, size, generations, seed=seed)
    scored = scores.withColumn("score", weighted(scores, names, F.array(*[F.lit(float(g)) for g in best]))).select(*PAIR, "score")
    by, other = ("entity1", "entity2") if n <= m else ("entity2", "entity1")
    return _measured(select.best_per(scored, by, other, least))


# ---- learned scores -------------------------------------------------------------------------------------------------
FEATURES = ("levenshtein", "gram_jaccard", "shingle_cosine")


def features(pairs: DataFrame, a: str = "l1", b: str = "l2") -> DataFrame:
    """pairs with a vector of the similarities of two label columns."""
    from pyspark.ml.feature import VectorAssembler

    named = pairs.withColumns({f"_f_{n}": similarity.REGISTRY[n](F.col(a), F.col(b)) for n in FEATURES})
    return VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="features").transform(named).drop(*[f"_f_{n}" for n in FEATURES])


def train_scorer(labelled: DataFrame, kind: str = "logistic", seed: int = 0):
    """A fitted model of labelled pairs of labels (l1, l2, label): logistic regression, or a perceptron with a hidden layer."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    rows = features(labelled.withColumn("label", F.col("label").cast("double")))
    model = LogisticRegression(maxIter=50, regParam=0.01) if kind == "logistic" else MultilayerPerceptronClassifier(layers=[len(FEATURES), 8, 2], seed=seed, maxIter=50)
    return model.fit(rows)


def probability(model, pairs: DataFrame, a: str = "l1", b: str = "l2") -> DataFrame:
    """pairs with score, the probability that they are the same."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(features(pairs, a, b)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def learned_matcher(source: Ontology, target: Ontology, k: int = 25, n_best: int = 1, least: float = 0.8, pooling: str = "mean", rounds: int = 1, seed: int = 0, kind: str = "logistic") -> DataFrame:
    """Unsupervised: a scorer learns from the ontologies' own synonyms, identities and negatives; candidates by shared tokens
    go both ways through it, equal labels at once; the n best of each class, extended along the hierarchy, lose conflicts on
    root paths."""
    labelled = corpus.merged_corpus(source.labels, target.labels, siblings=graph.siblings(source.edges).select("c1", "c2"), seed=seed)
    model = train_scorer(graph.cut(labelled), kind, seed)
    pool = F.avg if pooling == "mean" else F.max

    def one_way(a: Ontology, b: Ontology) -> DataFrame:
        found = blocking.idf_candidates(a.labels, b.labels, k)
        same = blocking.scored_candidates(a.labels, b.labels, found, similarity.exact).where("exact").select(*PAIR, "score")
        rest = found.join(same.select("entity1"), "entity1", "left_anti")
        pairs = blocking.label_pairs(a.labels, b.labels, rest).withColumns({"l1": F.lower("label1"), "l2": F.lower("label2")})
        scored = probability(model, pairs).groupBy(*PAIR).agg(pool("score").alias("score"))
        return blocking.n_best(same.union(scored.select(*PAIR, "score")), n_best).select(*PAIR, "score")

    mapped = select.both_directions(one_way(source, target), one_way(target, source))
    score = lambda new: probability(model, blocking.label_pairs(source.labels, target.labels, new).withColumns({"l1": F.lower("label1"), "l2": F.lower("label2")})).groupBy(*PAIR).agg(pool("score").alias("score"))
    grown = graph.extend(mapped, source.edges, target.edges, score, rounds=rounds)
    return _measured(graph.path_conflicts(select.at_least(grown, least), source.edges))


def path_vectors(paths: DataFrame, names: DataFrame, size: int = 32, seed: int = 0) -> DataFrame:
    """(node, vec): the mean word vector of the names (node, name) along each root path (node, path), from Word2Vec on those
    paths."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    each = paths.select("node", F.posexplode("path").alias("i", "at")).join(names.withColumnRenamed("node", "at"), "at")
    texts = each.groupBy("node").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", words(F.col("name")).alias("w")))), lambda x: x["w"])).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=1, seed=seed, inputCol="words", outputCol="v").fit(texts)
    return model.transform(texts).select("node", vector_to_array("v").alias("vec"))


def best_model(candidates: dict[str, Callable[[DataFrame], DataFrame]], validation: DataFrame) -> tuple[str, float, float]:
    """(name, threshold, f1) of the candidate whose scores of validation rows (truth: boolean) sweep to the highest F1."""
    found = []
    for name, scorer in candidates.items():
        top = evaluate.best_threshold(evaluate.sweep(scorer(validation))).first()
        found.append((top["f1"], name, top["threshold"]))
    f1, name, threshold = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    return name, threshold, f1


def ensemble(anchors: DataFrame, predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """Predictions that don't conflict on a root path, and the anchors that they lack."""
    return select.with_anchors(graph.path_conflicts(predictions, edges), anchors)
