import pytest

from ontoweave.plans import matchers
from ontoweave.sources.ontology import Ontology


@pytest.fixture(scope="module")
def pair(spark):
    def made(p, labels, edges):
        ls = spark.createDataFrame([(f"{p}{i}", j, x) for i, xs in labels.items() for j, x in enumerate(xs)], "iri string, pos int, label string")
        es = spark.createDataFrame([(f"{p}{a}", f"{p}{b}") for a, b in edges], "child string, parent string")
        return Ontology(ls.select("iri").distinct(), ls, es)

    a = {0: ["software"], 1: ["software testing", "program tests"], 2: ["requirements analysis"], 3: ["graph theory"], 4: ["static analysis"]}
    b = {0: ["Software"], 1: ["software tests"], 2: ["requirement analysis"], 3: ["theory graph"], 5: ["weather"]}
    return made("s", a, [(1, 0), (2, 0), (4, 1)]), made("t", b, [(1, 0), (2, 0), (5, 0)])


def found(df):
    return {(r["entity1"], r["entity2"]) for r in df.collect()}


def test_matchers(pair):
    s, t = pair
    exact = found(matchers.exact_matcher(s, t))
    assert exact == {("s0", "t0")}
    assert exact | {("s2", "t2")} <= found(matchers.meta_matcher(s, t, 0.9, 0.9))
    structural = matchers.structural_matcher(s, t, 0.6)
    assert exact <= found(structural) and all(r["measure"] <= 1 for r in structural.collect())
    assert exact <= found(matchers.evolutionary_matcher(s, t, size=6, generations=2, least=0.7))


def test_meta_matcher_over_a_lexicon(spark):
    from ontoweave.operators import lexicon

    made = lambda p, labels: Ontology(None, spark.createDataFrame([(f"{p}{i}", 0, x) for i, x in enumerate(labels)], "iri string, pos int, label string"), None)
    senses = spark.createDataFrame([("car", "auto.n"), ("automobile", "auto.n"), ("bike", "bike.n")], "word string, synset string")
    hypernyms = spark.createDataFrame([("auto.n", "vehicle.n"), ("bike.n", "vehicle.n")], "child string, parent string")
    got = matchers.meta_matcher(made("s", ["Car", "bike"]), made("t", ["automobile", "unknown"]), semantic=lexicon.semantic_matcher(senses, hypernyms))
    assert ("s0", "t0") in found(got) and ("s0", "t0") not in found(matchers.meta_matcher(made("s", ["Car"]), made("t", ["automobile"])))
    assert found(lexicon.semantic_matcher(senses, hypernyms)(made("s", ["Car", "bike"]), made("t", ["automobile", "unknown"]))) == {("s0", "t0")}


def test_annealing_keeps_a_matching(spark, pair):
    rows = [(f"a{i}", f"b{j}", 1.0 if i == j else 0.6) for i in range(5) for j in range(5)]
    got = matchers.annealed(spark.createDataFrame(rows, "entity1 string, entity2 string, score double"), 0.5, steps=10, inner=10)
    assert found(got) == {(f"a{i}", f"b{i}") for i in range(5)}
    with pytest.raises(ValueError):
        matchers.annealed(spark.createDataFrame(rows, "entity1 string, entity2 string, score double"), 0.5, most=3)


def test_evolution_never_loses_its_best():
    best, history = matchers.evolve(lambda people: [1 - abs(p[0] - 0.7) for p in people], 3, size=20, generations=6)
    assert history == sorted(history) and abs(best[0] - 0.7) < 0.2


def test_fitness_against_brute_force(spark):
    import random

    r = random.Random(4)
    names = ["levenshtein", "gram_jaccard"]
    kinds = [f"{k}_{n}" for k in ("id", "label") for n in names]
    rows = [(f"a{i}", f"b{j}", *[r.choice([0.0, 0.25, 0.5, 0.9, 1.0, None]) for _ in kinds]) for i in range(12) for j in range(9) if r.random() < 0.7]
    people = [[r.choice([0.0, r.random()]) for _ in range(4)] for _ in range(12)] + [[0.0] * 4]

    def f1(g):
        part = lambda row, at: 0.0 if sum(g[:2]) == 0 else None if None in row[at : at + 2] else (g[0] * row[at] + g[1] * row[at + 1]) / sum(g[:2])
        score = {}
        for row in rows:
            a, b = part(row, 2), part(row, 4)
            score[row[0], row[1]] = round(a if a is not None and a >= g[2] else b if b is not None and b >= g[3] else 0.0, 12)
        top = lambda at, key: max(v for k, v in score.items() if k[at] == key)
        best = {k[0]: v for k, v in score.items() if v > 0 and v == top(0, k[0]) == top(1, k[1])}
        n, c = len(best), sum(best.values())
        recall, precision = n / 9, c / n if n else 0.0
        return 2 * recall * precision / (recall + precision) if recall + precision > 0 else 0.0

    scores = spark.createDataFrame(rows, "entity1 string, entity2 string, " + ", ".join(f"{k} double" for k in kinds)).repartition(3)
    got = matchers.fitness(scores, names, people, 12, 9)
    assert got == pytest.approx([f1(g) for g in people])
    assert len(set(got)) > 5


def test_learned(pair):
    s, t = pair
    got = matchers.learned_matcher(s, t, k=5, least=0.3)
    assert ("s0", "t0") in found(got)


def test_best_model(spark):
    rows = spark.createDataFrame([(0.1, False), (0.9, True)], "x double, truth boolean")
    name, threshold, f1 = matchers.best_model({"good": lambda df: df.withColumnRenamed("x", "score"), "bad": lambda df: df.selectExpr("1 - x as score", "truth")}, rows)
    assert (name, f1) == ("good", 1.0) and 0.1 < threshold <= 0.9
