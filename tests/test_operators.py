import random

import pytest
from pyspark.sql import functions as F

from ontoweave.operators import blocking, corpus, evaluate, graph, select


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_near_labels_lose_nothing(spark, least):
    r = random.Random(int(least * 100))
    words = ["".join(r.choice("abé") for _ in range(r.randint(0, 12))) for _ in range(120)]
    words += ["".join(w[:i] + "x" + w[i + 1 :]) for w in words for i in [r.randrange(len(w) or 1)] if w]
    a, b = words[::2], words[1::2]
    df = lambda ws: spark.createDataFrame([(w,) for w in ws] + [(None,)], "label string")
    got = {(x["l1"], x["l2"]): x["score"] for x in blocking.near_labels(df(a), df(b), least).collect()}
    want = {}
    for x in set(a):
        for y in set(b):
            n = max(len(x), len(y))
            s = 1.0 if n == 0 else 1 - edit(x, y) / n
            if s >= least - 1e-12:
                want[x, y] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_exact_is_the_top_of_near(spark):
    s = spark.createDataFrame([("a", 0, "One Two"), ("b", 0, "three"), ("b", 1, "Drei")], "iri string, pos int, label string")
    t = spark.createDataFrame([("x", 0, "one two"), ("y", 0, "THREE"), ("z", 0, "treee")], "iri string, pos int, label string")
    exact = {tuple(r) for r in blocking.exact_labels(s, t).collect()}
    near = blocking.class_scores(s, t, blocking.near_labels(s, t, 0.6))
    assert exact == {("a", "x"), ("b", "y")} == {(r[0], r[1]) for r in near.where("score = 1").collect()}
    assert ("b", "z") in {(r[0], r[1]) for r in near.collect()}


def scored(spark, rows):
    return spark.createDataFrame(rows, "entity1 string, entity2 string, score double")


def test_selection(spark):
    s = scored(spark, [("a", "x", 0.9), ("a", "y", 0.9), ("b", "x", 0.9), ("b", "z", 0.5), ("c", "z", 0.0), ("d", "w", 0.3)])
    key = lambda df: sorted((r["entity1"], r["entity2"]) for r in df.collect())
    assert key(select.mutual_best(s)) == [("a", "x"), ("b", "x"), ("d", "w")]
    assert key(select.best_per(s)) == [("a", "x"), ("b", "x"), ("c", "z"), ("d", "w")]
    assert key(select.all_or_best(s, 0.8)) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("d", "w")]
    assert set(key(select.mutual_best(s))) <= set(key(select.all_or_best(s, 0.8)))
    assert key(select.at_least(s, 0.9, strict=True)) == []
    a, b = s.where("entity1 = 'a'"), s.where("entity2 = 'x'")
    assert sorted(key(select.intersection(s, b)) + key(select.difference(s, b))) == key(s)
    assert key(select.union_distinct(a, b)) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert {r["score"] for r in select.merged(a, scored(spark, [("a", "x", 0.1)])).where("entity2 = 'x'").collect()} == {0.1}
    assert key(select.uncovered(s, a)) == [("b", "x"), ("b", "z"), ("c", "z"), ("d", "w")]
    m = select.pseudo_metrics(scored(spark, []), 3, 4).first()
    assert (m["n"], m["precision"], m["f1"]) == (0, 0, 0)


def test_metrics(spark):
    p = spark.createDataFrame([("m", "a", "x"), ("m", "a", "x"), ("m", "b", "y"), ("k", "c", "z")], "matcher string, entity1 string, entity2 string")
    g = spark.createDataFrame([("a", "x"), ("c", "q")], "entity1 string, entity2 string")
    names = spark.createDataFrame([("m",), ("k",), ("none",)], "matcher string")
    got = {r["matcher"]: r.asDict() for r in evaluate.metrics(p, g, names).collect()}
    assert (got["m"]["n_tp"], got["m"]["n_fp"], got["m"]["n_gold"]) == (2, 1, 2) and got["none"]["precision"] == 0 and got["k"]["f1"] == 0
    assert evaluate.true_positives(p, g).count() + evaluate.false_positives(p, g).count() == p.count()
    wide = evaluate.side_by_side(p, g, ["m", "k"]).collect()
    assert {(r["entity1"], r["is_correct"], r["m"], r["k"]) for r in wide} == {("a", True, True, False), ("b", False, True, False), ("c", False, False, True), ("c", True, False, False)}
    rows = spark.createDataFrame([(0.1, False), (0.5, True), (0.9, True), (0.7, False)], "score double, truth boolean")
    best = evaluate.best_threshold(evaluate.sweep(rows)).first()
    assert best["threshold"] == pytest.approx(0.12) and best["f1"] == pytest.approx(0.8)
    assert evaluate.point_metrics(rows, 0.6).first()["accuracy"] == 0.5


def test_graphs(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x")], "child string, parent string")
    up = {(r["node"], r["ancestor"]): (r["near"], r["far"]) for r in graph.closure(e).collect()}
    assert up["d", "a"] == (2, 3) and up["c", "a"] == (1, 2) and ("x", "y") in up
    assert {r["node"]: r["depth"] for r in graph.depths(e).collect()}["d"] == 3
    assert {r["node"]: r["depth"] for r in graph.depths(e, longest=False).collect()}["d"] == 2
    assert {r["node"]: r["path"] for r in graph.root_paths(e).collect()}["d"] == ["d", "c", "a"]
    assert {r["node"] for r in graph.descendants(e, spark.createDataFrame([("b",)], "node string")).collect()} == {"b", "c", "d"}
    rows = spark.createDataFrame([("g", i, d) for i, d in enumerate([0, 1, 3, 2, 2, 1, 0, 1])], "g string, o int, d int")
    assert [r["parent_order"] for r in graph.outline_parents(rows, "g", "o", "d").orderBy("o").collect()] == [None, 0, 1, 1, 1, 0, None, 6]
    wp = {(r["a"], r["b"]): r["score"] for r in graph.wu_palmer(e, spark.createDataFrame([("b", "c"), ("d", "x")], "a string, b string")).collect()}
    assert wp["b", "c"] == pytest.approx(2 * 2 / (2 + 3)) and wp["d", "x"] == 0


def test_extension_and_conflicts(spark):
    e1 = spark.createDataFrame([("b", "a"), ("c", "b")], "child string, parent string")
    e2 = spark.createDataFrame([("y", "x"), ("z", "y")], "child string, parent string")
    grown = graph.extend(scored(spark, [("b", "y", 1.0)]), e1, e2, lambda p: p.withColumn("score", F.lit(0.95)), rounds=3)
    assert {tuple(r)[:2] for r in grown.collect()} == {("b", "y"), ("a", "x"), ("c", "z")}
    kept = graph.path_conflicts(scored(spark, [("a", "q", 0.5), ("c", "q", 0.9), ("b", "q", 0.9), ("b", "r", 0.1)]), e1)
    assert {tuple(r)[:2] for r in kept.collect()} == {("c", "q"), ("b", "q"), ("b", "r")}


def most_in_a_task(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_all_pairs_by_kinds(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 4, raising=False)
    monkeypatch.setattr(graph, "TASK_PAIRS", 40, raising=False)
    up = {"b": "a", "c": "ab", "d": "c", "e": "c", "f": "bc", "p": "q", "x": "y", "y": "xz"} | {f"l{i}": "cb"[i % 2] for i in range(30)}
    e = spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps] + [("n", None), (None, "a")], "child string, parent string")
    nodes = sorted(set(up) | set("aqzn"))
    rows = {(r["node"], r["ancestor"]): r["far"] for r in graph.closure(e).collect()}
    above = {n: {a for m, a in rows if m == n} | {n} for n in nodes}
    depth = {r["node"]: r["depth"] + 1 for r in graph.depths(e).collect()}
    want = {(a, b): 2 * max((depth[c] for c in above[a] & above[b]), default=0) / (depth[a] + depth[b]) for a in nodes for b in nodes if a < b}
    for most in (1_000_000, 0):  # broadcast, and shuffled
        monkeypatch.setattr(graph, "BROADCAST_MEMBERS", most, raising=False)
        got = graph.wu_palmer(e)
        assert got.count() == len(want) and {(r["a"], r["b"]): r["score"] for r in got.collect()} == pytest.approx(want)
    some = spark.createDataFrame([("l1", "l1"), ("l3", "l1"), ("l1", "a"), ("l1", "a")], "a string, b string")
    assert sorted(tuple(r) for r in graph.wu_palmer(e, some).collect()) == [("l1", "a", pytest.approx(want["a", "l1"])), ("l1", "a", pytest.approx(want["a", "l1"])), ("l1", "l1", 1.0), ("l3", "l1", pytest.approx(want["l1", "l3"]))]


def test_expansion_is_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 8, raising=False)
    monkeypatch.setattr(graph, "TASK_PAIRS", 400, raising=False)
    e1 = [(f"a{i}", "p") for i in range(60)] + [("a1", "q"), ("a2", "q"), ("p", "r"), ("q", "r"), (None, "p"), ("r", None)]
    e2 = [(f"b{i}", "P") for i in range(60)] + [("b1", "Q"), ("P", "R"), ("Q", "R"), (None, "Q"), ("p", "P")]
    pairs = [("p", "P"), ("q", "Q"), ("a1", "b1"), ("a1", "b7"), ("r", "R"), ("a1", "b1")]
    want = {(p, q) for a, b in pairs for c, p in e1 if c == a for d, q in e2 if d == b} | {(c, d) for a, b in pairs for c, p in e1 if p == a for d, q in e2 if q == b}
    tables = [spark.createDataFrame(r, t) for r, t in ((pairs, "entity1 string, entity2 string"), (e1, "child string, parent string"), (e2, "child string, parent string"))]
    for most in (1_000_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_MEMBERS", most, raising=False)
        got = graph.expanded(*tables)
        assert got.count() == len(want - set(pairs)) and {tuple(r) for r in got.collect()} == want - set(pairs)
        assert most_in_a_task(got) < 0.2


def test_corpus(spark):
    labels = spark.createDataFrame([("a", "One"), ("a", "uno"), ("b", "two"), ("c", "three")], "iri string, label string")
    sib = spark.createDataFrame([("b", "c")], "c1 string, c2 string")
    got = corpus.merged_corpus(labels, siblings=sib, n_soft=3, seed=1).collect()
    kinds = {k: {(r["l1"], r["l2"]) for r in got if r["kind"] == k} for k in ("identity", "synonym", "soft", "hard")}
    assert kinds["synonym"] == {("one", "uno"), ("uno", "one")} and len(kinds["identity"]) == 4
    assert kinds["hard"] == {("two", "three"), ("three", "two")} and not kinds["soft"] & (kinds["synonym"] | kinds["identity"])
    many = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    train, valid = corpus.split(many, 0.2, 3, "k")
    assert train.count() + valid.count() == 2000 and 330 < valid.count() < 470
    assert corpus.sample(many, 10, 1, "k").collect() == corpus.sample(many, 10, 1, "k").collect()
    drawn = [r[0] for r in many.select(corpus.other_than(5, F.lit(2), 0, "k")).collect()]
    assert set(drawn) == {0, 1, 3, 4}


def test_deep_chains(spark):
    e = spark.createDataFrame([(f"n{i + 1:03}", f"n{i:03}") for i in range(66)], "child string, parent string").coalesce(1)
    assert {r["node"]: (r["near"], r["far"]) for r in graph.closure(e).where("ancestor = 'n000'").collect()} == {f"n{i:03}": (i, i) for i in range(1, 67)}


def test_cycles_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "child string, parent string"))


def test_near_labels_against_brute_force(spark):
    import random

    from ontoweave.operators import blocking

    r = random.Random(3)
    lev = lambda x, y: lev_rows(x, y)

    def lev_rows(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    left = sorted({f"the {word()} {word()}"[r.randint(0, 4) :] for _ in range(60)} | {"a", "ab"})
    right = sorted({x.replace("a", "b", r.randint(0, 1)) for x in left} | {f"the {word()}" for _ in range(40)})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "label string")
    for least in (0.6, 0.7, 0.85):
        got = {(x["l1"], x["l2"]) for x in blocking.near_labels(frame(left), frame(right), least).collect()}
        assert got == {(x, y) for x in left for y in right if 1 - lev(x, y) / max(len(x), len(y)) >= least - 1e-12}


def test_a_word_of_all_labels_pairs_few(spark):
    from ontoweave.operators import blocking

    names = [f"{a}{b}{c}" for a in "kmpr" for b in "aeiou" for c in "ltsxz"]
    source = spark.createDataFrame([(f"s{i}", f"the {x} {x}u") for i, x in enumerate(names)] + [("s", "the")], "iri string, label string")
    target = spark.createDataFrame([(f"t{i}", f"the {x}") for i, x in enumerate(names)] + [("t", "the the")], "iri string, label string")
    key = lambda df: sorted((x["entity1"], x["entity2"], round(x["score"], 9), x["rank"]) for x in df.collect())
    want = key(blocking.idf_candidates(source, target, 1))
    assert key(blocking.idf_candidates(source, target, 1, common=50)) == want
    assert key(blocking.idf_candidates(source, target, 3, common=50)) == key(blocking.idf_candidates(source, target, 3))


def test_words_by_senses_against_brute_force(spark):
    import itertools
    import random

    from ontoweave.operators import lexicon

    r = random.Random(7)
    parent = {i: r.randrange(i) for i in range(1, 40)}

    def up(i):
        return [i] + (up(parent[i]) if i in parent else [])

    senses = {f"w{i}": {r.randrange(40) for _ in range(r.choice([1, 1, 3]))} for i in range(30)}
    score = lambda a, b: 2 * max(len(up(c)) for c in set(up(a)) & set(up(b))) / (len(up(a)) + len(up(b)))
    best = lambda v, w: max(score(a, b) for a, b in itertools.product(senses[v], senses[w]))
    table = spark.createDataFrame([(w, f"n{s}") for w, ss in senses.items() for s in ss] + [(None, "n1"), ("lost", None)], "word string, synset string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in parent.items()], "child string, parent string")
    words = spark.createDataFrame([(w,) for w in [*senses, "unknown", None, "w0"]], "word string")
    for least in (0.3, 0.8, 1.0):
        got = {(x["w1"], x["w2"]): round(x["score"], 9) for x in lexicon.like_words(words, words, table, edges, least).collect()}
        assert got == {(v, w): round(best(v, w), 9) for v in senses for w in senses if best(v, w) >= least}


def test_single_words(spark):
    from ontoweave.operators import lexicon

    labels = spark.createDataFrame([("a", " Car "), ("b", "fast car"), ("c", "car"), ("c", "auto"), ("d", ""), ("e", None)], "iri string, label string")
    assert [tuple(x) for x in lexicon.single_words(labels).collect()] == [("a", "car")]


def test_label_batches(spark):
    from ontoweave.operators import corpus

    sizes = {"a": 2, "b": 1, "c": 9, "d": 1, "e": 1, "f": 1, "g": 0}
    labels = spark.createDataFrame([(k, f"{k}{i}") for k, n in sizes.items() for i in range(n)] + [("g", None), (None, "x")], "iri string, label string")
    got = corpus.label_batches(labels, 4).orderBy("iri").collect()
    assert [(r["iri"], r["batch"]) for r in got] == [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 2), ("f", 2), ("g", 2)]
    many = corpus.label_batches(labels, 4, buckets=3).groupBy("iri").count().collect()
    assert {r["iri"]: r["count"] for r in many} == dict.fromkeys(sizes, 1)
    assert corpus.label_batches(labels.limit(0), 4).count() == 0


def test_suffix_search(spark):
    from ontoweave.operators import evaluate

    classes = spark.createDataFrame([("http://x/A01",), ("http://x/BA01",), ("http://y#C",), ("http://y#C",)], "iri string")
    wanted = spark.createDataFrame([("/A01",), ("A01",), ("C",), ("none",), ("",), (None,)], "symbol string")
    got = {r["symbol"]: (r["iri"], r["n"]) for r in evaluate.ids_of_suffixes(wanted, classes).collect()}
    assert got == {"/A01": ("http://x/A01", 1), "A01": ("http://x/A01", 2), "C": ("http://y#C", 1), "none": (None, 0), "": (None, 0), None: (None, 0)}
    assert evaluate.ids_of_suffixes(wanted.limit(0), classes).count() == 0
