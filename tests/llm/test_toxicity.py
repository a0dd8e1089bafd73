import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ontoweave.llm import toxicity as T


def brute_segments(x):
    """Maximal scoring segments by their definition: the best, then the best left and right of it."""
    if not len(x):
        return []
    sums = np.concatenate([[0], np.cumsum(x)])
    best = max(((round(sums[j] - sums[i], 9), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), key=lambda t: t[:3])
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute_segments(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(x[j:])]


@given(st.lists(st.sampled_from([-0.4, -0.4, -1.3, 1.0, 2.5, 0.7]), max_size=18))
@settings(max_examples=150, deadline=None)
def test_segments_are_the_maximal_ones(weights):
    values = np.array(weights)
    got = T.segments(values)
    want = [values[a:b].sum() for a, b in brute_segments(list(values))]
    assert np.allclose(sorted(s for _, _, s in got), sorted(want))
    assert all(abs(values[a:b].sum() - s) < 1e-9 for a, b, s in got)


def test_segments_take_linear_time():
    import time

    for shape in (np.tile([2.0, -3.0], 60_000), np.tile([1.0, *[-0.05] * 40], 60_000), np.concatenate([np.tile([1.0, -1.1], 50_000), np.tile([1.0, -0.9], 50_000)])):
        start = time.perf_counter()
        T.segments(shape)
        assert time.perf_counter() - start < 2


def corpus(n=400):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for k in range(4):
                text[20 + 2 * k] = r.choice(["vilest", "scornful", "scornfully", "hateful"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_scores(spark):
    rows, labels = corpus()
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "VILEST, hateful! vilest (scornful) " * 20000, "x"), (None, "w1 w2", "x"), (7, rows[7][1], "twin")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    label = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, label).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _ in labels if by[i]["held_out"]]
    assert 50 < len(held) < 150
    assert np.mean([by[i]["predicted"] == y for i, y in labels if by[i]["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert by[1002]["predicted"] == 1 and not by[1000]["predicted"] and not by[1001]["predicted"] and not by[None]["held_out"]
    assert [p for p in by[0]["passages"] if p["start"] <= 26 and p["end"] >= 21]
    model = T.train(docs, label)
    kept = {r["doc_id"] for r in T.clean(docs, model).collect()}
    assert 1002 not in kept and {1000, 1001} <= kept and T.clean(docs, model).columns == docs.columns


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in T.toxicity(docs, none).collect()] == [0.0]
    assert T.toxicity(docs.limit(0), none).count() == 0
    assert T.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).first()["score"] == 1.0


def test_likely_words_are_those_that_have_weight():
    m = T.Model({"bad": 2.0, "awfu*": 1.0})
    texts = pa.array(["a BAD, x-bad awfully fine \"awful", None])
    assert [w.tolist() for w in m.weigh(texts)] == [[-0.05, 2.0, 2.0, 1.0, -0.05, 1.0], [-0.05]]
    m.weights["good"] = -1.5
    assert [m.weight(x) for x in ("good", "good-bad", "other", "good, other")] == [-1.5, 2.0, -0.05, -1.5]
