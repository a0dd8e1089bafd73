import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ontoweave.llm import simhash as S


def slow(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.lists(st.sampled_from(["a", "B", "é", "É", " ", " ", "\n", "\x0b", "\x1c", "word", "word"]), max_size=40).map("".join) | st.none())
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == slow(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit("the whole é")).alias("h")).first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64("the whole é".encode(), seed=42).intdigest()


def brute(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near(r, n):
    base = [r.getrandbits(64) for _ in range(n // 3)]
    return base + [b ^ (sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1) for b in r.choices(base, k=n - len(base))]


def test_tiles_keep_components():
    r = random.Random(0)
    for _ in range(5):
        fps = sorted(set(near(r, 300)))
        x = np.array(fps, np.uint64)
        a, b = S.compare(x, x, 3)
        assert all(int(p ^ q) and len(a) < len(x) for p, q in zip(a, b, strict=True))
        label = {int(f): int(f) for f in fps}
        for _ in range(20):
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                m = min(label[p], label[q])
                label[p] = label[q] = m
        groups = brute(fps)
        assert len(set(label.values())) == len(set(groups))
        assert len({(label[f], g) for f, g in zip(fps, groups, strict=True)}) == len(set(groups))


def test_links_over_tiles(spark):
    r = random.Random(1)
    fps = sorted(set(near(r, 600)))
    frame = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    from ontoweave.llm.components import connected_components

    found = {x["node"]: x["label"] for x in connected_components(S.links(frame, 3, tile=8)).collect()}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    groups = brute(fps)
    mine = [found.get(s, s) for s in signed]
    assert len(set(mine)) == len(set(groups)) == len(set(zip(mine, groups, strict=True)))


def test_documents(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 200))) for _ in range(60)]
    texts += [t.replace(" ", "\n", 3).upper() for t in texts[:30]] + [texts[5]] * 40
    for t in texts[10:20]:
        w = t.split() or ["x"]
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \n"), (503, "long " * 100000), (None, texts[5]), (5, texts[5])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int")
    got = S.near_duplicates(frame).collect()
    fps = [slow(t) for _, t in rows]
    groups = brute(fps)
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((i if i is not None else -1, f, least[g]) for (i, _), f, g in zip(rows, fps, groups, strict=True))
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["fp"] & (1 << 64) - 1, x["component_id"]) for x in got) == want
    kept = S.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").distinct().collect()) == sorted(set(least.values()))
    assert S.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    from ontoweave.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (3, None), (5000, 4000), (5000, 4000), (4000, 5000)]
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 1000: 1000, **{2000 + i: 1000 for i in range(50)}, 4000: 4000, 5000: 4000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hot_nodes_beyond_the_broadcast(spark, monkeypatch):
    from ontoweave.llm import components

    monkeypatch.setattr(components, "BROADCAST_IDS", 20)
    monkeypatch.setattr(components, "HOT", 3)
    edges = [(i, i + 1) for i in range(10)] + [(100, 200 + i) for i in range(60)] + [(230, 300)]
    got = {x["node"]: x["label"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(11)}, 100: 100, 300: 100, **{200 + i: 100 for i in range(60)}}


def test_shared_folder_is_needed_on_a_cluster():
    import pytest

    from ontoweave.llm.common import shared_dir

    class Session:
        conf = {}

        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session).startswith("file://")
