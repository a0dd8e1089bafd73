import random
from itertools import combinations

from ontoweave.llm import decontamination as D


def test_masks_hit_every_case():
    for length, replaced in ((8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2)):
        for gone in combinations(range(length), replaced):
            assert any(all(at + o not in gone for o in m) for m in D.MASKS for at in range(length - max(m))), (length, gone)


def brute(docs, items):
    """Pairs with a stretch of min(13, words of the item) words, place by place, of which 80 % agree."""
    import re

    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for i, text in docs:
        dw = cut(text)
        for j, item in items:
            iw = cut(item)
            n = min(13, len(iw))
            if not iw:
                continue
            for p in range(len(dw) - n + 1):
                for q in range(len(iw) - n + 1):
                    m = sum(a == b for a, b in zip(dw[p : p + n], iw[q : q + n], strict=True))
                    if m >= (n if n < 8 else 0.8 * n):
                        out[i, j] = max(m, out.get((i, j), 0))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, say(r.choice([3, 5, 8, 10, 13, 20, 35]))) for k in range(12)]
    docs = []
    for i in range(60):
        text = say(r.randint(0, 60))
        if i % 2:
            part = list(r.choice(items)[1])
            at = r.randint(0, max(0, len(part) - 14))
            part = part[at : at + r.choice([8, 13, 16, 40])]
            for _ in range(r.randint(0, 4)):
                part[r.randrange(len(part))] = "changed"
            k = r.randint(0, len(text))
            text = text[:k] + part + text[k:]
        docs.append((i, " ".join(text).upper() if i % 3 else ", ".join(text)))
    docs += [(100, None), (101, ""), (None, " ".join(items[-1][1])), (102, "w1 " * 30000 + " ".join(items[5][1])), (5, docs[5][1]), (103, "stands alone"), (104, "w7, w7 w7"), (105, " ".join(items[0][1]))]
    items = [(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (52, "Alone!"), (53, "w7 w7")]
    want = brute(docs, items)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, agree int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int")
    for block in (2_000_000, 0):
        got = {(x["doc_id"], x["item_id"]): x["matched"] for x in D.overlaps(frame, bench, broadcast_seeds=block).collect()}
        assert got == want
    hit = {i for i, _ in want}
    kept = D.decontaminated(frame, bench)
    assert kept.columns == frame.columns and {x["doc_id"] for x in kept.collect()} == {i for i, _ in docs if i not in hit or i is None}
    assert D.overlaps(frame.limit(0), bench).count() == 0 == D.overlaps(frame, bench.limit(0)).count()
