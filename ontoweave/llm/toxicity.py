"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import lean, pieces, release, words
from .common import written

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside the words themselves.
STEMS = range(4, 10)
FOLDS = 3


def features_of(token: str) -> list[str]:
    """The words in a token and their beginnings (marked by a trailing *)."""
    words = WORD.findall(token.lower())
    return [*words, *(f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k)]


def chain_of(word: str) -> list[str]:
    """A word and its beginnings, longest first."""
    return [word, *(f"{word[:k]}*" for k in reversed(STEMS) if len(word) >= k)]


def likely(distinct: pa.Array, starts: set[str]) -> list[tuple[int, str]]:
    """Number and text of the words of which a part begins with one of starts: a cheap test that leaves few."""
    low = pc.utf8_lower(distinct)
    first = pc.utf8_slice_codeunits(pc.replace_substring_regex(low, r"^[^\pL\pN_]+", ""), 0, STEMS[0])
    begins = pc.is_in(pc.replace_substring_regex(first, r"[^\pL\pN_].*$", ""), value_set=pa.array(sorted(starts), pa.string()))
    may = pc.or_(begins, pc.match_substring_regex(low, r"[\pL\pN_][^\pL\pN_]+[\pL\pN_]"))
    at = np.flatnonzero(may.to_numpy(zero_copy_only=False))
    return list(zip(at.tolist(), distinct.take(pa.array(at)).to_pylist(), strict=True))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) of a sequence of scores, left to right: Ruzzo and Tompa's
    scan, in linear time. Each segment found keeps a pointer to the last one before it whose sum before is smaller, so a
    search for such a one passes no segment twice."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at its end, the pointer
    for start, before, after in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        end, j = start + 1, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, end, before, after, j))
                break
            start, _, before, _, above = found[j]
            del found[j:]
            j = above
    return [(s, e, r - l) for s, e, l, r, _ in found]


@dataclass
class Model:
    """Signed weights of features, the drift of tokens without any, Karlin and Altschul's constants, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    lam: float = 1.0
    k: float = 1.0
    coef: tuple[float, ...] = ()
    base: float = 0.0

    def weight(self, token: str) -> float:
        """A token's score, by the longest feature of each of its words that is known: the largest if that is positive; else
        the least, which is evidence for clean text, or the drift if that is less."""
        known = [self.weights[f] for w in WORD.findall(token.lower()) if (f := next((f for f in chain_of(w) if f in self.weights), None))]
        top = max(known, default=0.0)
        return top if top > 0 else min([-self.drift, *known])

    def weigh(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The scores of each text's words."""
        distinct, places, offsets = words(texts)
        known = np.full(len(distinct), -self.drift)
        for i, w in likely(distinct, {f[: STEMS[0]] for f in self.weights}):
            known[i] = self.weight(w)
        every = known[places]
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield every[s:e]

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        return segments(scores) if (scores > 0).any() else []

    def bits(self, score: float, n: int) -> float:
        """-ln of the expected number of segments of such a score in n clean tokens."""
        return self.lam * score - math.log(max(self.k * max(n, 1), 1e-12))

    def measures(self, found: list[tuple[int, int, float]], n: int) -> list[float]:
        if not found:
            return [0.0, 0.0, 0.0]
        values = [max(0.0, self.bits(s, n)) for _, _, s in found]
        total = self.lam * sum(s for _, _, s in found)
        return [math.log1p(max(values)), math.log1p(total), math.log1p(sum(values))]

    def score(self, measures: list[float]) -> float:
        if not self.coef:
            return self.base
        z = self.coef[0] + sum(a * b for a, b in zip(self.coef[1:], measures, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def enrichment(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The likelihood-ratio statistics G2 of presence in y1 of n1 toxic and y0 of n0 clean documents, negative if it is less
    frequent in toxic ones."""
    term = lambda x, e: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(e > 0, e, 1)), 0.0)
    p = (y1 + y0) / max(n1 + n0, 1)
    g2 = 2 * (term(y1, n1 * p) + term(y0, n0 * p) + term(n1 - y1, n1 * (1 - p)) + term(n0 - y0, n0 * (1 - p)))
    return np.where(y1 * n0 > y0 * n1, g2, -g2)


def log_odds(names: list[str], y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, share: np.ndarray, strength: float, min_g2: float) -> dict[str, float]:
    """Signed log-odds of toxic against clean, over those of all documents, of the features that are enriched or depleted or
    extend such a one. Each has a Dirichlet prior with the mean of the longest feature that it extends (at the root, of all
    documents) and pseudo-counts that grow with its share of the corpus, so rare words lean on their beginnings and a
    frequent word can differ from them."""
    base = n1 / (n1 + n0)
    logit = lambda p: math.log(p / (1 - p))
    at, g2 = {x: i for i, x in enumerate(names)}, enrichment(y1, y0, n1, n0)
    mean, good, out = {}, {}, {}
    for f in sorted(names, key=lambda x: (len(x.rstrip("*")), not x.endswith("*"))):
        i, stem = at[f], f.rstrip("*")
        above = next((x for x in chain_of(stem)[0 if f == stem else 1 :] if x != f and x in mean), None)
        s = 2 + strength * share[i]
        mean[f] = min(max((y1[i] + s * mean.get(above, base)) / (y1[i] + y0[i] + s), 1e-6), 1 - 1e-6)
        good[f] = bool(abs(g2[i]) >= min_g2) or good.get(above, False)
        if good[f]:
            out[f] = logit(mean[f]) - logit(base)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Coefficients, the intercept first, by Newton's steps with a ridge on the others."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _karlin(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(lam * score)] = 1 over clean tokens, counts of which have each of scores."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    n, low, high = counts.sum(), 1e-6, 50.0 / max(float(scores.max()), 1e-6)
    f = lambda t: (counts * np.exp(t * scores)).sum() / n - 1
    if f(low) >= 0:
        return low
    if f(high) <= 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 10_000, max_features: int = 1 << 16, min_g2: float = 20.0, strength: float = 20.0, drift: float = 0.05) -> Model:
    """A Model from docs and labels (id_col, label_col 0/1; the larger counts if there are several; nulls are left out).

    Fitted on max_rows labelled documents at most, those with the smallest hashes of their ids, each text once; so what
    is broadcast and collected is bounded: max_rows ids, max_features features with the largest G2, histograms of clean
    tokens' and segments' scores, and max_rows rows of three measures. The prior is counted over all documents. For the calibration, each fold of the rows is measured by weights
    from the others. Without rows of both labels the model scores the labelled rows' mean, or 0."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text")).groupBy("h").agg(F.min(F.struct("id", "y", "text")).alias("r"))
    sample = written(sample.select("r.y", "r.text", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for (_, y), v in sizes.items() if y == k) for k in (0, 1)]
    if not all(n):
        return Model(base=n[1] / max(sum(n), 1))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, 1, 2 << 20):
                distinct, places, offsets = words(piece.column(1))
                number: dict[str, int] = {}
                lists = [[number.setdefault(f, len(number)) for f in dict.fromkeys(features_of(w))] for w in distinct.to_pylist()]
                sizes = np.array([len(x) for x in lists])
                flat, first = np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum(sizes) - sizes
                kinds, counts = (piece.column(0).to_numpy() * FOLDS + piece.column(2).to_numpy()).tolist(), np.zeros((2 * FOLDS, len(number)), np.int64)
                for kind, s, e in zip(kinds, offsets[:-1], offsets[1:], strict=True):
                    own = np.unique(places[s:e])
                    n = sizes[own]
                    counts[kind, np.unique(flat[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])] += 1
                kind, at = np.nonzero(counts)
                names = pa.array(number, pa.string()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([names, pa.array((kind // FOLDS).astype(np.int32)), pa.array((kind % FOLDS).astype(np.int32)), pa.array(counts[kind, at])], names=["f", "y", "fold", "n"])

    cells = [f"sum(if(y = {y} and fold = {k}, n, 0))" for y in (0, 1) for k in range(FOLDS)]
    table = sample.mapInArrow(lean(present), "f string, y int, fold int, n long").groupBy("f").agg(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(cells)])
    y0, y1 = (F.expr("+".join(f"c{i}" for i in range(k * FOLDS, (k + 1) * FOLDS))) for k in (0, 1))
    table = written(table, "toxic-counts")
    rate, wide = n[1] / sum(n), F.substring("f", 1, STEMS[0])
    excess = (y1 - rate * (y0 + y1)) / F.sqrt(rate * (y0 + y1))
    enriched = table.where((y1 >= 3) & (excess >= 5)).orderBy(F.desc(excess), "f").limit(max_features // 4)
    depleted = table.where(excess <= -3).orderBy(excess, "f").limit(max_features // 4)
    first = [r["f"] for r in enriched.select("f").union(depleted.select("f")).collect()]
    # what begins like them and was seen in three documents
    kin = docs.sparkSession.createDataFrame([(x,) for x in sorted({x[: STEMS[0]] for x in first})], "stem string")
    rows = table.where(y0 + y1 >= 3).join(F.broadcast(kin), wide == F.col("stem"), "left_semi").orderBy(F.desc(y1), "f").limit(max_features).collect()
    names = [r["f"] for r in rows]
    counts = np.array([[r[f"c{i}"] for i in range(2 * FOLDS)] for r in rows], np.float64).reshape(-1, 2, FOLDS)
    prior = _shares(texts, names)

    def fitted(folds: list[int]) -> dict[str, float]:
        part, size = counts[:, :, folds].sum(axis=2), [sum(sizes.get((k, y), 0) for k in folds) for y in (0, 1)]
        return log_odds(names, part[:, 1], part[:, 0], size[1], size[0], prior, strength, min_g2) if all(size) else {}

    models = [Model(fitted([j for j in range(FOLDS) if j != k]), drift) for k in range(FOLDS)]
    final = Model(fitted([*range(FOLDS)]), drift)

    def each(b: pa.RecordBatch) -> Iterator[list[tuple[int, int, list[float], np.ndarray]]]:
        """Per piece: label, words, segments' scores and words' scores of each row, by the model that hasn't seen it."""
        for piece in pieces(b, 1):
            scores = [m.weigh(piece.column(1)) for m in models]
            rows = zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), *scores, strict=True)
            yield [(y, len(own[k]), [s for _, _, s in models[k].passages(own[k])], own[k]) for y, k, *own in rows]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Histograms of clean rows: of tokens' scores (in thousandths) and of segments' (fiftieths of their logarithm)."""
        for b in batches:
            for rows in each(b):
                clean = [(s, own) for y, _, s, own in rows if y == 0]
                tokens = np.rint(1000 * np.concatenate([own for _, own in clean])).astype(np.int64) if clean else np.zeros(0, np.int64)
                found = np.rint(50 * np.log([x for s, _ in clean for x in s])).astype(np.int64)
                for kind, values in ((0, tokens), (1, found)):
                    at, n = np.unique(values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["kind", "at", "n"])

    rows = sample.mapInArrow(lean(spread), "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).orderBy("kind", "at").collect()
    (token_at, token_n), (found_at, found_n) = [[np.array([r[c] for r in rows if r["kind"] == k], np.float64) for c in ("at", "n")] for k in (0, 1)]
    final.lam = _karlin(token_at / 1000, token_n)
    # K by moments: the mean number of segments above the median score of clean segments is K n exp(-lam s)
    if len(found_at):
        above = np.cumsum(found_n[::-1])[::-1]
        s = math.exp(found_at[np.flatnonzero(above >= found_n.sum() / 2)[-1]] / 50)
        final.k = max(1e-9, found_n.sum() / 2 / max(token_n.sum(), 1) * math.exp(min(final.lam * s, 50)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in each(b):
                x = np.array([final.measures([(0, 0, v) for v in s], n) for _, n, s, _ in rows]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([y for y, *_ in rows], pa.int32()), *(pa.array(x[:, i]) for i in range(3))], names=["y", "a", "b", "c"])

    seen = np.array(sample.mapInArrow(lean(measured), "y int, a double, b double, c double").collect(), np.float64)
    final.coef, final.base = logistic(seen[:, 1:], seen[:, 0]), rate
    del rows, seen, counts
    release()
    return final


def _shares(texts: DataFrame, names: list[str]) -> np.ndarray:
    """The share of all documents that have each of a bounded list of features."""
    place, starts = {x: i for i, x in enumerate(names)}, {x[: STEMS[0]] for x in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names) + 1, np.int64)
        for b in batches:
            counts[-1] += len(b)
            for piece in pieces(b, 0):
                distinct, places, offsets = words(piece.column(0))
                lists = {i: [place[f] for f in features_of(w) if f in place] for i, w in likely(distinct, starts)}
                may = np.zeros(len(distinct), bool)
                may[[i for i, x in lists.items() if x]] = True
                at = np.flatnonzero(may[places])
                doc = np.searchsorted(offsets, at, "right") - 1
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                for own in np.split(places[at], cut[1:]) if len(at) else []:
                    counts[list(set(chain.from_iterable(map(lists.__getitem__, own.tolist()))))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["i", "n"])

    got = {r["i"]: r["n"] for r in texts.select("text").mapInArrow(lean(run), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(i, 0) for i in range(len(names))]) / max(got.get(len(names), 0), 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, score 0..1, predicted 0/1, passages: array of start, end (words) and bits) of each row; no shuffle.

    Null and empty texts have no passage; every row is scored, repeated ones alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, 1):
                scores, passages = [], []
                for weights in model.weigh(piece.column(1)):
                    found, n = model.passages(weights), len(weights)
                    scores.append(model.score(model.measures(found, n)))
                    passages.append([{"start": s, "end": e, "bits": bits} for s, e, x in found if (bits := model.bits(x, n)) > 0])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, kind)], names=[id_col, "score", "predicted", "passages"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), f"`{id_col}` long, score double, predicted int, passages array<struct<start:int,end:int,bits:double>>")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score under threshold, with all their columns; no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, place):
                keep = [model.score(model.measures(model.passages(w), len(w))) < threshold for w in model.weigh(piece.column(place))]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text has the remainder 2 by 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """score() of all docs by a model from the labels that aren't held out, and held_out."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col, **options)
    return score(docs, model, id_col, text_col, threshold).withColumn("held_out", held_out(id_col))
