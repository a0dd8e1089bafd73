"""Secrets by patterns and by character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import lean

#: The kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Strings that the models judge: their characters and least length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LONG = 16


def base_spans(text: str, long: list[tuple[str, int]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, in code points; leftmost and non-overlapping within a kind, whose
    matches that are too short are dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for word, at in long_words(text) if long is None else long:
        if len(word) >= LEAST["hex"]:
            found += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= LEAST["hex"]]
    return in_order(found)


def in_order(spans: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def long_words(text: str) -> list[tuple[str, int]]:
    """The words of 16 characters and more, and where they start; all else is too short for hex and the models."""
    out, at = [], 0
    for w in [w for w in text.split() if len(w) >= LONG]:
        at = text.index(w, at)
        out.append((w, at))
        at += len(w)
    return out


def codes(word: str) -> np.ndarray:
    """A word between two ends (0), as codes below 128; other characters share one."""
    return np.frombuffer(b"\0" + word.encode("ascii", "replace") + b"\0", np.uint8)


def markov(words: Iterable[str], smooth: float = 0.5) -> np.ndarray:
    """log P(next character | character) of a first-order model with additive smoothing."""
    counts = np.full((128, 128), smooth)
    for w in words:
        c = codes(w)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass
class Model:
    """The table of log-likelihood ratios of random against ordinary steps, the least sum that counts, and the shares of the
    random and of the ordinary held-out strings that reach it."""

    ratio: np.ndarray
    threshold: float
    recall: float = float("nan")
    false_rate: float = float("nan")

    def llr(self, word: str) -> float:
        c = codes(word)
        return float(self.ratio[c[:-1], c[1:]].sum())

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans: those of base_spans, and what the models hold for random among the strings that don't touch them."""
        long = long_words(text)
        base = base_spans(text, long)
        extra = []
        for word, at in long:
            for m in CANDIDATE.finditer(word):
                s, e = at + m.start(), at + m.end()
                if mixed(m[0]) and self.llr(m[0]) >= self.threshold and not any(a < e and s < b for _, a, b in base):
                    extra.append(("markov", s, e))
        return in_order(base + extra)


def mixed(word: str) -> bool:
    """Whether a word has letters and digits, or capitals after small letters more than once."""
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word) or sum(a.islower() and b.isupper() for a, b in zip(word, word[1:], strict=False)) > 2


def synthetic(seed: int = 7, n: int = 4000) -> list[str]:
    """Random strings over the alphabets of keys."""
    r = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef")
    return ["".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(16, 64))) for i in range(n)]


def identifiers(words: list[str], seed: int = 7, n: int = 8000) -> list[str]:
    """Names joined from ordinary words: snake, kebab and camel case, paths, with and without a number."""
    r = random.Random(seed)
    if not words:
        return []
    out = []
    for i in range(n):
        parts = [w.lower() for w in r.choices(words, k=r.randint(2, 4))]
        name = ("_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(w.capitalize() for w in parts[1:]))[i % 4]
        out.append(name + (str(r.randint(0, 9999)) if i % 3 == 0 else ""))
    return out


def held_out(word: str) -> bool:
    """Whether a labelled string is kept from training (a fifth of them), by its hash."""
    return zlib.crc32(word.encode()) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 5_000, max_words: int = 50_000, false_rate: float = 0.001, recall: float = 0.98) -> Model:
    """A Model from labelled samples of max_rows documents at most, those with the smallest hashes of their ids: what the
    patterns find is labelled random, with seeded strings over the alphabets of keys; other words, max_words at most, are
    labelled ordinary, with names joined from them. The threshold is the largest that recall of the random strings reach,
    or that which false_rate of the ordinary strings that the models could judge reach, if it is larger. A fifth of all strings is held out from the counts, and tells recall and false_rate. Ids and
    words that go through the driver are bounded by these parameters."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {}
            for text in b.column(0).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for k, s, e in spans:
                    m = ASSIGN.match(text, s) if k == "assign" else None
                    seen[m[2] if m else text[s:e]] = 1
                cut = [text[a:b] for a, b in zip([0, *(e for _, _, e in spans)], [*(s for _, s, _ in spans), len(text)], strict=True)]
                for w in re.findall(r"[A-Za-z0-9_]{4,}", " ".join(cut)):
                    if sum(c.isdigit() for c in w) <= min(2, len(w) // 4):
                        seen.setdefault(w, 0)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int32())], names=["w", "y"])

    found = texts.mapInArrow(lean(run), "w string, y int").groupBy("w").agg(F.max("y").alias("y"))
    rows = found.orderBy(F.desc("y"), F.xxhash64("w"), "w").limit(max_words).collect()
    secret, plain = ([r["w"] for r in rows if r["y"] == y] for y in (1, 0))
    random_ones = synthetic() + [w for w in secret if len(w) >= LONG]
    ordinary = plain + identifiers([w for w in plain if w.isalpha()])
    model = Model(markov(w for w in random_ones if not held_out(w)) - markov(w for w in ordinary if not held_out(w)), 0.0)
    judged = lambda ws: np.sort([model.llr(w) for w in ws if len(w) >= LONG and mixed(w) and not held_out(w)])
    high, low = judged(ordinary), judged(random_ones)
    model.threshold = max(float(low[int((1 - recall) * len(low))]), float(high[math.ceil((1 - false_rate) * len(high)) - 1]) + 1e-9 if len(high) else 0.0)
    share = lambda ws: float(np.mean([model.llr(w) >= model.threshold for w in ws])) if ws else float("nan")
    judge = lambda w: held_out(w) and len(w) >= LONG and mixed(w) and bool(CANDIDATE.fullmatch(w))
    model.recall, model.false_rate = share([w for w in random_ones if judge(w)]), share([w for w in ordinary if judge(w)])
    return model


def text_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans: array of kind, start, end and text) of each row, in code points of the whole text; no shuffle.

    Base spans are always kept; the models add others. Null and empty texts have none; repeated rows are scanned alike; an
    empty table gives none; further columns are ignored. model: train(docs) unless given."""
    model = model or train(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e, "text": t[s:e]} for k, s, e in model.spans(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[id_col, "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lean(run), f"`{id_col}` long, spans array<struct<kind:string,start:bigint,end:bigint,text:string>>")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """text with each span, or run of overlapping ones, replaced by mark."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(spans_col: str = "spans"):
    """Columns n_assign, n_access, n_hex, base_sha256 and spans of an array of secrets()."""
    of = lambda k: F.size(F.filter(spans_col, lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter(spans_col, lambda x: x.kind.isin(*LEAST))
    return [*(of(k) for k in LEAST), F.sha2(line(base), 256).alias("base_sha256"), line(F.col(spans_col)).alias("spans")]
