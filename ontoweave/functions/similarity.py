"""Similarities of labels and vectors: a registry of names to Column builders, open for more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import grams

Similarity = Callable[[Column, Column], Column]


def exact(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def levenshtein(a: Column, b: Column) -> Column:
    """1 - edits over the longer length, in characters; 1 for two empty labels."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def levenshtein_at_least(a: Column, b: Column, least: float) -> Column:
    """levenshtein() where it is least or more, else null: distances beyond the edits that allows aren't computed."""
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.floor(longest * (1.0 - least) + 1e-9).cast("int")
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, F.when(levenshtein(a, b) >= least, levenshtein(a, b)))


def raw_levenshtein(a: Column, b: Column) -> Column:
    """1 - edits; negative for more than one."""
    return 1.0 - F.levenshtein(a, b).cast("double")


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    both = F.size(F.array_intersect(grams(a, n), grams(b, n)))
    return both / F.greatest(F.size(grams(a, n)) + F.size(grams(b, n)) - both, F.lit(1))


def shingle_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of the sets of n-character shingles."""
    size = F.sqrt(F.size(grams(a, n)).cast("double") * F.size(grams(b, n)))
    return F.when(size > 0, F.size(F.array_intersect(grams(a, n), grams(b, n))) / size).otherwise(0.0)


def _pairwise(score: Callable[[str, str], float]) -> Similarity:
    """A pandas UDF of a function of two strings; null for null. A batch's distinct pairs are scored once."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            memo: dict[tuple, float | None] = {}
            yield pd.Series([memo[p] if p in memo else memo.setdefault(p, None if p[0] is None or p[1] is None else score(*p)) for p in zip(a, b, strict=True)], dtype="float64")

    return run


def ngram_score(a: str, b: str, n: int = 3) -> float:
    """Similarity by Kondrak's n-gram distance: n-grams of the texts behind n - 1 marks are aligned; the cost of two is the
    share of their characters that differ, a mark counting as a match only by half; over the longer length."""
    if not a or not b:
        return float(a == b)
    if len(a) < n or len(b) < n:
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    x, y = "\0" * (n - 1) + a, "\0" * (n - 1) + b
    row = np.arange(len(b) + 1, dtype=float)
    for i in range(1, len(a) + 1):
        left, new = x[i - 1 : i - 1 + n], [float(i)]
        for j in range(1, len(b) + 1):
            right = y[j - 1 : j - 1 + n]
            marks = sum(p == q == "\0" for p, q in zip(left, right, strict=True))
            cost = sum(p != q for p, q in zip(left, right, strict=True)) / (n - marks)
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + cost))
        row = np.array(new)
    return float(1 - row[-1] / max(len(a), len(b)))


def jaro_winkler_score(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    """Jaro's similarity, raised by a common beginning of up to four characters where it exceeds boost."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    right, m = [c for c, t in zip(b, taken, strict=True) if t], len(left)
    if not m:
        return 0.0
    turned = sum(p != q for p, q in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    begin = next((i for i, (p, q) in enumerate(zip(a[:4], b[:4], strict=False)) if p != q), min(4, len(a), len(b)))
    return jaro + begin * scale * (1 - jaro) if jaro > boost else jaro


ngram, jaro_winkler = _pairwise(ngram_score), _pairwise(jaro_winkler_score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.when(norm(a) * norm(b) > 0, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def relative_distance(a: Column, b: Column) -> Column:
    """Distance of two vectors over the sum of their lengths; 0 for two zero vectors."""
    apart = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(norm(a) + norm(b) > 0, norm(apart) / (norm(a) + norm(b))).otherwise(0.0)


def structural(lexical: Column, above: Column, below: Column, up: float = 0.1, down: float = 0.3) -> Column:
    """A pair's own score with shares of what its parents and its children score."""
    return lexical + up * F.coalesce(above, F.lit(0.0)) + down * F.coalesce(below, F.lit(0.0))


def two_stage(by_id: Column, by_label: Column, least_id: float, least_label: float) -> Column:
    """The score by id where that is high enough, else that by label where that is, else 0."""
    return F.when(by_id >= least_id, by_id).when(by_label >= least_label, by_label).otherwise(0.0)


def two_stage_array(by_id, by_label, least_id, least_label):
    """two_stage() of numpy arrays; what isn't a number is below every threshold."""
    import numpy as np

    return np.where(by_id >= least_id, by_id, np.where(by_label >= least_label, by_label, 0.0))


def clamp(score: Column, least: float = 0.01, most: float = 1.0) -> Column:
    """Scores of least and less as 0, and none above most."""
    return F.when(score <= least, 0.0).otherwise(F.least(score, F.lit(most)))


REGISTRY: dict[str, Similarity] = {
    "exact": exact,
    "levenshtein": levenshtein,
    "raw_levenshtein": raw_levenshtein,
    "gram_jaccard": gram_jaccard,
    "shingle_cosine": shingle_cosine,
    "ngram": ngram,
    "jaro_winkler": jaro_winkler,
}


def register(name: str, similarity: Similarity) -> None:
    """Adds a similarity to the registry, under which matchers find it."""
    REGISTRY[name] = similarity


def best_of(names: list[str], a: Column, b: Column) -> Column:
    """The largest of some registered similarities."""
    scores = [REGISTRY[n](a, b) for n in names]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
