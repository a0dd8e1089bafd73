"""Normalisers, tokenizers and IRI functions as Column expressions; null in, null out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The expressions of the "label (score)" notation, and where a camel-case name is cut.
SCORED_LABEL, SCORED_VALUE = r";?\s*(.*?)\s*\(\d+\.?\d*\)", r"\((\d+\.?\d*)\)"
CAMEL_CUT = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def normal(label: Column) -> Column:
    """A label as matchers compare it: trimmed, lower case, underscores as blanks."""
    return F.lower(F.trim(F.translate(label, "_", " ")))


def symbol_to_path(symbol: Column) -> Column:
    """A classification symbol as it stands in an IRI: no blanks, dashes for slashes."""
    return F.translate(symbol, "/ ", "-")


def path_to_symbol(path: Column) -> Column:
    """An IRI's symbol for people: a blank before the group and a slash for the dash (G06F8-10 to G06F 8/10)."""
    return F.regexp_replace(F.translate(path, "-", "/"), r"^([A-Z]\d\d[A-Z])(\d)", "$1 $2")


def quote(text: Column) -> Column:
    """Percent-encoding that keeps slashes, as URL paths have it (form encoding is what url_encode gives)."""
    coded = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def unquote(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def scored_labels(cell: Column) -> Column:
    """array<struct<label, score>> of a cell like `a (1.0); b (0.8)`; empty if nothing is scored."""
    labels, scores = (F.regexp_extract_all(cell, F.lit(e), F.lit(1)) for e in (SCORED_LABEL, SCORED_VALUE))
    return F.zip_with(labels, scores, lambda a, b: F.struct(a.alias("label"), b.cast("double").alias("score")))


def clean_literal(label: Column) -> Column:
    """An N-Triples literal as a label: without quotes and language, a pair of braces, and all between the first opening and
    the last closing parenthesis; blanks collapsed. Markup is escaped at the sink only."""
    label = F.regexp_replace(F.regexp_replace(label, r'^"', ""), r'"(@\w+)?$', "")
    label = F.regexp_replace(label, r"^\{(.*)\}$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"\(.*\)", ""), r"\s+", " "))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def iri_tail(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def iri_base(iri: Column) -> Column:
    """An IRI up to and with its last # or /."""
    return F.regexp_extract(iri, r"^(.*[#/])?", 0)


def abbreviate(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """IRIs with a known beginning as prefix:rest; the longest beginning counts."""
    out = iri
    for short, long in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(iri, F.lit(long)), F.concat(F.lit(f"{short}:"), F.substring(iri, len(long) + 1, 1 << 30))).otherwise(out)
    return out


def expand(name: Column, prefixes: Mapping[str, str]) -> Column:
    out = name
    for short, long in prefixes.items():
        out = F.when(F.startswith(name, F.lit(f"{short}:")), F.concat(F.lit(long), F.substring(name, len(short) + 2, 1 << 30))).otherwise(out)
    return out


def camel_words(name: Column) -> Column:
    return F.split(name, CAMEL_CUT)


def words(text: Column) -> Column:
    """Lower-case words; punctuation counts as blanks; none for an empty text."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")), r"\s+"), "")


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; the whole of a shorter text."""
    whole = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, cut).otherwise(whole))


def padded(xs: Column, n: int, fill: Column) -> Column:
    """An array cut or filled up to n entries."""
    return F.slice(F.concat(xs, F.array_repeat(fill, n)), 1, n)


def fixed(x: Column, places: int = 3) -> Column:
    return F.format_string(f"%.{places}f", x)


# ---- stems and pieces: they run on distinct words ----------------------------------------------------------------------
# Fixed values of Porter's algorithm: endings and what becomes of them, by step.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word; words of one or two letters stay."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                stem = word[: -len(end)]
                if "v" in _shape(stem):
                    doubled = len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz"
                    if stem.endswith(("at", "bl", "iz")) or not doubled and _measure(stem) == 1 and _short_end(stem):
                        stem += "e"
                    word = stem[:-1] if doubled else stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = max((e for e in table if word.endswith(e)), key=len, default="")
        if end and _measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.StringType())
def porter_stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """porter() of a column of words, in Arrow batches."""
    for b in batches:
        yield b.map(lambda w: None if w is None else porter(w))


def word_pieces(vocabulary: set[str], longest: int = 100):
    """A pandas UDF word -> array of the longest pieces of a vocabulary, those within a word marked by ##; [UNK] for words
    that it can't make up. The vocabulary comes from the caller."""

    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" * bool(at) + word[at:e]) in vocabulary), None)
            if end is None or len(word) > longest:
                return ["[UNK]"]
            out.append("##" * bool(at) + word[at:end])
            at = end
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda w: None if w is None else cut(w))

    return pieces
