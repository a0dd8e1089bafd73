"""Benchmark decontamination by spaced seeds, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written

#: Offsets of the words that a seed takes. Together they hit every stretch of WINDOW words of which two were replaced, and
#: every item of 8 to 12 words of which a fifth was (test_decontamination.py tries all cases).
MASKS = ((0, 3, 4, 5, 6), (0, 1, 3, 5, 7), (0, 1, 3, 6, 7))
#: Words that are compared at once, the share of them that must agree, and the words from which on an item is sought by masks.
WINDOW, AGREE, LEAST = 13, 0.8, 8
#: Seeds, and bytes of the items' texts, that are broadcast at most (about 100 MB); more meet the texts' seeds by a shuffle.
BROADCAST_SEEDS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: The number of a short item's seed is this and its words.
WHOLE = 100


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seed(mask: int, ws: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(ws, at + o) for o in _offsets(mask)])


def _offsets(mask: int) -> range | tuple[int, ...]:
    return range(mask - WHOLE) if mask > WHOLE else MASKS[mask]


def _seeds(ws: Column, at: Column, masks: list[int]) -> Column:
    """An array of (m, h) for each mask that has room at a place; null in place of those that have none."""
    return F.array(*[F.when(at + (max(_offsets(m)) + 1) <= F.size(ws), F.struct(F.lit(m).alias("m"), _seed(m, ws, at).alias("h"))) for m in masks])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(id_col, item_col, matched, window, overlap) of each document that holds a passage of a benchmark item.

    matched of window words agree place by place in the best stretch (window: 13, or an item's words if fewer; 80 % at
    least must agree), and overlap in all of the item as it lies there. Items of fewer than 8 words are found where all of
    their words stand in their order. Every word place of every text is hashed once by each mask; hashes meet those of the
    items, and a hit that no hit of the same mask one word before it implies is verified along its whole diagonal.

    The items' seeds are broadcast if their number and bytes are bounded, so that texts are never shuffled and a passage
    that many documents share costs each of them a few checks. Beyond that the same pass over the texts yields small rows
    (hash, place) that are shuffled, and only texts with a hit are read again.

    Items without words, and null or empty texts, match nothing. Rows that repeat an id count as one; a null id is an id;
    no items or documents give no rows; further columns are ignored."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("iw")).where(F.size("iw") > 0).distinct().withColumn("key", F.xxhash64("item", "iw"))
    short = sorted(r["n"] for r in items.where(F.size("iw") < LEAST).select(F.size("iw").alias("n")).distinct().collect())  # 7 rows at most
    masks = [*range(len(MASKS)), *(WHOLE + n for n in short)]
    at_start = F.array(*[F.when(F.size("iw") == n, F.struct(F.lit(WHOLE + n).alias("m"), _seed(WHOLE + n, F.col("iw"), F.lit(0)).alias("h"))) for n in short]) if short else F.array()
    placed = items.select("key", "iw", F.explode(F.sequence(F.lit(0), F.size("iw") - 1)).alias("q"))
    by_mask = _seeds(F.col("iw"), F.col("q"), masks[: len(MASKS)])
    seeds = placed.select("key", "q", F.explode(F.when(F.size("iw") >= LEAST, by_mask).when(F.col("q") == 0, at_start)).alias("s")).where("s is not null").select("key", "q", "s.m", "s.h")
    size = seeds.count()
    size_bytes = benchmark.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    # outer: an explode without nulls lets a filter on its generator hash each place twice
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("dw"))
    places = F.explode_outer(F.when(F.size("dw") > 0, F.sequence(F.lit(0), F.size("dw") - 1))).alias("p")
    each = F.explode_outer(_seeds(F.col("dw"), F.col("p"), masks)).alias("s")
    if size <= broadcast_seeds and size_bytes <= BROADCAST_BYTES:
        hits = texts.select("id", "dw", places).select("id", "dw", "p", each).select("id", "dw", "p", "s.h").join(F.broadcast(seeds), "h").join(F.broadcast(items), "key")
    else:
        keyed = texts.withColumn("d", F.xxhash64("dw"))
        small = keyed.select("d", "dw", places).select("d", "p", each).select("d", "p", "s.h").where("h is not null")
        found = written(small.join(seeds, "h").select("d", "p", "key", "q", "m").distinct(), "seed-hits")
        hits = keyed.join(found, "d").join(items, "key")
    same = lambda o: F.get("dw", F.col("p") + (o - 1)).eqNullSafe(F.get("iw", F.col("q") + (o - 1)))
    implied = reduce(lambda rest, m: F.when(F.col("m") == m, reduce(lambda a, c: a & c, [same(o) for o in MASKS[m]])).otherwise(rest), range(len(MASKS)), F.lit(False))
    first = hits.where((F.col("p") == 0) | (F.col("q") == 0) | ~implied)
    low = F.greatest(F.lit(0), F.col("q") - F.col("p"))
    length = F.least(F.size("iw"), F.size("dw") - F.col("p") + F.col("q")) - low
    agree = F.zip_with(F.slice("iw", low + 1, length), F.slice("dw", F.col("p") - F.col("q") + low + 1, length), lambda x, y: (x == y).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    window = F.least(F.size("iw"), F.lit(WINDOW))
    best = F.array_max(F.transform(F.when(F.size("agree") >= F.col("window"), F.sequence(F.lit(1), F.size("agree") - F.col("window") + 1)), lambda s: total(F.slice("agree", s, F.col("window")))))
    seen = first.select("id", "item", agree.alias("agree"), window.alias("window")).select("id", "item", "window", best.alias("matched"), total("agree").alias("overlap"))
    found = seen.where(F.col("matched") >= AGREE * F.col("window"))
    return found.groupBy("id", "item").agg(F.max("matched").alias("matched"), F.max("window").alias("window"), F.max("overlap").alias("overlap")).withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose id overlaps() finds; rows with a null id stay."""
    found = written(overlaps(docs, benchmark, id_col, **options).select(id_col).distinct(), "contaminated")
    return only(docs, found, id_col, "left_anti").select(*docs.columns)


def _sql() -> str:
    """overlaps() for DuckDB over documents and benchmark."""
    key = lambda ws, at, m: f"concat_ws(' ', {m}, " + ", ".join(f"{ws}[{at} + {o + 1}]" for o in _offsets(m)) + ")"
    split = "[x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']"
    places = lambda ws, at: " UNION ALL ".join(f"SELECT *, {key(ws, at, m)} AS h FROM {{0}} WHERE {at} + {max(o) + 1} <= len({ws})" for m, o in enumerate(MASKS))
    whole = range(1, LEAST)
    short_items = " UNION ALL ".join(f"SELECT *, {key('iw', 'q', WHOLE + n)} AS h FROM iq WHERE q = 0 AND len(iw) = {n}" for n in whole)
    short_docs = " UNION ALL ".join(f"SELECT *, {key('dw', 'p', WHOLE + n)} AS h FROM dp WHERE p + {n} <= len(dw) AND {n} IN (SELECT len(iw) FROM it)" for n in whole)
    return f"""
WITH i AS (SELECT DISTINCT item_id, {split} AS iw FROM benchmark), it AS (SELECT * FROM i WHERE len(iw) > 0),
iq AS (SELECT item_id, iw, unnest(range(len(iw))) AS q FROM it), d AS (SELECT doc_id, {split} AS dw FROM documents),
dp AS (SELECT doc_id, dw, unnest(range(len(dw))) AS p FROM d), il AS (SELECT * FROM iq WHERE len(iw) >= {LEAST}),
si AS ({places("iw", "q").replace("{0}", "il")} UNION ALL {short_items}), sd AS ({places("dw", "p").replace("{0}", "dp")} UNION ALL {short_docs}),
diag AS (SELECT DISTINCT doc_id, dw, item_id, iw, p - q AS shift FROM sd JOIN si USING (h)),
cmp AS (SELECT doc_id, item_id, least(len(iw), {WINDOW}) AS w,
  [CASE WHEN iw[j + 1] = dw[j + shift + 1] THEN 1 ELSE 0 END FOR j IN range(greatest(0, -shift), least(len(iw), len(dw) - shift))] AS agree FROM diag),
best AS (SELECT doc_id, item_id, w, list_max([list_sum(agree[s:s + w - 1]) FOR s IN range(1, len(agree) - w + 2)]) AS matched, list_sum(agree) AS overlap FROM cmp)
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(w) AS INTEGER) AS "window", CAST(max(overlap) AS INTEGER) AS overlap
FROM best WHERE matched >= {AGREE} * w GROUP BY doc_id, item_id"""


SQL = _sql()
