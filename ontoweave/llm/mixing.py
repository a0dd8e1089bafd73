"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Exponents to which the shares of the corpus are raised: 1 keeps them, 0 makes all values of a dimension alike.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: The share of all tokens to sample, rounds of fitting at most, the change (of all tokens) of a cell that ends them sooner, and
#: cells that are broadcast at once (some 10 MB).
BUDGET, ROUNDS, TOLERANCE, BROADCAST_CELLS = 0.7, 32, 1e-9, 100_000
#: Rounds of one job over few cells.
ROUNDS_AT_ONCE = 4
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    """Blanks and line ends, and one; 0 for null and empty texts."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(F.replace(text, F.lit(" ")), F.lit("\n"))) + 1).otherwise(0).cast("long")


def form(text: Column) -> Column:
    """The form of a text, which stands in for its topic where a table has none: empty, lines (of under 60 characters on
    average), brief (under 150 tokens), long (1500 and more) or plain."""
    n = n_tokens(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return F.when(n == 0, "empty").when(lines * 60 > F.length(text), "lines").when(n < 150, "brief").when(n >= 1500, "long").otherwise("plain")


def keyed(docs: DataFrame, dims: list[str], text_col: str, tokens_col: str | None) -> DataFrame:
    """docs' rows as one column _row beside _k0, _k1, ... (a dimension's value after =, or - if null) and _n (tokens), so that
    no name of theirs clashes."""
    value = lambda d: F.col(d).cast("string") if d in docs.columns else form(F.col(text_col)) if d == "topic" else F.lit(None).cast("string")
    n = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else n_tokens(F.col(text_col))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.coalesce(F.concat(F.lit("="), value(d)), F.lit("-")).alias(f"_k{i}") for i, d in enumerate(dims)], n.alias("_n"))


def _wanted(cells: DataFrame, i: int, target: float | Mapping[str, float], budget: float) -> DataFrame:
    """(_k<i>, t): the tokens to take of each value of a dimension, in proportion to the target and summing to budget, where no
    value gives more than it has (what it lacks is shared by the others)."""
    sums = cells.groupBy(f"_k{i}").agg(F.sum("_n").cast("double").alias("a"))
    if isinstance(target, Mapping):
        named = cells.sparkSession.createDataFrame([("-" if k is None else f"={k}", float(v)) for k, v in target.items()] or [("-", 0.0)], f"_k{i} string, g double")
        sums = sums.join(named, f"_k{i}", "left").select(f"_k{i}", "a", F.when(F.col("a") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("g"))
    else:
        sums = sums.select(f"_k{i}", "a", F.when(F.col("a") > 0, F.pow("a", F.lit(float(target)))).otherwise(0.0).alias("g"))
    sums = written(sums, "targets")
    factor = 0.0
    while True:  # each pass finds another value that gives all it has; the factor grows until none does
        capped = F.lit(factor) * F.col("g") >= F.col("a")
        row = sums.agg(F.sum(F.when(capped & (F.col("g") > 0), F.col("a"))).alias("full"), F.sum(F.when(~capped & (F.col("g") > 0), F.col("g"))).alias("rest")).first()
        if not row["rest"]:
            break
        new = max(0.0, budget - (row["full"] or 0.0)) / row["rest"]
        if new <= factor:
            break
        factor = new
    full = (F.col("g") > 0) & ((F.lit(factor) * F.col("g") >= F.col("a")) | F.lit(not row["rest"]))
    return sums.select(f"_k{i}", F.when(full, F.col("a")).otherwise(F.lit(factor) * F.col("g")).alias("t"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (_k0, ..., _n: tokens) with w, the tokens to take of each, and t0, ..., what is wanted of its values: fitted in turn
    to each dimension's target shares of budget times all tokens, and never more than the cell has. A target is an exponent
    for the shares that the values have, or a mapping of values to weights (None: null; 0 for values that it doesn't name); a
    value of which more is wanted than there is gives all, and the others share the rest.

    Rounds end when no cell moves by more than tolerance of all tokens, or at their number; margins() tells what is left.
    Several rounds end in a written table. Cells are few as a rule, and then lie in one partition, where windows sum them.
    Beyond BROADCAST_CELLS the sums over a dimension are partial aggregates that join the cells, so neither a dimension nor
    a value needs to fit into a task."""
    total = cells.agg(F.sum("_n")).first()[0] or 0
    for i, t in enumerate(targets.values()):
        cells = cells.join(_wanted(cells, i, t, budget * total).withColumnRenamed("t", f"t{i}"), f"_k{i}")
    now = written(cells.withColumn("w", F.col("_n") * F.lit(float(budget))), "cells")
    few = now.count() <= BROADCAST_CELLS
    step = ROUNDS_AT_ONCE if few else 1
    for r in range(0, rounds, step):
        new = (now.repartition(1) if few else now).withColumn("_w", F.col("w"))
        for _ in range(min(step, rounds - r)):
            for i in range(len(targets)):
                new = _scaled(new, f"_k{i}", f"t{i}", few)
        new = written(new, "cells")
        dropped(cells.sparkSession, now)
        now, moved = new.drop("_w"), new.agg(F.max(F.abs(F.col("w") - F.col("_w")))).first()[0] or 0.0
        if moved <= tolerance * max(total, 1):
            break
    return now


def margins(fitted: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value: after =, or - for null; wanted, taken: tokens; off: their difference as a share of all that is taken)
    of rake()'s cells: how far the margins are met. Where cells that give all they have keep a margin from being met, off
    says by how much."""
    every = fitted.agg(F.sum("w")).first()[0] or 1.0
    one = lambda i, d: fitted.groupBy(F.col(f"_k{i}").alias("value")).agg(F.max(f"t{i}").alias("wanted"), F.sum("w").alias("taken")).select(F.lit(d).alias("dimension"), "*")
    return reduce(DataFrame.union, [one(i, d) for i, d in enumerate(dims)]).withColumn("off", F.abs(F.col("taken") - F.col("wanted")) / F.lit(every))


def _scaled(cells: DataFrame, key: str, target: str, few: bool) -> DataFrame:
    """cells with w scaled so that each value of key sums to its target, or to all that a cell has: by a window over few cells,
    which lie in one partition, else by a partial aggregate that joins them."""
    factor = lambda s: F.when(s > 0, F.least(F.col("w") * (F.col(target) / s), F.col("_n").cast("double"))).otherwise(0.0)
    if few:
        return cells.withColumn("w", factor(F.sum("w").over(Window.partitionBy(key))))
    sums = cells.groupBy(key).agg(F.sum("w").alias("_s"))
    return cells.join(sums, key).withColumn("w", factor(F.col("_s"))).drop("_s")


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number of [0, 1) by the md5 of seed and id: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _mixed(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]], budget: float, rounds: int, id_col: str, text_col: str, tokens_col: str | None, seed: str) -> DataFrame:
    """keyed() rows with _p, the probability, and _in, whether the document is selected."""
    own = keyed(docs, list(targets), text_col, tokens_col)
    keys = [f"_k{i}" for i in range(len(targets))]
    cells = written(own.groupBy(*keys).agg(F.sum("_n").alias("_n")), "cells")
    fitted = rake(cells, targets, budget, rounds)
    p = fitted.select(*keys, F.when(F.col("_n") > 0, F.col("w") / F.col("_n")).otherwise(0.0).alias("_p"))
    p = F.broadcast(p) if fitted.count() <= BROADCAST_CELLS else p
    return own.join(p, keys).withColumn("_in", draw(f"_row.`{id_col}`", seed) < F.col("_p"))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, seed: str = SEED) -> DataFrame:
    """docs with _k0, ... (the dimensions' values after =; - for null), _n (tokens), probability and selected; columns of docs
    with these names give way to them.

    A document's probability is what rake() takes of its cell over what the cell has; it is selected if draw() is below.
    Documents of no tokens belong to cells of none and have probability 0. Rows that repeat an id are selected alike;
    null ids draw as one; a dimension that docs lacks is one value, but for topic, which form() stands in for; an empty
    table gives none. Texts aren't shuffled: the cells are broadcast if they are 100,000 at most, else joined by their keys."""
    added = [*[F.col(f"_k{i}") for i in range(len(targets))], F.col("_n"), F.col("_p").alias("probability"), F.col("_in").alias("selected")]
    names = {*(f"_k{i}" for i in range(len(targets))), "_n", "probability", "selected"}
    return _mixed(docs, targets, budget, rounds, id_col, text_col, tokens_col, seed).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in names], *added)


def sampled(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, seed: str = SEED) -> DataFrame:
    """The rows of docs that mix() selects, with their own columns, whatever their names."""
    return _mixed(docs, targets, budget, rounds, id_col, text_col, tokens_col, seed).where("_in").select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def _sql() -> str:
    """mix() of documents for DuckDB."""
    steps, name = [], "r0"
    for r in range(ROUNDS):
        for k in TARGETS:
            new = f"r{r}_{k}"
            steps.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {k}) > 0 THEN least(w * (t_{k} / sum(w) OVER (PARTITION BY {k})), n) ELSE 0 END AS w) FROM {name})")
            name = new
    dims = ", ".join(TARGETS)
    # values in order of what they have to what is wanted of them: the first whose factor keeps within what it has ends those that give all
    margins = ", ".join(
        f"""m_{k} AS (SELECT {k}, sum(n)::DOUBLE AS a, CASE WHEN sum(n) > 0 THEN pow(sum(n)::DOUBLE, {e}) ELSE 0 END AS g FROM c GROUP BY {k}),
f_{k} AS (SELECT *, ({BUDGET} * (SELECT sum(n) FROM c) - coalesce(sum(a) OVER (ORDER BY a / g, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(g) OVER (ORDER BY a / g, {k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM m_{k} WHERE g > 0),
a_{k} AS (SELECT {k}, least(a, g * (SELECT max(f) FROM f_{k})) AS t_{k} FROM m_{k})"""
        for k, e in TARGETS.items()
    )
    count = "CASE WHEN length(text) > 0 THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END"
    lines = "(length(text) - length(replace(text, chr(10), '')) + 1)"
    return f"""
WITH d0 AS (SELECT doc_id, text, coalesce('=' || source, '-') AS source, coalesce('=' || lang, '-') AS lang, {count} AS n FROM documents),
d AS (SELECT doc_id, source, lang, n, '=' || CASE WHEN n = 0 THEN 'empty' WHEN {lines} * 60 > length(text) THEN 'lines' WHEN n < 150 THEN 'brief' WHEN n >= 1500 THEN 'long' ELSE 'plain' END AS topic FROM d0),
c AS (SELECT {dims}, sum(n)::BIGINT AS n FROM d GROUP BY {dims}), {margins},
r0 AS (SELECT c.*, n * {BUDGET}::DOUBLE AS w, {", ".join(f"t_{k}" for k in TARGETS)} FROM c {" ".join(f"JOIN a_{k} USING ({k})" for k in TARGETS)}),
{", ".join(steps)}
SELECT doc_id, d.source[2:] AS source, d.lang[2:] AS lang, d.topic[2:] AS topic, d.n AS n_tokens, round(CASE WHEN r.n > 0 THEN w / r.n ELSE 0 END, 6) AS probability,
  ('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0 < CASE WHEN r.n > 0 THEN w / r.n ELSE 0 END AS selected
FROM d JOIN {name} r USING ({dims})"""


SQL = _sql()
