"""Taxonomies as edge tables (child, parent): closure, depth, paths, siblings, frontiers and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Members of a kind that one row holds, about; two such rows make some four million pairs.
PART = 2048
#: Pairs that a task makes, about; rows of parts that are broadcast hold this many members at most (some 30 MB).
TASK_PAIRS, BROADCAST_MEMBERS = 50_000_000, 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table in the shared folder, which each round computes once and lost executors don't take."""
    return written(df, "round")


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, ancestor, near, far): ancestors, and the lengths of the shortest and the longest walk to them that doesn't come
    back to its node. Rounds go on until no walk is left. A walk of more edges than there are nodes goes around a cycle, which
    has no longest one: that is an error, as are walks of over most edges if most is given."""
    found = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("child is not null and parent is not null").distinct()
    step = cut(found)
    walk, depth = step, 1
    rounds = [walk.withColumn("d", F.lit(1))]
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    limit = None
    while True:
        depth += 1
        walk = cut(walk.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).where("node <> ancestor").distinct())
        if walk.isEmpty():
            break
        if most is not None and depth > most:
            raise ValueError(f"walks of over {most} edges")
        if depth >= 8 and limit is None:  # counted once it may matter
            limit = step.select("node").union(step.select("ancestor")).distinct().count()
        if limit is not None and depth >= limit:
            raise ValueError("the edges have a cycle")
        rounds.append(walk.withColumn("d", F.lit(depth)))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out.groupBy("node", "ancestor").agg(F.min("d").alias("near"), F.max("d").alias("far"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): roots (node) and all below them, by a frontier that grows breadth first until it is empty."""
    seen = cut(roots.select("node").distinct())
    frontier = seen
    while True:
        frontier = cut(edges.join(frontier.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between descendants of the roots."""
    kept = descendants(edges, roots)
    return edges.join(kept.withColumnRenamed("node", "child"), "child", "left_semi").join(kept.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent")


def depths(edges: DataFrame, nodes: DataFrame | None = None, longest: bool = True) -> DataFrame:
    """(node, depth): the longest (or shortest) path up to a root; 0 for roots."""
    every = edges.select(F.col("child").alias("node")).union(edges.select("parent"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    up = closure(edges)
    roots = every.join(edges.select(F.col("child").alias("node")), "node", "left_anti").withColumnRenamed("node", "ancestor")
    to_roots = up.join(roots, "ancestor", "left_semi").groupBy("node").agg((F.max("far") if longest else F.min("near")).alias("depth"))
    return every.join(to_roots, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def root_paths(edges: DataFrame) -> DataFrame:
    """(node, path): the array from a node up to a root over each node's first (smallest) parent."""
    first = cut(edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent")))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    done, walk = [], cut(nodes.select("node", F.array("node").alias("path"), F.col("node").alias("top")))
    while True:
        done.append(walk.join(first.select(F.col("node").alias("top")), "top", "left_anti").select("node", "path"))
        walk = cut(walk.join(first.select(F.col("node").alias("top"), "parent"), "top").where(~F.array_contains("path", F.col("parent"))).select("node", F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("top")))
        if walk.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def path_suffix(paths: DataFrame, wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(node, path, names): for each wanted node the rest of the first path, by its own node, that holds it, from there on;
    and the names (node, name) along it, or the nodes themselves where there is none."""
    held = paths.select(F.col("node").alias("owner"), "path", F.explode("path").alias("node")).join(wanted, "node", "left_semi")
    first = held.groupBy("node").agg(F.min_by("path", F.struct(F.size("path"), "owner")).alias("path"))
    cut_off = first.select("node", F.expr("slice(path, array_position(path, node), size(path))").alias("path"))
    each = cut_off.select("node", "path", F.posexplode("path").alias("i", "at")).join(names.select(F.col("node").alias("at"), "name"), "at", "left")
    return each.groupBy("node", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", "at").alias("name")))), lambda x: x["name"]).alias("names"))


def outline_parents(rows: DataFrame, by: str, order: str, depth: str) -> DataFrame:
    """rows with parent_order: the last earlier row of the group that is less deep, null for none. For each depth there is
    the last place where it was seen so far, as a running maximum, so no pairs of rows are formed."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in rows.select(depth).where(F.col(depth).isNotNull()).distinct().orderBy(depth).collect()]  # depths of an outline are few
    last = [F.when(F.col(depth) > F.lit(d), F.max(F.when(F.col(depth) == d, F.col(order))).over(before)) for d in levels]
    nearest = F.greatest(*last) if len(last) > 1 else last[0] if last else F.lit(None)
    return rows.withColumn("parent_order", nearest)


def siblings(edges: DataFrame) -> DataFrame:
    """(parent, c1, c2) of pairs of children, the smaller one first."""
    a, b = edges.select("parent", F.col("child").alias("c1")).distinct(), edges.select("parent", F.col("child").alias("c2")).distinct()
    return a.join(b, "parent").where("c1 < c2")


def in_parts(members: DataFrame) -> tuple[DataFrame, bool]:
    """((kind, part, n, held) of distinct members (kind, node), nulls included; whether the members can be broadcast): arrays of
    about PART nodes, dealt by hashes, and numbers of their own, so that no row and no task grows with a kind."""
    sizes = members.groupBy("kind").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / F.lit(PART)))
    total, many = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("parts") > 1)).first()
    if many:
        large = sizes.where("parts > 1").select("kind", "parts")
        members = members.join(F.broadcast(large) if many <= BROADCAST_MEMBERS else large, "kind", "left")
        members = members.withColumn("place", F.expr("if(parts is null, 0, int(pmod(xxhash64(node), parts)))"))
    else:
        members = members.withColumn("place", F.lit(0))
    empty = F.when(F.bool_or(F.col("node").isNull()), F.expr("array(null)")).otherwise(F.expr("array()"))
    held = members.groupBy("kind", "place").agg(F.count("*").alias("n"), F.concat(F.collect_list("node"), empty).alias("held"))
    return cut(held.select("kind", F.monotonically_increasing_id().alias("part"), "n", "held")), total <= BROADCAST_MEMBERS


def crossed(kinds: DataFrame, left: tuple[DataFrame, bool], right: tuple[DataFrame, bool], unordered: bool = False) -> DataFrame:
    """(a, b) and the other columns of kinds (k1, k2, ...) for each node a of kind k1 in left and b of kind k2 in right (both by
    in_parts()). unordered: left is right, kinds hold k1 <= k2, and each pair of two nodes comes once, the smaller one first.

    Only numbers of parts are shuffled, dealt over tasks by the number of pairs; a side that is small enough is broadcast by
    node, and pairs are made where they are used."""
    (left, few_left), (right, few_right) = left, right
    rest = [c for c in kinds.columns if c not in ("k1", "k2")]
    at = lambda side, i: side.select(F.col("kind").alias(f"k{i}"), F.col("part").alias(f"p{i}"), F.col("n").alias(f"n{i}"))
    tiles = kinds.join(at(left, 1), "k1").join(at(right, 2), "k2")
    tiles = tiles.where("k1 <> k2 or p1 <= p2") if unordered else tiles
    total = tiles.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] or 0
    tasks = max(1, -(-total // TASK_PAIRS), min(total // 100_000, kinds.sparkSession.sparkContext.defaultParallelism))
    met = tiles.select("p1", "p2", *rest).repartition(tasks)
    for side, few, p, x in ((left, few_left, "p1", "x"), (right, few_right, "p2", "y")):
        if few:  # a join is compiled with what comes after it, a generator isn't
            met = met.join(F.broadcast(side.select(F.col("part").alias(p), F.explode("held").alias(x))), p)
        else:
            met = met.join(side.select(F.col("part").alias(p), "held"), p).select(*met.columns, F.explode("held").alias(x))
    if not unordered:
        return met.select(F.col("x").alias("a"), F.col("y").alias("b"), *rest)
    return met.where("p1 <> p2 or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *rest)


def alike(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, node), (kind, depth, c, l)): nodes of one kind have the same depth (roots 1) and the same ancestors c of depth l,
    so any two nodes of two kinds have the same common ancestors. A node that is somebody's ancestor is among its own; any
    other can be common to itself only."""
    up = cut(closure(edges).select("node", "ancestor"))
    depth = cut(depths(edges).where("node is not null").select("node", (F.col("depth") + 1).alias("depth")))
    above = up.union(up.select(F.col("ancestor").alias("node"), "ancestor").distinct())
    sets = above.groupBy("node").agg(F.array_sort(F.collect_set("ancestor")).alias("above"))
    sets = depth.join(sets, "node", "left").withColumn("kind", F.md5(F.to_json(F.struct("depth", "above"))))
    kinds = cut(sets.select("kind", "node", "depth", "above"))
    one = kinds.groupBy("kind").agg(F.first("depth").alias("depth"), F.first("above").alias("above"))
    ends = one.select("kind", "depth", F.explode("above").alias("c")).join(depth.select(F.col("node").alias("c"), F.col("depth").alias("l")), "c")
    return kinds.select("kind", "node"), cut(ends.select("kind", "depth", "c", "l"))


def kind_scores(ends: DataFrame) -> DataFrame:
    """(k1, k2, score) of kinds k1 <= k2 with a common ancestor."""
    side = lambda i: ends.select(F.col("kind").alias(f"k{i}"), F.col("depth").alias(f"d{i}"), "c", *(["l"] if i == 1 else []))
    return side(1).join(side(2), "c").where("k1 <= k2").groupBy("k1", "k2").agg(F.max(2 * F.col("l") / (F.col("d1") + F.col("d2"))).alias("score"))


def wu_palmer(edges: DataFrame, pairs: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, score) of pairs (a, b), or of all pairs a < b of nodes: twice the depth of the deepest common ancestor over the sum
    of the depths, roots having depth 1; 0 for pairs without a common ancestor. Kinds of nodes are scored, and rounded if
    digits are given, so a pair takes a look-up."""
    nodes, ends = alike(edges)
    scores = kind_scores(ends)
    scores = cut(scores.withColumn("score", F.round("score", digits)) if digits is not None else scores)
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    if pairs is None:
        held, kinds = in_parts(nodes), nodes.select("kind").distinct()
        every = kinds.toDF("k1").crossJoin(kinds.toDF("k2")).where("k1 <= k2").join(scores, ["k1", "k2"], "left").select("k1", "k2", score)
        return crossed(every, held, held, unordered=True).select("a", "b", "score")
    of = lambda c, k: nodes.select(F.col("node").alias(c), F.col("kind").alias(k))
    met = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2"))
    return met.join(scores, ["k1", "k2"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(score).alias("score"))


def structural_scores(scores: DataFrame, edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """(entity1, entity2, score, above, below) of scored pairs: the best score of a pair of their parents, and of their
    children; null where none is scored."""
    e1, e2 = edges1.select(F.col("child").alias("c1"), F.col("parent").alias("p1")), edges2.select(F.col("child").alias("c2"), F.col("parent").alias("p2"))
    parents = scores.select(F.col("entity1").alias("p1"), F.col("entity2").alias("p2"), F.col("score").alias("above"))
    # from the scored pairs up, so a pair of parents isn't spread over all pairs of their children
    above = scores.select(F.col("entity1").alias("c1"), F.col("entity2").alias("c2")).join(e1, "c1").join(e2, "c2").join(parents, ["p1", "p2"]).groupBy(F.col("c1").alias("entity1"), F.col("c2").alias("entity2")).agg(F.max("above").alias("above"))
    below = scores.select(F.col("entity1").alias("c1"), F.col("entity2").alias("c2"), "score").join(e1, "c1").join(e2, "c2").groupBy(F.col("p1").alias("entity1"), F.col("p2").alias("entity2")).agg(F.max("score").alias("below"))
    return scores.join(above, ["entity1", "entity2"], "left").join(below, ["entity1", "entity2"], "left").select("entity1", "entity2", "score", "above", "below")


def expanded(pairs: DataFrame, edges1: DataFrame, edges2: DataFrame) -> DataFrame:
    """Distinct (entity1, entity2) of parents by parents and children by children of pairs, without pairs themselves.

    Children that have the same parents come in the same pairs, so pairs of such kinds are made distinct instead of pairs of
    children. Children that are in pairs themselves are kinds of their own; only theirs are compared with pairs."""
    pairs = cut(pairs.select("entity1", "entity2").distinct())
    e1, e2 = edges1.select(F.col("child").alias("c1"), F.col("parent").alias("p1")).distinct(), edges2.select(F.col("child").alias("c2"), F.col("parent").alias("p2")).distinct()
    up = pairs.select(F.col("entity1").alias("c1"), F.col("entity2").alias("c2")).join(e1, "c1").join(e2, "c2").select(F.col("p1").alias("entity1"), F.col("p2").alias("entity2")).distinct()

    def kinds(edges: DataFrame, c: str, p: str, own: str) -> DataFrame:
        sets = edges.join(pairs.select(F.col(own).alias(p)).distinct(), p, "left_semi").groupBy(F.col(c).alias("node")).agg(F.array_sort(F.collect_set(p)).alias("above"))
        named = sets.join(pairs.select(F.col(own).alias("node"), F.lit(True).alias("own")).distinct(), "node", "left").select("node", F.coalesce("own", F.lit(False)).alias("own"), "above")
        return cut(named.withColumn("kind", F.md5(F.to_json(F.struct("own", "above")))))

    a, b = kinds(e1, "c1", "p1", "entity1"), kinds(e2, "c2", "p2", "entity2")
    of = lambda k, i: k.groupBy("kind").agg(F.first("own").alias(f"own{i}"), F.first("above").alias("above")).select(F.col("kind").alias(f"k{i}"), f"own{i}", F.explode("above").alias(f"entity{i}"))
    met = cut(pairs.join(of(a, 1), "entity1").join(of(b, 2), "entity2").select("k1", "k2", (F.col("own1") & F.col("own2")).alias("own")).distinct())
    left, right = in_parts(a.select("kind", "node")), in_parts(b.select("kind", "node"))
    down = lambda own: crossed(met.where(F.col("own") == own).select("k1", "k2"), left, right).toDF("entity1", "entity2")
    # what is above is in what is below if its kinds meet
    kind = lambda k, i: k.select(F.col("node").alias(f"n{i}"), F.col("kind").alias(f"k{i}"))
    above = up.join(kind(a, 1), F.col("entity1").eqNullSafe(F.col("n1")), "left").join(kind(b, 2), F.col("entity2").eqNullSafe(F.col("n2")), "left").join(met, ["k1", "k2"], "left_anti").select("entity1", "entity2")
    rest = above.union(down(True)).join(pairs, ["entity1", "entity2"], "left_anti")
    return rest.union(down(False))


def extend(mappings: DataFrame, edges1: DataFrame, edges2: DataFrame, scorer, least: float = 0.9, rounds: int = 1) -> DataFrame:
    """mappings (entity1, entity2, score) and what rounds of expanded() around confident ones add: scorer gives a table of
    pairs their score, and pairs of least and more are the next frontier. No pair is scored twice."""
    seen = cut(mappings.select("entity1", "entity2", "score"))
    kept, frontier = seen, seen.where(F.col("score") >= least)
    for _ in range(rounds):
        new = expanded(frontier, edges1, edges2).join(seen, ["entity1", "entity2"], "left_anti")
        scored = cut(scorer(new).select("entity1", "entity2", "score"))
        frontier = scored.where(F.col("score") >= least)
        if frontier.isEmpty():
            break
        kept, seen = kept.union(frontier), seen.union(scored)
    return kept


def path_conflicts(predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """Predictions (entity1, entity2, score) without those that lose: of two classes on one root path, that is an ancestor
    and its descendant, mapped to one class, the lower score goes; equal scores both stay."""
    up = closure(edges)
    line = up.select(F.col("node").alias("x"), F.col("ancestor").alias("y"))
    line = line.union(line.select("y", "x"))
    better = predictions.select(F.col("entity1").alias("y"), "entity2", F.col("score").alias("other"))
    lost = predictions.join(line.withColumnRenamed("x", "entity1"), "entity1").join(better, ["y", "entity2"]).where("score < other").select("entity1", "entity2").distinct()
    return predictions.join(lost, ["entity1", "entity2"], "left_anti")
