"""The catalogue: each query applies operators to whole test tables; SQL holds the same for DuckDB where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import blocking, corpus, evaluate, graph, lexicon, select
from ..sources import ontology as onto
from . import matchers, views
from .views import GEO, GEO_SUPPLIERS, UP, table
from .views import SQL as LABELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- blocking and joins ---------------------------------------------------------------------------------------------
@query(f"WITH {LABELS} SELECT DISTINCT s.iri AS entity1, t.iri AS entity2 FROM s JOIN t ON lower(s.label) = lower(t.label)")
def exact_label_match(spark, d):
    return blocking.exact_labels(views.source_labels(spark, d), views.target_labels(spark, d))


@query(f"WITH {LABELS}, a AS (SELECT iri, label FROM s UNION SELECT iri, label FROM t) SELECT lower(label) AS label, count(DISTINCT iri) AS n, min(iri) AS first_iri FROM a GROUP BY lower(label) HAVING count(DISTINCT iri) > 1")
def repeated_labels(spark, d):
    both = views.source_labels(spark, d).select("iri", "label").union(views.target_labels(spark, d).select("iri", "label"))
    return corpus.repeated_labels(both)


@query("""WITH l AS (SELECT DISTINCT o_custkey AS iri, lower(o_orderpriority) AS label FROM orders), g AS (SELECT iri, string_agg(label, '|' ORDER BY label) AS labels FROM l GROUP BY iri)
SELECT labels, count(*) AS n, min(iri) AS first_iri, max(iri) AS last_iri FROM g GROUP BY labels""")
def cluster_by_label_set(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_custkey").alias("iri"), F.col("o_orderpriority").alias("label"))
    return corpus.label_clusters(labels).select(F.array_join("labels", "|").alias("labels"), "n", F.array_min("iris").alias("first_iri"), F.array_max("iris").alias("last_iri"))


LEV = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"
NEAR = f"""a AS (SELECT DISTINCT lower(label) AS l1 FROM s), b AS (SELECT DISTINCT lower(label) AS l2 FROM t),
near AS (SELECT l1, l2, {LEV.format("l1", "l2")} AS score FROM a, b WHERE {LEV.format("l1", "l2")} >= 0.7)"""
SCORES = f"""{NEAR}, sc AS (SELECT x.iri AS entity1, y.iri AS entity2, max(score) AS score FROM near JOIN s x ON lower(x.label) = l1 JOIN t y ON lower(y.label) = l2 GROUP BY ALL)"""


def near_scores(spark, d):
    s, t = views.source_labels(spark, d), views.target_labels(spark, d)
    return blocking.class_scores(s, t, blocking.near_labels(s, t, 0.7))


@query(f"WITH {LABELS}, {NEAR} SELECT l1, l2, round(score, 6) AS score FROM near")
def levenshtein_theta_join(spark, d):
    return blocking.near_labels(views.source_labels(spark, d), views.target_labels(spark, d), 0.7).withColumn("score", F.round("score", 6))


@query(f"WITH {LABELS}, {SCORES} SELECT entity1, entity2, round(score, 6) AS score FROM sc")
def class_pair_scores(spark, d):
    return near_scores(spark, d).withColumn("score", F.round("score", 6))


TOKENS = "regexp_split_to_array(lower(regexp_replace(label, '[^\\p{L}\\p{N}\\s]', ' ', 'g')), '\\s+')"


@query(f"""WITH {LABELS}, st AS (SELECT iri AS entity1, unnest({TOKENS}) AS token FROM s), tt AS (SELECT iri AS entity2, unnest({TOKENS}) AS token FROM t),
w AS (SELECT token, log10((SELECT count(DISTINCT entity2) FROM tt)::DOUBLE / count(*)) AS idf FROM tt GROUP BY token),
c AS (SELECT entity1, entity2, sum(idf) AS score FROM st JOIN tt USING (token) JOIN w USING (token) GROUP BY entity1, entity2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity1 ORDER BY round(score, 9) DESC, entity2)::INTEGER AS rank FROM c)
SELECT entity1, entity2, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def idf_candidates_topk(spark, d):
    return blocking.idf_candidates(views.source_labels(spark, d), views.target_labels(spark, d), 5).withColumn("score", F.round("score", 6))


def _weights(t: str) -> str:
    return f"""{t}w AS (SELECT iri, token, count(*) AS n FROM (SELECT iri, unnest({TOKENS}) AS token FROM {t}) GROUP BY iri, token),
{t}d AS (SELECT token, (SELECT count(DISTINCT iri) FROM {t})::DOUBLE / count(*) AS idf FROM {t}w GROUP BY token),
{t}r AS (SELECT iri, token, n, ln(0.5 + 0.5 * n / sum(n) OVER (PARTITION BY iri) + 1) * ln(idf) AS r FROM {t}w JOIN {t}d USING (token)),
{t}v AS (SELECT iri, token, n, CASE WHEN sum(r * n) OVER (PARTITION BY iri) > 0 THEN r / sqrt(sum(r * n) OVER (PARTITION BY iri)) ELSE 0 END AS v FROM {t}r)"""


@query(f"WITH {LABELS}, {_weights('s')}, {_weights('t')} SELECT a.iri AS entity1, b.iri AS entity2, round(sum(a.n * a.v * b.v), 6) AS score FROM sv a JOIN tv b USING (token) GROUP BY ALL")
def soft_tfidf_scores(spark, d):
    return blocking.soft_tfidf(views.source_labels(spark, d), views.target_labels(spark, d)).withColumn("score", F.round("score", 6))


@query()
def soft_tfidf_like_words(spark, d):
    s, t = views.source_labels(spark, d), views.target_labels(spark, d)
    words = lambda x: blocking.postings(x).select(F.col("token").alias("label")).distinct()
    like = blocking.near_labels(words(s), words(t), 0.6).select(F.col("l1").alias("w1"), F.col("l2").alias("w2"), "score")
    return blocking.soft_tfidf(s, t, like).withColumn("score", F.round("score", 6))


GRAMS = "SELECT DISTINCT lower(label) AS {0}, unnest([lower(label)[i:i + 2] FOR i IN range(1, length(label) - 1)]) AS g FROM {1}"


@query(f"""WITH {LABELS}, a AS ({GRAMS.format("l1", "s")}), b AS ({GRAMS.format("l2", "t")}), na AS (SELECT l1, count(*) AS n1 FROM a GROUP BY l1), nb AS (SELECT l2, count(*) AS n2 FROM b GROUP BY l2),
x AS (SELECT l1, l2, count(*) AS c FROM a JOIN b USING (g) GROUP BY l1, l2)
SELECT l1, l2, round(c / (n1 + n2 - c), 6) AS jaccard, round(2 * c / (n1 + n2), 6) AS dice, round(c / sqrt(n1 * n2), 6) AS cosine FROM x JOIN na USING (l1) JOIN nb USING (l2)""")
def gram_similarities(spark, d):
    found = blocking.gram_pairs(views.source_labels(spark, d), views.target_labels(spark, d))
    return found.select("l1", "l2", *[F.round(c, 6).alias(c) for c in ("jaccard", "dice", "cosine")])


NATIONS = "a AS (SELECT n_name AS l1 FROM nation), b AS (SELECT n_name AS l2 FROM nation UNION SELECT r_name FROM region)"


@query(f"WITH {NATIONS} SELECT l1, l2, round(jaro_winkler_similarity(l1, l2), 6) AS score FROM a, b")
def jaro_winkler_pairs(spark, d):
    a, b = table(spark, d, "nation").select(F.col("n_name").alias("l1")), table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select("r_name")).distinct().toDF("l2")
    return a.join(F.broadcast(b)).select("l1", "l2", F.round(similarity.jaro_winkler("l1", "l2"), 6).alias("score"))  # 25 names against 30


@query()
def ngram_pairs(spark, d):
    s, t = views.source_labels(spark, d), views.target_labels(spark, d)
    near = blocking.gram_pairs(s, t).where("jaccard >= 0.2").select("l1", "l2")
    return near.withColumn("score", F.round(similarity.ngram("l1", "l2"), 6))


@query(f"""WITH {LABELS}, st AS (SELECT iri AS entity1, unnest({TOKENS}) AS token FROM s), tt AS (SELECT iri AS entity2, unnest({TOKENS}) AS token FROM t),
w AS (SELECT token, log10((SELECT count(DISTINCT entity2) FROM tt)::DOUBLE / count(*)) AS idf FROM tt GROUP BY token),
c AS (SELECT entity1, entity2, sum(idf) AS score FROM st JOIN tt USING (token) JOIN w USING (token) GROUP BY entity1, entity2),
r AS (SELECT entity1, entity2, row_number() OVER (PARTITION BY entity1 ORDER BY round(score, 9) DESC, entity2) AS rank FROM c QUALIFY rank <= 4),
x AS (SELECT DISTINCT entity1, entity2, rank FROM r JOIN s ON s.iri = entity1 JOIN t ON t.iri = entity2 WHERE lower(s.label) = lower(t.label)),
f AS (SELECT entity1, arg_min(entity2, rank) AS entity2, 1.0::DOUBLE AS score, true AS exact FROM x GROUP BY entity1),
g AS (SELECT entity1, entity2, avg({LEV.format("lower(s.label)", "lower(t.label)")}) AS score, false AS exact FROM r JOIN s ON s.iri = entity1 JOIN t ON t.iri = entity2 WHERE entity1 NOT IN (SELECT entity1 FROM f) GROUP BY ALL)
SELECT entity1, entity2, round(score, 6) AS score, exact FROM (SELECT * FROM f UNION ALL SELECT * FROM g)""")
def exact_short_circuit(spark, d):
    s, t = views.source_labels(spark, d), views.target_labels(spark, d)
    found = blocking.idf_candidates(s, t, 4)
    return blocking.scored_candidates(s, t, found, similarity.levenshtein).withColumn("score", F.round("score", 6))


# ---- selection ------------------------------------------------------------------------------------------------------
BEST = "m AS (SELECT *, max(score) OVER (PARTITION BY entity1) AS r, max(score) OVER (PARTITION BY entity2) AS c FROM sc), mb AS (SELECT entity1, min(entity2) AS entity2, any_value(score) AS score FROM m WHERE score = r AND score = c AND score > 0 GROUP BY entity1)"


@query(f"WITH {LABELS}, {SCORES}, {BEST} SELECT entity1, entity2, round(score, 6) AS score FROM mb")
def mutual_best(spark, d):
    return select.mutual_best(near_scores(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {LABELS}, {SCORES}, {BEST}, k AS (SELECT count(*) AS n, coalesce(sum(score), 0)::DOUBLE AS confidence FROM mb),
q AS (SELECT n, confidence, n::DOUBLE / least((SELECT count(DISTINCT iri) FROM s), (SELECT count(DISTINCT iri) FROM t)) AS r, CASE WHEN n > 0 THEN confidence / n ELSE 0 END AS p FROM k)
SELECT n, round(confidence, 4) AS confidence, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END, 6) AS f1 FROM q""")
def pseudo_metrics(spark, d):
    n, m = (f(spark, d).select("iri").distinct().count() for f in (views.source_labels, views.target_labels))
    got = select.pseudo_metrics(near_scores(spark, d), n, m)
    return got.select("n", F.round("confidence", 4).alias("confidence"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(f"WITH {LABELS}, {SCORES} SELECT entity1, entity2, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY entity2 ORDER BY score DESC, entity1) = 1 AND score >= 0.8")
def argmax_smaller_side(spark, d):
    return select.best_per(near_scores(spark, d), "entity2", "entity1", 0.8).withColumn("score", F.round("score", 6))


@query(f"WITH {LABELS}, {SCORES} SELECT entity1, entity2, round(score, 6) AS score FROM sc QUALIFY score >= 0.95 OR (max(score) OVER (PARTITION BY entity1) < 0.95 AND row_number() OVER (PARTITION BY entity1 ORDER BY score DESC, entity2) = 1)")
def greedy_threshold_or_best(spark, d):
    return select.all_or_best(near_scores(spark, d), 0.95).withColumn("score", F.round("score", 6))


@query(f"WITH {LABELS}, {SCORES} SELECT entity1, entity2, round(score, 6) AS score, row_number() OVER (PARTITION BY entity1 ORDER BY score DESC, entity2)::INTEGER AS rank FROM sc WHERE score >= 0.75 QUALIFY rank <= 3")
def n_best(spark, d):
    return blocking.n_best(near_scores(spark, d), 3, 0.75).withColumn("score", F.round("score", 6))


UNCOVERED = "SELECT entity1, entity2, score FROM {0} WHERE entity1 NOT IN (SELECT entity1 FROM {1}) OR entity2 NOT IN (SELECT entity2 FROM {1})"


@query(f"""WITH {LABELS}, {SCORES}, lx AS (SELECT * FROM sc WHERE score >= 0.8), sm AS (SELECT DISTINCT entity1, entity2, 1.0 AS score FROM (SELECT iri AS entity1, lower(label) AS l FROM s) JOIN (SELECT iri AS entity2, lower(label) AS l FROM t WHERE pos = 1) USING (l)
UNION SELECT entity1, min(entity2), 0.97 FROM sc WHERE score >= 0.99 GROUP BY entity1),
ag AS (SELECT entity1, entity2, 1.0 AS score FROM lx WHERE (entity1, entity2) IN (SELECT (entity1, entity2) FROM sm)), op AS ({UNCOVERED.format("sm", "ag")}), cv AS (SELECT * FROM ag UNION ALL SELECT * FROM op),
al AS ({UNCOVERED.format("(SELECT * FROM lx WHERE score > 0.85)", "cv")}), u AS (SELECT * FROM cv UNION ALL SELECT * FROM al)
SELECT entity1, entity2, round(max(score), 6)::DOUBLE AS score FROM u GROUP BY ALL""")
def meta_rule_combination(spark, d):
    scores = graph.cut(near_scores(spark, d))
    t = views.target_labels(spark, d).where("pos = 1")
    semantic = blocking.exact_labels(views.source_labels(spark, d), t).withColumn("score", F.lit(1.0)).union(scores.where("score >= 0.99").groupBy("entity1").agg(F.min("entity2").alias("entity2")).withColumn("score", F.lit(0.97))).distinct()
    semantic = graph.cut(semantic)
    return select.rule_combination(select.at_least(scores, 0.8), semantic, 0.85).withColumn("score", F.round("score", 6))


@query(f"""WITH {LABELS}, {SCORES}, ex AS (SELECT DISTINCT a.iri AS entity1, b.iri AS entity2, 1.0 AS score FROM s a JOIN t b ON lower(a.label) = lower(b.label)), hi AS (SELECT * FROM sc WHERE score >= 0.8)
SELECT 'all' AS part, count(*) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM hi) UNION ALL SELECT 'distinct', count(*) FROM (SELECT entity1, entity2 FROM ex UNION SELECT entity1, entity2 FROM hi)
UNION ALL SELECT 'both', count(*) FROM (SELECT entity1, entity2 FROM ex INTERSECT SELECT entity1, entity2 FROM hi) UNION ALL SELECT 'beyond', count(*) FROM (SELECT entity1, entity2 FROM hi EXCEPT SELECT entity1, entity2 FROM ex)
UNION ALL SELECT 'anchored', count(*) FROM (SELECT entity1, entity2 FROM hi UNION ALL (SELECT entity1, entity2 FROM ex EXCEPT SELECT entity1, entity2 FROM hi))""")
def alignment_algebra(spark, d):
    exact = blocking.exact_labels(views.source_labels(spark, d), views.target_labels(spark, d)).withColumn("score", F.lit(1.0))
    high = select.at_least(near_scores(spark, d), 0.8)
    sets = {"all": select.union_all(exact, high), "distinct": select.union_distinct(exact, high), "both": select.intersection(exact, high), "beyond": select.difference(high, exact), "anchored": select.with_anchors(high, exact)}
    return select.union_all(*(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in sets.items()))


@query(f"""WITH {LABELS}, {SCORES}, fw AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY entity1 ORDER BY score DESC, entity2) = 1), bw AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY entity2 ORDER BY score DESC, entity1) = 1)
SELECT entity1, entity2, round(max(score), 6) AS score FROM (SELECT * FROM fw UNION ALL SELECT * FROM bw) GROUP BY ALL""")
def both_directions(spark, d):
    scores = near_scores(spark, d)
    backward = select.best_per(scores, "entity2", "entity1").select(F.col("entity2").alias("entity1"), F.col("entity1").alias("entity2"), "score")
    return select.both_directions(select.best_per(scores), backward).withColumn("score", F.round("score", 6))


@query(f"""WITH {LABELS}, {SCORES}, x AS (SELECT entity1, entity2, score FROM sc WHERE NOT ((entity1 LIKE '%red%' AND entity2 LIKE '%blue%') OR (entity1 LIKE '%hot%' AND entity2 LIKE '%cold%')))
SELECT entity1, entity2, round(score, 6) AS score FROM x""")
def branch_conflicts(spark, d):
    rules = spark.createDataFrame([("red", "blue"), ("hot", "cold")], "part1 string, part2 string")
    named = lambda f: f(spark, d).select("iri", F.col("iri").alias("name")).distinct()
    return select.branch_conflicts(near_scores(spark, d), rules, named(views.source_labels), named(views.target_labels)).withColumn("score", F.round("score", 6))


# ---- graphs ---------------------------------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {GEO}, {UP} SELECT node, ancestor, min(d)::INTEGER AS near, max(d)::INTEGER AS far FROM up GROUP BY node, ancestor")
def taxonomy_closure(spark, d):
    return graph.closure(views.geography(spark, d))


@query(f"WITH RECURSIVE {GEO}, {UP} SELECT x.node, coalesce(max(d), 0)::INTEGER AS depth FROM (SELECT child AS node FROM e UNION SELECT parent FROM e) x LEFT JOIN up ON up.node = x.node AND up.ancestor LIKE 'r:%' GROUP BY x.node")
def taxonomy_depth(spark, d):
    return graph.depths(views.geography(spark, d)).withColumn("depth", F.col("depth").cast("int"))


@query(f"WITH RECURSIVE {GEO}, w AS (SELECT child AS node, child || '>' || parent AS path, parent AS top FROM e UNION ALL SELECT w.node, w.path || '>' || e.parent, e.parent FROM w JOIN e ON e.child = w.top) SELECT node, path FROM w WHERE top LIKE 'r:%' UNION ALL SELECT DISTINCT parent, parent FROM e WHERE parent LIKE 'r:%'")
def root_path(spark, d):
    return graph.root_paths(views.geography(spark, d)).select("node", F.array_join("path", ">").alias("path"))


@query(f"WITH {GEO} SELECT child, parent FROM e WHERE parent IN ('r:1', 'r:2') OR parent IN (SELECT child FROM e WHERE parent IN ('r:1', 'r:2'))")
def subtree_filter(spark, d):
    return graph.subtree(views.geography(spark, d), spark.createDataFrame([("r:1",), ("r:2",)], "node string"))


@query(f"""WITH RECURSIVE {GEO_SUPPLIERS}, {UP}, nd AS (SELECT child AS node FROM e UNION SELECT parent FROM e), dp AS (SELECT nd.node, 1 + coalesce(max(d), 0) AS depth FROM nd LEFT JOIN up ON up.node = nd.node GROUP BY nd.node),
su AS (SELECT node, ancestor FROM up UNION SELECT node, node FROM nd), pr AS (SELECT a.node AS a, b.node AS b FROM nd a, nd b WHERE a.node < b.node),
lc AS (SELECT a, b, max(dp.depth) AS l FROM pr JOIN su x ON x.node = a JOIN su y ON y.node = b AND y.ancestor = x.ancestor JOIN dp ON dp.node = x.ancestor GROUP BY a, b)
SELECT a, b, round(coalesce(2.0 * l / (p.depth + q.depth), 0), 6)::DOUBLE AS score FROM pr JOIN dp p ON p.node = a JOIN dp q ON q.node = b LEFT JOIN lc USING (a, b)""")
def wu_palmer(spark, d):
    return graph.wu_palmer(views.geography(spark, d, customers=False), digits=6)


@query(f"""WITH RECURSIVE {GEO}, {UP}, nd AS (SELECT child AS node FROM e UNION SELECT parent FROM e), dp AS (SELECT nd.node, 1 + coalesce(max(d), 0) AS depth FROM nd LEFT JOIN up ON up.node = nd.node GROUP BY nd.node),
su AS (SELECT node, ancestor FROM up UNION SELECT node, node FROM nd),
se AS (SELECT 's' || s_suppkey % 40 AS word, 's:' || s_suppkey AS node FROM supplier UNION SELECT lower(n_name), 'n:' || n_nationkey FROM nation UNION SELECT c_mktsegment || c_custkey % 60, 'c:' || c_custkey FROM customer),
ws AS (SELECT word, ancestor, a.depth AS d, c.depth AS l FROM se JOIN su USING (node) JOIN dp a USING (node) JOIN dp c ON c.node = su.ancestor)
SELECT x.word AS w1, y.word AS w2, round(max(2.0 * x.l / (x.d + y.d)), 6)::DOUBLE AS score FROM ws x JOIN ws y USING (ancestor)
WHERE x.word LIKE 's%' AND y.word NOT LIKE 's%' GROUP BY x.word, y.word HAVING max(2.0 * x.l / (x.d + y.d)) >= 0.66""")
def words_alike_by_senses(spark, d):
    sense = lambda t, word, prefix, key: table(spark, d, t).select(word.alias("word"), F.concat(F.lit(prefix), key).alias("synset"))
    senses = sense("supplier", F.concat(F.lit("s"), F.col("s_suppkey") % 40), "s:", "s_suppkey")
    senses = senses.union(sense("nation", F.lower("n_name"), "n:", "n_nationkey"))
    senses = senses.union(sense("customer", F.concat("c_mktsegment", F.col("c_custkey") % 60), "c:", "c_custkey"))
    first = F.col("word").startswith("s")
    return lexicon.like_words(senses.where(first), senses.where(~first), senses, views.geography(spark, d), 0.66).withColumn("score", F.round("score", 6))


LEXICAL = f"""l1 AS (SELECT 'n:' || n_nationkey AS n, n_name AS l FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region), lx AS (SELECT x.n AS entity1, y.n AS entity2, {LEV.format("x.l", "y.l")} AS score FROM l1 x JOIN l1 y ON x.n[1] = y.n[1])"""


def geo_scores(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("n"), F.col("n_name").alias("l")).union(table(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey"), "r_name"))
    a, b = names.toDF("entity1", "x").withColumn("k", F.substring("entity1", 1, 1)), names.toDF("entity2", "y").withColumn("k", F.substring("entity2", 1, 1))
    return a.join(b, "k").select("entity1", "entity2", similarity.levenshtein(F.col("x"), F.col("y")).alias("score"))


@query(f"""WITH {GEO}, {LEXICAL}, ab AS (SELECT x.entity1, x.entity2, max(y.score) AS above FROM lx x JOIN e c ON c.child = x.entity1 JOIN e k ON k.child = x.entity2 JOIN lx y ON y.entity1 = c.parent AND y.entity2 = k.parent GROUP BY ALL),
be AS (SELECT c.parent AS entity1, k.parent AS entity2, max(score) AS below FROM lx JOIN e c ON c.child = entity1 JOIN e k ON k.child = entity2 GROUP BY ALL)
SELECT entity1, entity2, round(score + 0.1 * coalesce(above, 0) + 0.3 * coalesce(below, 0), 6) AS score FROM lx LEFT JOIN ab USING (entity1, entity2) LEFT JOIN be USING (entity1, entity2)""")
def structural_similarity(spark, d):
    edges = views.geography(spark, d)
    got = graph.structural_scores(geo_scores(spark, d), edges, edges)
    return got.select("entity1", "entity2", F.round(similarity.structural(F.col("score"), F.col("above"), F.col("below")), 6).alias("score"))


@query(f"""WITH {GEO_SUPPLIERS}, {LEXICAL}, p AS (SELECT entity1, entity2 FROM lx WHERE score >= 0.9), x AS (SELECT c.parent AS entity1, k.parent AS entity2 FROM p JOIN e c ON c.child = entity1 JOIN e k ON k.child = entity2
UNION SELECT c.child, k.child FROM p JOIN e c ON c.parent = entity1 JOIN e k ON k.parent = entity2) SELECT entity1, entity2 FROM x EXCEPT SELECT entity1, entity2 FROM p""")
def one_hop_extension(spark, d):
    edges = views.geography(spark, d, customers=False)
    return graph.expanded(select.at_least(geo_scores(spark, d), 0.9).select("entity1", "entity2"), edges, edges)


@query(f"WITH {GEO_SUPPLIERS} SELECT a.parent, a.child AS c1, b.child AS c2 FROM e a JOIN e b ON a.parent = b.parent AND a.child < b.child")
def sibling_hard_negatives(spark, d):
    return graph.siblings(views.geography(spark, d, customers=False))


@query(f"""WITH RECURSIVE {GEO}, {UP}, pd AS (SELECT node AS entity1, 'x:' || (ascii(right(node, 1)) % 3) AS entity2, length(node) + (ascii(right(node, 1)) % 5) / 10.0 AS score FROM (SELECT child AS node FROM e UNION SELECT parent FROM e)),
ln AS (SELECT node AS x, ancestor AS y FROM up UNION SELECT ancestor, node FROM up)
SELECT entity1, entity2, round(score, 4)::DOUBLE AS score FROM pd p WHERE NOT EXISTS (SELECT 1 FROM ln JOIN pd q ON q.entity1 = ln.y WHERE ln.x = p.entity1 AND q.entity2 = p.entity2 AND q.score > p.score)""")
def within_path_conflict(spark, d):
    edges = views.geography(spark, d)
    end = F.ascii(F.substring("node", -1, 1))
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    predicted = nodes.select(F.col("node").alias("entity1"), F.concat(F.lit("x:"), (end % 3).cast("string")).alias("entity2"), (F.length("node") + (end % 5) / F.lit(10.0)).alias("score"))
    return graph.path_conflicts(predicted, edges).withColumn("score", F.round("score", 4))


@query("""WITH r AS (SELECT conv_id, turn, length(text) % 4 AS depth FROM conversations)
SELECT a.conv_id, a.turn, a.depth::INTEGER AS depth, max(b.turn) AS parent_order FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.depth < a.depth GROUP BY a.conv_id, a.turn, a.depth""")
def outline_parent(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 4).cast("int").alias("depth"))
    return graph.outline_parents(rows, "conv_id", "turn", "depth")


@query("""WITH RECURSIVE e AS (SELECT conv_id || '/' || turn AS child, conv_id || '/' || (turn - 1) AS parent FROM conversations WHERE turn > 0), w AS (SELECT child AS node, parent AS top, 1 AS d FROM e UNION ALL SELECT w.node, e.parent, d + 1 FROM w JOIN e ON e.child = w.top)
SELECT node, depth FROM (SELECT node, max(d)::INTEGER AS depth FROM w GROUP BY node UNION ALL SELECT DISTINCT parent, 0 FROM e WHERE parent NOT IN (SELECT child FROM e))""")
def turn_chain_depth(spark, d):
    turns = table(spark, d, "conversations").where("turn > 0")
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    return graph.depths(turns.select(name(F.col("turn")).alias("child"), name(F.col("turn") - 1).alias("parent")), longest=False).withColumn("depth", F.col("depth").cast("int"))


# ---- evaluation -----------------------------------------------------------------------------------------------------
PRED = "p AS (SELECT doc_id FROM documents WHERE n_chars >= 800), g AS (SELECT doc_id FROM labels WHERE quality = 1)"


def _evaluated(spark, d):
    return table(spark, d, "documents").where("n_chars >= 800").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")


@query(f"WITH {PRED} SELECT doc_id FROM p WHERE doc_id IN (SELECT doc_id FROM g)")
def true_positives(spark, d):
    return evaluate.true_positives(*_evaluated(spark, d), on=["doc_id"])


@query(f"WITH {PRED} SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM g)")
def false_positives(spark, d):
    return evaluate.false_positives(*_evaluated(spark, d), on=["doc_id"])


@query(f"WITH {PRED} SELECT doc_id FROM g WHERE doc_id NOT IN (SELECT doc_id FROM p)")
def false_negatives(spark, d):
    return evaluate.false_negatives(*_evaluated(spark, d), on=["doc_id"])


@query("""WITH g AS (SELECT doc_id FROM labels WHERE quality = 1), pd AS (SELECT source AS matcher, doc_id FROM documents), h AS (SELECT matcher, count(*) FILTER (doc_id IN (SELECT doc_id FROM g)) AS tp, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) AS fp FROM pd GROUP BY matcher),
q AS (SELECT *, tp / (tp + fp) AS p, tp / (SELECT count(DISTINCT doc_id) FROM g) AS r, (SELECT count(DISTINCT doc_id) FROM g) AS n FROM h)
SELECT matcher, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, tp AS n_tp, fp AS n_fp, n AS n_gold FROM q""")
def matcher_metrics(spark, d):
    predicted = table(spark, d, "documents").select(F.col("source").alias("matcher"), "doc_id")
    got = evaluate.metrics(predicted, table(spark, d, "labels").where("quality = 1"), on=["doc_id"])
    return got.select("matcher", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n_tp", "n_fp", "n_gold")


SCORED = "x AS (SELECT least(n_chars, 4000) / 4000.0 AS score, quality = 1 AS truth FROM documents JOIN labels USING (doc_id))"


def _scored(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.select((F.least(F.col("n_chars"), F.lit(4000)) / 4000.0).alias("score"), (F.col("quality") == 1).alias("truth"))


@query(f"""WITH {SCORED}, t AS (SELECT unnest(range(50))::INTEGER AS step), k AS (SELECT step, count(*) FILTER (floor(score * 50 + 1e-9) >= step AND truth) AS tp, count(*) FILTER (floor(score * 50 + 1e-9) >= step) AS said, count(*) FILTER (truth) AS gold FROM t, x GROUP BY step),
q AS (SELECT step, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN gold > 0 THEN tp / gold ELSE 0 END AS r FROM k)
SELECT step, round(step / 50, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""")
def threshold_sweep(spark, d):
    return evaluate.sweep(_scored(spark, d)).select("step", *[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall", "f1")])


@query(f"""WITH {SCORED}, k AS (SELECT count(*) FILTER (score >= 0.5 AND truth) AS tp, count(*) FILTER (score >= 0.5 AND NOT truth) AS fp, count(*) FILTER (score < 0.5 AND truth) AS fn, count(*) FILTER ((score >= 0.5) = truth) AS ok, count(*) AS n FROM x)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(ok / n, 6) AS accuracy FROM k""")
def point_metrics(spark, d):
    return evaluate.point_metrics(_scored(spark, d), 0.5).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("""WITH pr AS (SELECT DISTINCT doc_id AS entity1, source AS entity2 FROM documents WHERE n_chars >= 800), go AS (SELECT doc_id AS entity1, source AS entity2 FROM documents WHERE n_chars >= 1500), po AS (SELECT doc_id AS entity1, source AS entity2 FROM documents),
k AS (SELECT (SELECT count(*) FROM pr)::DOUBLE AS m, (SELECT count(*) FROM go)::DOUBLE AS g, (SELECT count(*) FROM (SELECT * FROM pr EXCEPT SELECT * FROM go))::DOUBLE AS new, (SELECT count(*) FROM (SELECT * FROM po EXCEPT SELECT * FROM go))::DOUBLE AS pool, (SELECT avg(quality) FROM labels) AS s, (SELECT avg(toxic) FROM labels) AS t),
q AS (SELECT (m - new + s * new) / m AS p, (m - new + s * new) / (g + t * pool) AS r FROM k) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM q""")
def sampled_estimates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entity1"), F.col("source").alias("entity2"), "n_chars")
    labels = table(spark, d, "labels")
    got = evaluate.estimates(docs.where("n_chars >= 800"), docs.where("n_chars >= 1500"), labels.select(F.col("quality").alias("correct")), docs, labels.select(F.col("toxic").alias("correct")))
    return got.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT user_id AS entity1, (event_id % 7)::VARCHAR AS entity2, bool_or(event_type = 'purchase') AS is_correct, bool_or(event_type = 'click') AS click, bool_or(event_type = 'view') AS view, bool_or(event_type = 'signup') AS signup FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def pivot_matchers(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity1"), (F.col("event_id") % 7).cast("string").alias("entity2"), F.col("event_type").alias("matcher"))
    return evaluate.side_by_side(rows.where("matcher in ('click', 'view', 'signup')"), rows.where("matcher = 'purchase'"), ["click", "view", "signup"])


@query("""WITH w AS (SELECT user_id AS entity1, (event_id % 7)::VARCHAR AS entity2, bool_or(event_type = 'purchase') AS is_correct, bool_or(event_type = 'click') AS click, bool_or(event_type = 'view') AS view FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY ALL)
SELECT entity1, entity2, is_correct, click = is_correct AS click, view = is_correct AS view FROM w""")
def matcher_agreement(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity1"), (F.col("event_id") % 7).cast("string").alias("entity2"), F.col("event_type").alias("matcher"))
    return evaluate.agreement(evaluate.side_by_side(rows.where("matcher in ('click', 'view')"), rows.where("matcher = 'purchase'"), ["click", "view"]), ["click", "view"])


@query(f"""WITH {LABELS}, n AS (SELECT iri, arg_min(label, pos) AS label, count(*) AS n FROM t GROUP BY iri), x AS (SELECT DISTINCT a.iri AS entity1, b.iri AS entity2 FROM s a JOIN t b ON lower(a.label) = lower(b.label))
SELECT entity1, entity2, s.label AS source, CASE WHEN n.n = 1 THEN n.label ELSE regexp_extract(n.iri, '([^#/]*)$', 1) END AS target FROM x LEFT JOIN s ON s.iri = entity1 LEFT JOIN n ON n.iri = entity2""")
def first_label_lookup(spark, d):
    s, t = views.source_labels(spark, d).withColumn("label", F.lower("label")), views.target_labels(spark, d)
    return evaluate.with_labels(blocking.exact_labels(s, t), evaluate.first_labels(s), evaluate.first_labels(t, single=True))


@query(f"""WITH {LABELS}, q AS (SELECT DISTINCT p_name AS label FROM part UNION SELECT DISTINCT 's:' || p_brand || '/' || p_name FROM part), o AS (SELECT lower(label) AS k, min(iri) AS iri, count(DISTINCT iri) AS n FROM s GROUP BY lower(label))
SELECT q.label, coalesce(o.iri, i.iri) AS iri, coalesce(o.n, i.n, 0) AS n FROM q LEFT JOIN o ON o.k = lower(q.label) LEFT JOIN (SELECT DISTINCT iri, 1 AS n FROM s) i ON i.iri = q.label""")
def label_to_id_lookup(spark, d):
    s = views.source_labels(spark, d)
    wanted = table(spark, d, "part").select("p_name").distinct().union(s.select("iri")).distinct().toDF("label")
    return evaluate.ids_of_labels(wanted, s)


@query(f"""WITH {LABELS}, w AS (SELECT DISTINCT p_name AS symbol FROM part UNION SELECT '/' || split_part(p_name, ' ', 1) FROM part UNION SELECT 'no such symbol')
SELECT symbol, min(iri) AS iri, count(iri) AS n FROM w LEFT JOIN (SELECT DISTINCT iri FROM s) c ON ends_with(c.iri, symbol) GROUP BY symbol""")
def iri_suffix_search(spark, d):
    name = table(spark, d, "part").select("p_name")
    wanted = name.union(name.select(F.concat(F.lit("/"), F.substring_index("p_name", " ", 1)))).union(spark.createDataFrame([("no such symbol",)], "p_name string"))
    return evaluate.ids_of_suffixes(wanted.distinct().toDF("symbol"), views.source_labels(spark, d))


@query("""SELECT 'supplier' AS tab, count(*) AS missing FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) UNION ALL SELECT 'labels', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'customer', count(*) FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def constraint_checks(spark, d):
    checks = {"supplier": evaluate.missing(table(spark, d, "supplier"), table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "s_nationkey", "k"), "labels": evaluate.missing(table(spark, d, "labels"), table(spark, d, "documents").select(F.col("doc_id").alias("k")), "doc_id", "k"), "customer": evaluate.missing(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "c_custkey", "k")}
    return select.union_all(*(df.agg(F.count("*").alias("missing")).select(F.lit(k).alias("tab"), "missing") for k, df in checks.items()))


# ---- text functions -------------------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT p_brand AS id, string_agg(p_name || ' (' || p_size || '.5)', '; ' ORDER BY p_name || ' (' || p_size || '.5)') AS cell FROM (SELECT DISTINCT p_brand, p_name, p_size FROM part) GROUP BY p_brand),
x AS (SELECT id, unnest(regexp_extract_all(cell, ';?\\s*(.*?)\\s*\\(\\d+\\.?\\d*\\)', 1)) AS label, unnest(regexp_extract_all(cell, '\\((\\d+\\.?\\d*)\\)', 1))::DOUBLE AS score FROM c) SELECT * FROM x""")
def parse_scored_labels(spark, d):
    cells = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("p_name", F.lit(" ("), "p_size", F.lit(".5)")))), "; ").alias("cell"))
    return cells.select("id", F.explode(text.scored_labels(F.col("cell"))).alias("x")).select("id", "x.label", "x.score")


@query("""SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS tail, regexp_extract(url, '^(.*[#/])?', 0) AS base, CASE WHEN starts_with(url, 'https://') THEN 'web:' || url[9:] WHEN starts_with(url, 'http://') THEN 'old:' || url[8:] ELSE url END AS short FROM pages""")
def iri_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", text.iri_tail(url).alias("tail"), text.iri_base(url).alias("base"), text.abbreviate(url, {"web": "https://", "old": "http://"}).alias("short"))


@query("SELECT p_partkey, regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g') AS words FROM (SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], '') || 'Type' AS x FROM part)")
def camel_case_split(spark, d):
    name = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("Type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.camel_words(name), " ").alias("words"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\"', ''), '\"(@\\w+)?$', ''), '^\\{(.*)\\}$', '\\1'), '\\(.*\\)', '', 'g'), '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def label_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_literal(F.col("text"))).alias("cleaned"))


@query("""SELECT p_partkey, lower(replace(trim(p_name), '_', ' ')) AS normal, replace(replace(p_brand || ' 1/2', '/', '-'), ' ', '') AS path, url_encode(p_name || ' a') AS quoted, array_to_string((string_split(p_name, ' ') || ['-', '-', '-'])[1:3], '|') AS padded, printf('%.3f', p_retailprice) AS fixed FROM part""")
def text_normalisers(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", text.normal(F.col("p_name")).alias("normal"), text.symbol_to_path(F.concat("p_brand", F.lit(" 1/2"))).alias("path"), text.quote(F.concat("p_name", F.lit(" a"))).alias("quoted"), F.array_join(text.padded(F.split("p_name", " "), 3, F.lit("-")), "|").alias("padded"), text.fixed(F.col("p_retailprice")).alias("fixed"))


@query()
def stemmed_vocabulary(spark, d):
    tokens = table(spark, d, "documents").where("lang = 'en'").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return tokens.withColumn("stem", text.porter_stem("word")).groupBy("stem").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


# ---- vectors --------------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM e GROUP BY label, i), k AS (SELECT label, list(v ORDER BY i) AS vec FROM c GROUP BY label),
x AS (SELECT vec_id, k.label AS label, list_cosine_similarity(embedding::DOUBLE[], vec) AS s, list_distance(embedding::DOUBLE[], vec) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + sqrt(list_inner_product(vec, vec))) AS dist FROM embeddings, k)
SELECT vec_id, label, round(s, 5) AS cosine, round(dist, 5) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label)::INTEGER AS rank FROM x QUALIFY rank <= 3""")
def vector_centroid_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    mean = corpus.centroids(vectors, "label", "embedding")
    small = F.broadcast(mean) if mean.count() <= 1000 else mean
    scored = vectors.select("vec_id", "embedding").join(small).select("vec_id", "label", similarity.cosine(F.col("embedding"), F.col("vec")).alias("s"), similarity.relative_distance(F.col("embedding"), F.col("vec")).alias("distance"))
    top = blocking.top_k(scored, "vec_id", 3, F.desc(F.round("s", 9)), "label")
    return top.select("vec_id", "label", F.round("s", 5).alias("cosine"), F.round("distance", 5).alias("distance"), "rank")


# ---- corpora --------------------------------------------------------------------------------------------------------
def chance_sql(seed: str, *keys: str) -> str:
    return f"('0x' || md5(concat_ws(':', '{seed}', {', '.join(keys)}))[1:8])::BIGINT / 4294967296.0"


@query(f"SELECT p_partkey, p_name FROM part ORDER BY {chance_sql('0', 'p_partkey')}, p_partkey LIMIT 100")
def seeded_sample(spark, d):
    return corpus.sample(table(spark, d, "part").select("p_partkey", "p_name"), 100, 0, "p_partkey")


@query(f"SELECT p_partkey, CASE WHEN {chance_sql('7', 'p_partkey')} < 0.2 THEN 'validation' ELSE 'training' END AS part FROM part")
def train_validation_split(spark, d):
    train, valid = corpus.split(table(spark, d, "part").select("p_partkey"), 0.2, 7, "p_partkey")
    return train.withColumn("part", F.lit("training")).union(valid.withColumn("part", F.lit("validation")))


@query("WITH l AS (SELECT DISTINCT p_brand || '/' || p_type AS iri, lower(p_name) AS label FROM part) SELECT DISTINCT a.label AS l1, b.label AS l2 FROM l a JOIN l b ON a.iri = b.iri AND a.label <> b.label")
def synonym_pairs(spark, d):
    return corpus.synonyms(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("iri"), F.col("p_name").alias("label")))


@query(f"""WITH {LABELS}, u AS (SELECT iri, lower(label) AS label FROM s UNION SELECT iri, lower(label) FROM t), l AS (SELECT DISTINCT label FROM u), k AS (SELECT count(*) AS n FROM l),
pos AS (SELECT label AS l1, label AS l2, 'identity' AS kind FROM l UNION ALL SELECT DISTINCT a.label, b.label, 'synonym' FROM u a JOIN u b ON a.iri = b.iri AND a.label <> b.label),
dr AS (SELECT label AS l1, floor({chance_sql("5", "label", "r")} * n)::BIGINT AS place FROM l, k, range(1, 3) x(r)), pl AS (SELECT label AS l2, floor({chance_sql("5/place", "label")} * n)::BIGINT AS place FROM l, k),
neg AS (SELECT DISTINCT l1, l2 FROM dr JOIN pl USING (place) WHERE l1 <> l2), ok AS (SELECT * FROM neg WHERE (l1, l2) NOT IN (SELECT (l1, l2) FROM pos) AND (l2, l1) NOT IN (SELECT (l1, l2) FROM pos))
SELECT l1, l2, kind, 1 AS label FROM pos UNION ALL SELECT l1, l2, 'soft', 0 FROM ok""")
def merged_corpus(spark, d):
    return corpus.merged_corpus(views.source_labels(spark, d), views.target_labels(spark, d), n_soft=2, seed=5)


@query(f"WITH RECURSIVE {GEO}, {UP} SELECT (SELECT max(length(p_name)) FROM part) AS longest_label, max(d)::INTEGER AS deepest FROM up")
def label_stats(spark, d):
    labels = table(spark, d, "part").select(F.col("p_name").alias("label"))
    return corpus.label_stats(labels, graph.depths(views.geography(spark, d))).select(F.col("longest_label").cast("long").alias("longest_label"), F.col("deepest").cast("int").alias("deepest"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS id, lower(o_orderpriority) AS l FROM orders), c AS (SELECT id, list(l ORDER BY l) AS labels FROM o GROUP BY id), k AS (SELECT ['1-urgent', '2-high'] AS cluster UNION ALL SELECT ['4-not specified', '5-low']),
x AS (SELECT id, labels, unnest(cluster) AS l FROM c JOIN k ON list_has_any(labels, cluster)) SELECT id, string_agg(DISTINCT l, '|' ORDER BY l) AS missing FROM x WHERE NOT list_contains(labels, l) GROUP BY id""")
def cluster_gaps(spark, d):
    cells = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.lower("o_orderpriority"))).alias("labels"))
    clusters = spark.createDataFrame([(["1-urgent", "2-high"],), (["4-not specified", "5-low"],)], "labels array<string>")
    return corpus.cluster_gaps(cells, clusters).select("id", F.array_join("missing", "|").alias("missing"))


# ---- triples --------------------------------------------------------------------------------------------------------
TRIPLES = """tr AS (SELECT 'n:' || n_nationkey AS s, 'type' AS p, 'Concept' AS o FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'type', 'Concept' FROM region UNION ALL SELECT 'n:' || n_nationkey, 'label', '"' || n_name || ' (x)"@en' FROM nation
UNION ALL SELECT 'n:' || n_nationkey, 'broader', 'r:' || n_regionkey FROM nation UNION ALL SELECT 's:' || s_suppkey, 'broader', 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'r:' || r_regionkey, 'date', '2020' FROM region UNION ALL SELECT 'r:' || r_regionkey, 'title', r_name FROM region)"""


def triples(spark, d):
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    of = lambda df, s, p, o: df.select(F.concat(F.lit(s[0]), F.col(s[1])).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    n, r = ("n:", "n_nationkey"), ("r:", "r_regionkey")
    return select.union_all(of(nation, n, "type", F.lit("Concept")), of(region, r, "type", F.lit("Concept")), of(nation, n, "label", F.concat(F.lit('"'), "n_name", F.lit(' (x)"@en'))), of(nation, n, "broader", F.concat(F.lit("r:"), "n_regionkey")), of(supplier, ("s:", "s_suppkey"), "broader", F.concat(F.lit("n:"), "s_nationkey")), of(region, r, "date", F.lit("2020")), of(region, r, "title", F.col("r_name")))


@query(f"""WITH {TRIPLES}, f AS (SELECT * FROM tr WHERE p <> 'date'), k AS (SELECT * FROM f WHERE s IN (SELECT s FROM f WHERE p = 'type')), c AS (SELECT DISTINCT s AS iri FROM k), e AS (SELECT DISTINCT s AS child, o AS parent FROM k WHERE p = 'broader')
SELECT iri, (SELECT min(trim(regexp_replace(o[2:length(o) - 4], '\\(.*\\)', ''))) FROM k WHERE k.s = iri AND p = 'label') AS label, (SELECT min(parent) FROM e WHERE child = iri) AS parent, (SELECT min(t.o) FROM k a JOIN tr t ON t.s = a.o WHERE a.s = iri AND a.p = 'broader' AND t.p = 'title') AS heading FROM c WHERE starts_with(iri, 'r:') OR iri IN (SELECT child FROM e)""")
def triples_to_classes(spark, d):
    every = onto.without_predicates(triples(spark, d), ["date"])
    kept = onto.typed(every, "type")
    edges = onto.edges_of(kept, upward=["broader"])
    classes = onto.without_dangling(kept.select(F.col("s").alias("iri")).distinct(), edges, "^r:")
    label = kept.where("p = 'label'").groupBy(F.col("s").alias("iri")).agg(F.min(text.clean_literal(F.col("o"))).alias("label"))
    heading = onto.heading_titles(every, "broader", "title").groupBy(F.col("s").alias("iri")).agg(F.min("label").alias("heading"))
    parent = edges.groupBy(F.col("child").alias("iri")).agg(F.min("parent").alias("parent"))
    return classes.join(label, "iri", "left").join(parent, "iri", "left").join(heading, "iri", "left").select("iri", "label", "parent", "heading")


@query("""WITH l AS (SELECT 'n:' || n_nationkey AS iri, lower(n_name) AS label FROM nation), q AS (SELECT 'n:' || n_nationkey AS a, 'n:' || (n_nationkey + 5) AS b FROM nation), b AS (SELECT a AS iri, b AS o FROM q UNION ALL SELECT b, a FROM q)
SELECT iri, label FROM l UNION SELECT b.iri, l.label FROM b JOIN l ON l.iri = b.o UNION SELECT 'n:' || n_nationkey, CASE WHEN n_nationkey < 10 THEN lower(n_name) || '!' ELSE 'some thing ' || n_nationkey END FROM nation""")
def label_enrichment(spark, d):
    nation = table(spark, d, "nation")
    iri = lambda k: F.concat(F.lit("n:"), k.cast("string"))
    labels = nation.select(iri(F.col("n_nationkey")).alias("iri"), F.lower("n_name").alias("label"))
    same = onto.propagated_labels(labels, nation.select(iri(F.col("n_nationkey")).alias("a"), iri(F.col("n_nationkey") + 5).alias("b")))
    links = nation.select(iri(F.col("n_nationkey")).alias("iri"), F.concat(F.lit("http://x/Some_thing_"), "n_nationkey").alias("other"))
    known = nation.where("n_nationkey < 10").select(F.concat(F.lit("http://x/Some_thing_"), "n_nationkey").alias("other"), F.concat("n_name", F.lit("!")).alias("label"))
    return onto.with_aliases(same, links, known)


@query(f"""WITH RECURSIVE {GEO}, w AS (SELECT child AS node, [child, parent] AS path FROM e UNION ALL SELECT w.node, list_append(path, e.parent) FROM w JOIN e ON e.child = path[-1]), f AS (SELECT node AS owner, path FROM w WHERE path[-1] LIKE 'r:%'),
h AS (SELECT owner, path, unnest(path) AS node FROM f), b AS (SELECT node, arg_min(path, lpad(len(path)::VARCHAR, 4, '0') || owner) AS path FROM h WHERE node LIKE 'n:%' GROUP BY node)
SELECT node, array_to_string(path[list_position(path, node):], '>') AS path FROM b""")
def path_suffixes(spark, d):
    edges = views.geography(spark, d)
    nations = table(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("node"))
    return graph.path_suffix(graph.root_paths(edges), nations, nations.select("node", F.col("node").alias("name"))).select("node", F.array_join("path", ">").alias("path"))


# ---- whole matchers -------------------------------------------------------------------------------------------------
@query()
def meta_matcher(spark, d):
    return matchers.meta_matcher(views.brand_ontology(spark, d), views.type_ontology(spark, d))


@query()
def structural_matcher(spark, d):
    return matchers.structural_matcher(views.brand_ontology(spark, d), views.type_ontology(spark, d), 0.5).withColumn("measure", F.round("measure", 6))


@query()
def annealed_matcher(spark, d):
    scores = geo_scores(spark, d)
    return matchers.annealed(scores, 0.5, steps=100, inner=100)


@query()
def evolutionary_matcher(spark, d):
    return matchers.evolutionary_matcher(views.brand_ontology(spark, d), views.type_ontology(spark, d), size=100, generations=10, least=0.5)


@query()
def learned_matcher(spark, d):
    return matchers.learned_matcher(views.brand_ontology(spark, d), views.type_ontology(spark, d), k=25, least=0.5)


@query()
def path_embeddings(spark, d):
    edges = views.geography(spark, d, customers=False)
    names = table(spark, d, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("node"), F.translate("n_name", "_", " ").alias("name")).union(table(spark, d, "region").select(F.concat(F.lit("r:"), "r_regionkey"), "r_name"))
    return matchers.path_vectors(graph.root_paths(edges), names, 8).select("node", *[F.round(F.col("vec")[i], 4).alias(f"v{i}") for i in range(8)])
