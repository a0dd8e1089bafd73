"""Round trips of sinks and sources: each query writes whole test tables in a format and reads them back; SQL says what must
come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path
from ..sources import alignment, delimited
from ..sources import ontology as onto
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
X = "http://x/"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ---- ontologies -----------------------------------------------------------------------------------------------------
def part_ontology(spark: SparkSession, d: str) -> onto.Ontology:
    """Parts with two labels below their brands, which have none."""
    part = table(spark, d, "part")
    iri, brand = F.concat(F.lit(f"{X}p"), "p_partkey"), F.concat(F.lit(f"{X}b/"), F.replace("p_brand", F.lit("#")))
    labels = part.select(iri.alias("iri"), F.posexplode(F.array(F.concat("p_name", F.lit(" & <more>")), F.lower("p_type"))).alias("pos", "label"))
    edges = part.select(iri.alias("child"), brand.alias("parent"))
    return onto.Ontology(edges.select(F.col("child").alias("iri")).union(edges.select("parent")).distinct(), labels, edges)


PARTS = f"""cl AS (SELECT '{X}p' || p_partkey AS iri FROM part UNION SELECT '{X}b/' || replace(p_brand, '#', '') FROM part),
la AS (SELECT '{X}p' || p_partkey AS iri, 0 AS pos, p_name || ' & <more>' AS label FROM part UNION ALL SELECT '{X}p' || p_partkey, 1, lower(p_type) FROM part),
ed AS (SELECT '{X}p' || p_partkey AS child, '{X}b/' || replace(p_brand, '#', '') AS parent FROM part)"""


def owl(spark: SparkSession, d: str) -> str:
    path = fresh_path(spark, "owl")
    onto.write_owl(part_ontology(spark, d), path)
    return path


@query(f"WITH {PARTS} SELECT 'class' AS kind, iri AS a, NULL AS b, NULL AS pos FROM cl UNION ALL SELECT 'label', iri, label, pos FROM la UNION ALL SELECT 'edge', child, parent, NULL FROM ed")
def owl_round_trip(spark, d):
    o = onto.read_owl(spark, owl(spark, d), base="")
    none = F.lit(None).cast("string")
    classes = o.classes.select(F.lit("class").alias("kind"), F.col("iri").alias("a"), none.alias("b"), F.lit(None).cast("int").alias("pos"))
    return classes.union(o.labels.select(F.lit("label"), "iri", "label", "pos")).union(o.edges.select(F.lit("edge"), "child", "parent", F.lit(None).cast("int")))


@query(f"WITH {PARTS} SELECT iri, pos, label FROM la UNION ALL SELECT iri, 0, regexp_extract(iri, '[^/]*$') FROM cl WHERE iri LIKE '{X}b/%'")
def owl_fallback_labels(spark, d):
    return onto.read_owl(spark, owl(spark, d), base="", fallback=True).labels


@query(f"WITH {PARTS} SELECT iri AS s, 'label' AS p, label AS o FROM la UNION ALL SELECT child, 'parent', parent FROM ed")
def rdf_xml_triples(spark, d):
    return onto.read_rdf_elements(spark, owl(spark, d), {"owl:Class": {"rdfs:label": "label", "rdfs:subClassOf": "parent"}})


@query(f"""SELECT '<{X}c' || conv_id || '-' || turn || '>' AS s, '<{X}role>' AS p, '"' || role || '"@en' AS o, role AS text FROM conversations
UNION ALL SELECT '<{X}c' || conv_id || '-' || turn || '>', '<{X}of>', '<{X}c' || conv_id || '>', '{X}c' || conv_id FROM conversations""")
def ntriples_round_trip(spark, d):
    turns = table(spark, d, "conversations").select(F.concat(F.lit(f"<{X}c"), "conv_id", F.lit("-"), "turn", F.lit(">")).alias("s"), "role", F.concat(F.lit(f"<{X}c"), "conv_id", F.lit(">")).alias("of"))
    lines = turns.select(F.concat_ws(" ", "s", F.lit(f"<{X}role>"), F.concat(F.lit('"'), "role", F.lit('"@en')), F.lit(".")).alias("value")).union(turns.select(F.concat_ws(" ", "s", F.lit(f"<{X}of>"), "of", F.lit("."))))
    path = fresh_path(spark, "nt")
    alignment.write_lines(lines, path)
    return onto.read_ntriples(spark, path).withColumn("text", onto.bare(F.col("o")))


# ---- alignments -----------------------------------------------------------------------------------------------------
def order_alignment(spark: SparkSession, d: str) -> DataFrame:
    """(id, entity1, entity2, measure, relation, names): an order and its customer, measured by their numbers."""
    orders = table(spark, d, "orders")
    measure = (F.col("o_orderkey") % 1000) / 800.0
    return orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o:"), "o_orderkey").alias("entity1"), F.concat(F.lit("c:&"), "o_custkey").alias("entity2"), measure.alias("measure"), F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise("=").alias("relation"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("names"))


ORDERS = """al AS (SELECT o_orderkey AS id, 'o:' || o_orderkey AS entity1, 'c:&' || o_custkey AS entity2, (o_orderkey % 1000) / 800.0::DOUBLE AS measure,
CASE WHEN o_orderkey % 10 = 0 THEN '?' ELSE '=' END AS relation, '"' || o_orderpriority || '"' AS names FROM orders)"""


@query(f"WITH {ORDERS} SELECT 'http://o/' || entity1[3:] AS entity1, 'http://c/' || entity2[3:] AS entity2, round(least(measure, 1.0), 6) AS measure, relation FROM al WHERE measure >= 0.5 AND relation <> '?'")
def alignment_round_trip(spark, d):
    path = fresh_path(spark, "alignment")
    alignment.write_alignment(order_alignment(spark, d), path, {"o": "http://o/", "c": "http://c/"}, least=0.5)
    return alignment.read_alignment(spark, path).withColumn("measure", F.round("measure", 6))


@query(f"WITH {ORDERS} SELECT relation, count(*) AS n, count(DISTINCT entity1) AS entities FROM al GROUP BY relation")
def alignment_with_excluded(spark, d):
    path = fresh_path(spark, "alignment")
    alignment.write_alignment(order_alignment(spark, d), path)
    return alignment.read_alignment(spark, path, excluded=True).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("entity1").alias("entities"))


@query(f"WITH {ORDERS} SELECT entity1, entity2, round(measure, 6) AS measure, '=' AS relation FROM al")
def classic_cells_round_trip(spark, d):
    path = fresh_path(spark, "cells")
    alignment.write_classic(order_alignment(spark, d), path)
    return alignment.read_alignment(spark, path).withColumn("measure", F.round("measure", 6))


@query(f"WITH {ORDERS} SELECT entity1, entity2, round(measure, 6) AS measure, '=' AS relation FROM al")
def pipe_lines_round_trip(spark, d):
    path = fresh_path(spark, "pipes")
    alignment.write_lines(alignment.pipe_lines(order_alignment(spark, d)), path)
    return alignment.read_pipes(spark, path).withColumn("measure", F.round("measure", 6))


@query(f"WITH {ORDERS} SELECT 'i=' || id AS id, entity1, entity2, (id % 1000) / 1000.0::DOUBLE AS measure, names, false AS negative FROM al")
def record_lines_round_trip(spark, d):
    path = fresh_path(spark, "records")
    alignment.write_lines(alignment.record_lines(order_alignment(spark, d).withColumn("measure", (F.col("id") % 1000) / 1000.0)), path, "\n\n")
    return alignment.read_records(spark, path)


@query(f"WITH {ORDERS} SELECT CASE WHEN id % 2 = 0 THEN 'SRC' ELSE 'TGT' END AS direction, entity1, entity2, round(measure, 6) AS measure FROM al")
def mapping_log(spark, d):
    rows = order_alignment(spark, d).select(F.format_string("[%s: %s][Mapping: ('%s', '%s', %s)]", F.when(F.col("id") % 2 == 0, "SRC").otherwise("TGT"), F.col("id").cast("string"), "entity1", "entity2", F.col("measure").cast("decimal(12,6)").cast("string")).alias("value"))
    path = fresh_path(spark, "log")
    alignment.write_lines(rows.union(rows.select(F.lit("epoch 1 of 3, loss 0.5"))), path)
    return alignment.read_mapping_log(spark, path).withColumn("measure", F.round("measure", 6))


# ---- tables ---------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'NULL' ELSE c_name || '''s \"own\"' END AS label, round(c_acctbal, 6) AS score FROM customer")
def tsv_round_trip(spark, d):
    label = F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 7 == 1, "NULL").otherwise(F.concat("c_name", F.lit("'s \"own\"")))
    path = fresh_path(spark, "tsv")
    delimited.write_tsv(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"), F.col("c_acctbal").alias("score")), path)
    return delimited.read_tsv(spark, path, "id long, label string, score double").withColumn("score", F.round("score", 6))


@query("SELECT o_custkey::VARCHAR AS key, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS vals FROM orders GROUP BY o_custkey")
def json_map_round_trip(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x.o_orderpriority).alias("values"))
    path = fresh_path(spark, "json")
    delimited.write_json_map(rows, path)
    return delimited.read_json_map(spark, path).select("key", F.array_join("values", "|").alias("vals"))


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key, n_name AS label FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def saved_tables_round_trip(spark, d):
    path = fresh_path(spark, "saved")
    delimited.write_tables({t: table(spark, d, t) for t in ("nation", "region")}, path)
    saved = delimited.read_tables(spark, path, ["nation", "region"])
    return saved["nation"].select(F.lit("nation").alias("name"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("label")).union(saved["region"].select(F.lit("region"), F.col("r_regionkey").cast("long"), "r_name"))


@query("SELECT 1.3::DOUBLE AS threshold, 25 AS candidates, 2 AS n_best, true AS legacy, 'max' AS pooling, count(*) AS regions FROM region")
def options_with_overrides(spark, d):
    o = delimited.Options.read("# of a run\nthreshold=1.3\ncandidates=200\nlegacy=true\nunknown=1", candidates=25, n_best=2, pooling="max")
    return table(spark, d, "region").agg(F.lit(o.threshold).alias("threshold"), F.lit(o.candidates).alias("candidates"), F.lit(o.n_best).alias("n_best"), F.lit(o.legacy).alias("legacy"), F.lit(o.pooling).alias("pooling"), F.count("*").alias("regions"))


@query("SELECT 'v_' || vec_id AS word, len(embedding) AS size, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS total, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE embedding IS NOT NULL")
def word_vectors_round_trip(spark, d):
    path = fresh_path(spark, "vectors")
    delimited.write_vectors(table(spark, d, "embeddings").where("embedding is not null").select(F.concat(F.lit("v "), "vec_id").alias("word"), F.col("embedding").alias("vec")), path)
    return delimited.read_vectors(spark, path).select("word", F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("vec")[0], 5).alias("first"))


@query("SELECT s_nationkey::BIGINT AS i, s_suppkey // 7 AS j, round(max(s_acctbal), 6) AS score FROM supplier WHERE s_acctbal <> 0 GROUP BY ALL")
def similarity_matrix_round_trip(spark, d):
    cells = table(spark, d, "supplier").where("s_acctbal <> 0").groupBy(F.col("s_nationkey").cast("long").alias("i"), F.floor(F.col("s_suppkey") / 7).alias("j")).agg(F.max("s_acctbal").alias("score"))
    path = fresh_path(spark, "matrix")
    delimited.write_matrix(cells, path)
    return delimited.read_matrix(spark, path).withColumn("score", F.round("score", 6))
