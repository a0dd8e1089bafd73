"""The test tables seen as ontologies: part brands and types as classes with labels, geography as a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ontology import Ontology


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """(iri, pos, label): a class per brand and name; its label is the name."""
    return table(spark, d, "part").select(F.concat(F.lit("s:"), "p_brand", F.lit("/"), "p_name").alias("iri"), F.lit(0).alias("pos"), F.initcap("p_name").alias("label")).distinct()


def target_labels(spark: SparkSession, d: str) -> DataFrame:
    """(iri, pos, label): a class per type and name; its labels are the name, and type and name."""
    own = table(spark, d, "part").select(F.concat(F.lit("t:"), "p_type", F.lit("/"), "p_name").alias("iri"), "p_name", F.lower("p_type").alias("t")).distinct()
    return own.select("iri", F.posexplode(F.array(F.col("p_name"), F.concat_ws(" ", "t", "p_name"))).alias("pos", "label"))


def geography(spark: SparkSession, d: str, customers: bool = True) -> DataFrame:
    """(child, parent): nations under regions, suppliers and customers under nations."""
    edge = lambda t, a, b, p, q: table(spark, d, t).select(F.concat(F.lit(f"{a}:"), F.col(p)).alias("child"), F.concat(F.lit(f"{b}:"), F.col(q)).alias("parent"))
    out = edge("nation", "n", "r", "n_nationkey", "n_regionkey").union(edge("supplier", "s", "n", "s_suppkey", "s_nationkey"))
    return out.union(edge("customer", "c", "n", "c_custkey", "c_nationkey")) if customers else out


def ontology(labels: DataFrame, edges: DataFrame) -> Ontology:
    return Ontology(labels.select("iri").distinct(), labels, edges)


def brand_ontology(spark: SparkSession, d: str) -> Ontology:
    labels = source_labels(spark, d)
    return ontology(labels, labels.select(F.col("iri").alias("child"), F.substring_index("iri", "/", 1).alias("parent")).distinct())


def type_ontology(spark: SparkSession, d: str) -> Ontology:
    labels = target_labels(spark, d)
    return ontology(labels, labels.select(F.col("iri").alias("child"), F.substring_index("iri", "/", 1).alias("parent")).distinct())


#: The same views for DuckDB.
SQL = """s AS (SELECT DISTINCT 's:' || p_brand || '/' || p_name AS iri, 0 AS pos, p_name AS label FROM part),
t0 AS (SELECT DISTINCT 't:' || p_type || '/' || p_name AS iri, p_name, lower(p_type) || ' ' || p_name AS long FROM part),
t AS (SELECT iri, 0 AS pos, p_name AS label FROM t0 UNION ALL SELECT iri, 1, long FROM t0)"""
GEO = """e AS (SELECT 'n:' || n_nationkey AS child, 'r:' || n_regionkey AS parent FROM nation
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer)"""
GEO_SUPPLIERS = """e AS (SELECT 'n:' || n_nationkey AS child, 'r:' || n_regionkey AS parent FROM nation
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier)"""
UP = """up AS (SELECT DISTINCT child AS node, parent AS ancestor, 1 AS d FROM e
UNION SELECT up.node, e.parent, up.d + 1 FROM up JOIN e ON e.child = up.ancestor)"""
