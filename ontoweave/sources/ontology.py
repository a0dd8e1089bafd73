"""Ontologies: RDF/XML and N-Triples in, class, label and edge tables out, and RDF/XML again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iri_tail

# Predicates of the RDF, RDFS and SKOS vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
THING = "http://www.w3.org/2002/07/owl#Thing"

_TEXT = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())]))
_REF = T.ArrayType(T.StructType([T.StructField("_rdf:resource", T.StringType())]))
OWL_CLASS = T.StructType([T.StructField("_rdf:about", T.StringType()), T.StructField("rdfs:label", _TEXT), T.StructField("rdfs:comment", _TEXT), T.StructField("oboInOwl:hasRelatedSynonym", _TEXT), T.StructField("rdfs:subClassOf", _REF)])


@dataclass
class Ontology:
    """classes (iri), labels (iri, pos, label) and edges (child, parent) as tables; comments (iri, comment) if there are any."""

    classes: DataFrame
    labels: DataFrame
    edges: DataFrame
    comments: DataFrame | None = None


def resolved(iri: Column, base: str) -> Column:
    """An IRI against xml:base, which the XML source leaves alone."""
    return F.when(iri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), iri).otherwise(F.concat(F.lit(base), iri))


def xml_base(spark: SparkSession, path: str) -> str:
    """The xml:base of a document, empty if it has none; read from its own line alone."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"xml:base=[\"']([^\"']*)", 1).alias("b")).where("b <> ''").first()
    return found["b"] if found else ""


def read_owl(spark: SparkSession, path: str, base: str | None = None, fallback: bool = False, anonymous: bool = False) -> Ontology:
    """The classes of an RDF/XML file or folder, a row an owl:Class element, in parallel by a fixed schema.

    Labels keep their case and order (rdfs:label, then related synonyms); fallback gives a class of none the tail of its
    IRI; anonymous keeps classes without an IRI in classes. owl:Thing and anonymous parents are left out."""
    base = xml_base(spark, path) if base is None else base
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(OWL_CLASS).load(path)
    texts = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array().cast(_TEXT)), lambda x: x["_VALUE"])
    rows = rows.select(
        resolved(F.col("`_rdf:about`"), base).alias("iri"),
        F.filter(F.concat(texts("rdfs:label"), texts("oboInOwl:hasRelatedSynonym")), lambda x: x.isNotNull()).alias("labels"),
        F.filter(texts("rdfs:comment"), lambda x: x.isNotNull()).alias("comments"),
        F.transform(F.filter(F.coalesce(F.col("`rdfs:subClassOf`"), F.array().cast(_REF)), lambda x: x["_rdf:resource"].isNotNull()), lambda x: resolved(x["_rdf:resource"], base)).alias("parents"),
    )
    if fallback:
        rows = rows.withColumn("labels", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(iri_tail(F.col("iri")))))
    named = rows.where("iri is not null")
    return Ontology(
        (rows if anonymous else named).select("iri").distinct(),
        named.select("iri", F.posexplode("labels").alias("pos", "label")),
        named.select(F.col("iri").alias("child"), F.explode("parents").alias("parent")).where(F.col("parent") != THING).distinct(),
        named.select("iri", F.explode("comments").alias("comment")),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines, as they are written; blank lines and comments are left out."""
    line = F.col("value")
    part = lambda i: F.regexp_extract(line, r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$", i)
    return spark.read.text(path).where(line.rlike(r"^\s*[<_]")).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def read_rdf_xml(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str], base: str = "") -> DataFrame:
    """(s, p, o) of the elements row_tag of an RDF/XML file: fields names child elements and their predicates; a child's
    rdf:resource, or else its text, is the object."""
    kind = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_rdf:resource", T.StringType())]))
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(T.StructType([T.StructField("_rdf:about", T.StringType()), *(T.StructField(f, kind) for f in fields)])).load(path)
    def objects(field: str, predicate: str) -> Column:
        return F.transform(F.coalesce(F.col(f"`{field}`"), F.array().cast(kind)), lambda x: F.struct(F.lit(predicate).alias("p"), F.coalesce(resolved(x["_rdf:resource"], base), x["_VALUE"]).alias("o")))

    each = [objects(f, p) for f, p in fields.items()]
    return rows.select(resolved(F.col("`_rdf:about`"), base).alias("s"), F.explode(F.concat(*each)).alias("t")).select("s", "t.p", "t.o").where("o is not null")


def write_owl(ontology: Ontology, path: str, base: str = "", language: str = "en") -> None:
    """The classes as RDF/XML, a part file a task; the XML source escapes texts."""
    labels = ontology.labels.groupBy("iri").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("ls"))
    parents = ontology.edges.groupBy(F.col("child").alias("iri")).agg(F.sort_array(F.collect_set("parent")).alias("ps"))
    rows = ontology.classes.join(labels, "iri", "left").join(parents, "iri", "left").select(
        F.col("iri").alias("_rdf:about"),
        F.transform("ls", lambda x: F.struct(x["label"].alias("_VALUE"), F.lit(language).alias("_xml:lang"))).alias("rdfs:label"),
        F.transform("ps", lambda p: F.struct(p.alias("_rdf:resource"))).alias("rdfs:subClassOf"),
    )
    spaces = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"'
    root = f"rdf:RDF {spaces}" + f' xml:base="{base}"' * bool(base)
    rows.write.format("xml").option("rootTag", root).option("rowTag", "owl:Class").option("validateName", "false").mode("overwrite").save(path)


def read_rdf_elements(spark: SparkSession, path: str, row_tags: dict[str, dict[str, str]], base: str = "") -> DataFrame:
    """read_rdf_xml() of several kinds of elements (a tag and its fields each) of one document."""
    return reduce(DataFrame.union, [read_rdf_xml(spark, path, tag, fields, base) for tag, fields in row_tags.items()])


def bare(literal: Column) -> Column:
    """The text of a literal of N-Triples without its quotes, language and type, and an IRI without its brackets."""
    inner = F.regexp_extract(literal, r'^"(.*)"(?:@[A-Za-z0-9-]+|\^\^\S+)?$', 1)
    plain = F.regexp_replace(F.replace(F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"')), r"\\\\", r"\\")
    return F.when(literal.rlike(r'^"'), plain).when(literal.rlike("^<.*>$"), F.regexp_extract(literal, "^<(.*)>$", 1)).otherwise(literal)


# ---- triples to tables ----------------------------------------------------------------------------------------------
def without_predicates(triples: DataFrame, predicates: list[str], subject_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Triples but for some predicates and subjects with some beginnings."""
    out = triples.where(~F.col("p").isin(predicates)) if predicates else triples
    for prefix in subject_prefixes:
        out = out.where(~F.startswith("s", F.lit(prefix)))
    return out


def without_sections(triples: DataFrame, pattern: str) -> DataFrame:
    """Triples neither subject nor object of which matches a pattern."""
    return triples.where(~F.col("s").rlike(pattern) & ~F.col("o").rlike(pattern))


def typed(triples: DataFrame, predicate: str = RDF_TYPE) -> DataFrame:
    """Triples of subjects that have a type."""
    return triples.join(triples.where(F.col("p") == predicate).select("s").distinct(), "s", "left_semi")


def without_dangling(classes: DataFrame, edges: DataFrame, root_pattern: str) -> DataFrame:
    """Classes that match the pattern of roots or have a parent."""
    return classes.join(edges.select(F.col("child").alias("iri"), F.lit(True).alias("up")).distinct(), "iri", "left").where(F.col("iri").rlike(root_pattern) | F.col("up")).select("iri")


def edges_of(triples: DataFrame, upward: list[str] = (), downward: list[str] = ()) -> DataFrame:
    """(child, parent) of broader-like (upward) and narrower-like (downward) predicates."""
    up = triples.where(F.col("p").isin(list(upward))).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    down = triples.where(F.col("p").isin(list(downward))).select(F.col("o").alias("child"), F.col("s").alias("parent"))
    return up.union(down).distinct()


def heading_titles(triples: DataFrame, link: str, title: str) -> DataFrame:
    """(s, label): titles of what a subject's link predicate leads to."""
    a, b = triples.where(F.col("p") == link).select("s", F.col("o").alias("h")), triples.where(F.col("p") == title).select(F.col("s").alias("h"), F.col("o").alias("label"))
    return a.join(b, "h").select("s", "label")


def propagated_labels(labels: DataFrame, equivalents: DataFrame) -> DataFrame:
    """labels (iri, label) and those of equivalent classes (a, b), one step in either direction."""
    both = equivalents.select(F.col("a").alias("iri"), F.col("b").alias("of")).union(equivalents.select("b", "a"))
    return labels.union(both.join(labels.withColumnRenamed("iri", "of"), "of").select("iri", "label")).distinct()


def with_aliases(labels: DataFrame, same_as: DataFrame, known: DataFrame) -> DataFrame:
    """labels (iri, label) and those of linked resources same_as (iri, other): the label that known (other, label), fetched
    beforehand, has for it, else the tail of its IRI with blanks for underscores."""
    found = same_as.join(known, "other", "left").select("iri", F.lower(F.coalesce("label", F.translate(iri_tail(F.col("other")), "_", " "))).alias("label"))
    return labels.union(found).distinct()


def not_in_language(labels: DataFrame, language: str = "en") -> DataFrame:
    """Literals that carry another language: rows of a quality check."""
    return labels.where(F.col("label").rlike(r'"@\w+$') & ~F.col("label").rlike(rf'"@{language}$'))
