"""Alignments: (entity1, entity2, measure, relation) from and to the formats that matchers exchange."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import expand, xml_escape

_ENTITY = T.StructType([T.StructField("_rdf:resource", T.StringType())])
_MEASURE = T.StructType([T.StructField("_VALUE", T.DoubleType()), T.StructField("_rdf:datatype", T.StringType())])
CELL = T.StructType([T.StructField("entity1", _ENTITY), T.StructField("entity2", _ENTITY), T.StructField("measure", _MEASURE), T.StructField("relation", T.StringType())])
PAIR = ["entity1", "entity2"]
# Head and foot of an alignment document.
CLASSIC = (
    '<?xml version="1.0" encoding="utf-8"?><rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#"><Alignment><xml>yes</xml><level>0</level><type>??</type>',
    "</Alignment></rdf:RDF>",
)


def read_alignment(spark: SparkSession, path: str, excluded: bool = False) -> DataFrame:
    """The cells of alignment files in RDF/XML, whatever the order of their elements, quotes and default name space. Cells
    of the relation ?, which gold alignments exclude from scoring, are left out unless excluded."""
    cells = spark.read.format("xml").option("rowTag", "Cell").schema(CELL).load(path)
    out = cells.select(F.col("entity1.`_rdf:resource`").alias("entity1"), F.col("entity2.`_rdf:resource`").alias("entity2"), F.col("measure._VALUE").alias("measure"), F.coalesce("relation", F.lit("=")).alias("relation"))
    out = out.where("entity1 is not null and entity2 is not null")
    return out if excluded else out.where("relation <> '?'")


def read_pipes(spark: SparkSession, path: str) -> DataFrame:
    """Lines entity1|entity2[|relation|measure...], with a number and a comma before them or not."""
    at = F.split(F.regexp_replace("value", r"^\d+,\s*", ""), r"\|")
    rows = spark.read.text(path).where("value like '%|%'").select(at.alias("f"))
    return rows.select(F.trim(F.get("f", F.lit(0))).alias("entity1"), F.trim(F.get("f", F.lit(1))).alias("entity2"), F.coalesce(F.expr("try_cast(get(f, 3) as double)"), F.lit(1.0)).alias("measure"), F.coalesce(F.get("f", F.lit(2)), F.lit("=")).alias("relation"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a line id|entity1|entity2[|score], a line of names and a blank one: (id, entity1, entity2, measure, names,
    negative)."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), "\n").alias("l")).select(F.split(F.col("l")[0], r"\|").alias("f"), F.get("l", F.lit(1)).alias("names"))
    return rows.select(F.col("f")[0].alias("id"), F.get("f", F.lit(1)).alias("entity1"), F.get("f", F.lit(2)).alias("entity2"), F.expr("try_cast(get(f, 3) as double)").alias("measure"), "names", F.startswith(F.col("f")[0], F.lit("neg-")).alias("negative"))


def read_mapping_log(spark: SparkSession, path: str) -> DataFrame:
    """(direction, entity1, entity2, measure) of the lines of a prediction log that tell a mapping."""
    part = lambda i: F.regexp_extract("value", r"\[(SRC|TGT):[^\]]*\]\[Mapping:\s*\('?([^',]+)'?,\s*'?([^',]+)'?,\s*([0-9.eE+-]+)\)", i)
    rows = spark.read.text(path).select(part(1).alias("direction"), part(2).alias("entity1"), part(3).alias("entity2"), F.expr("1").alias("_"), part(4).alias("m"))
    return rows.where("direction <> ''").select("direction", "entity1", "entity2", F.col("m").cast("double").alias("measure"))


def write_alignment(alignment: DataFrame, path: str, prefixes: Mapping[str, str] | None = None, least: float | None = None) -> None:
    """The cells, those of a measure of least and more if given, as RDF/XML; names with a known prefix are expanded and
    measures above 1 cut to it."""
    rows = alignment if least is None else alignment.where(F.col("measure") >= least)
    entity = lambda c: F.struct(expand(F.col(c), prefixes or {}).alias("_rdf:resource"))
    measure = F.struct(F.least(F.col("measure").cast("double"), F.lit(1.0)).alias("_VALUE"), F.lit("xsd:float").alias("_rdf:datatype"))
    relation = F.coalesce("relation", F.lit("=")) if "relation" in alignment.columns else F.lit("=")
    cells = rows.select(F.struct(entity("entity1").alias("entity1"), entity("entity2").alias("entity2"), measure.alias("measure"), relation.alias("relation")).alias("Cell"))
    spaces = 'xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#"'
    cells.write.format("xml").option("rootTag", f"rdf:RDF {spaces}").option("rowTag", "map").option("validateName", "false").mode("overwrite").save(path)


def pipe_lines(alignment: DataFrame, kind: str = "CLS") -> DataFrame:
    """value: entity1|entity2|=|measure|kind, as repair tools read it."""
    return alignment.select(F.concat_ws("|", "entity1", "entity2", F.lit("="), F.col("measure").cast("string"), F.lit(kind)).alias("value"))


def record_lines(alignment: DataFrame, names: str = "names") -> DataFrame:
    """value: i=id|entity1|entity2|0.123, and the names in the next line; write it with lineSep of two line ends."""
    return alignment.select(F.concat_ws("\n", F.concat_ws("|", F.concat(F.lit("i="), F.col("id").cast("string")), "entity1", "entity2", F.format_string("%.3f", "measure")), F.col(names)).alias("value"))


def write_lines(lines: DataFrame, path: str, separator: str = "\n") -> None:
    lines.select("value").write.mode("overwrite").option("lineSep", separator).text(path)


def template_lines(alignment: DataFrame) -> DataFrame:
    """value: a cell an element, for callers that need the classic layout in one text file."""
    cell = '<map><Cell><entity1 rdf:resource="%s"/><entity2 rdf:resource="%s"/><measure rdf:datatype="xsd:float">%s</measure><relation>=</relation></Cell></map>'
    return alignment.select(F.format_string(cell, xml_escape(F.col("entity1")), xml_escape(F.col("entity2")), F.col("measure").cast("string")).alias("value"))


def write_classic(alignment: DataFrame, path: str) -> None:
    """template_lines() between the head and the foot of a document, a document a part file."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield line(CLASSIC[0])
        yield from (pa.RecordBatch.from_arrays(b.columns, names=["value"]) for b in batches)
        yield line(CLASSIC[1])

    write_lines(template_lines(alignment).mapInArrow(framed, "value string"), path)
