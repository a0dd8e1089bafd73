import pytest

from ontoweave.sources import alignment, delimited, ontology

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#"
         xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xml:base="http://x/">
  <owl:Class rdf:about="A"><rdfs:label xml:lang="en">Root &amp; all</rdfs:label><rdfs:comment>c</rdfs:comment></owl:Class>
  <owl:Class rdf:about="http://x/B"><rdfs:label xml:lang="en">b one</rdfs:label><rdfs:label xml:lang="en">b two</rdfs:label>
    <rdfs:subClassOf rdf:resource="A"/><rdfs:subClassOf rdf:resource="http://www.w3.org/2002/07/owl#Thing"/></owl:Class>
  <owl:Class rdf:about="http://x/C"/>
</rdf:RDF>"""


@pytest.fixture
def owl(tmp_path):
    (tmp_path / "tiny.owl").write_text(OWL)
    return str(tmp_path / "tiny.owl")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_read_owl(spark, owl):
    o = ontology.read_owl(spark, owl)
    assert pairs(o.classes, "iri") == [("http://x/A",), ("http://x/B",), ("http://x/C",)]
    assert pairs(o.labels, "iri", "pos", "label") == [("http://x/A", 0, "Root & all"), ("http://x/B", 0, "b one"), ("http://x/B", 1, "b two")]
    assert pairs(o.edges, "child", "parent") == [("http://x/B", "http://x/A")]
    assert pairs(o.comments, "iri", "comment") == [("http://x/A", "c")]
    assert ("http://x/C", "C") in pairs(ontology.read_owl(spark, owl, fallback=True).labels, "iri", "label")


def test_owl_round_trip(spark, owl, tmp_path):
    o = ontology.read_owl(spark, owl)
    ontology.write_owl(o, f"{tmp_path}/out")
    again = ontology.read_owl(spark, f"{tmp_path}/out", base="")
    for a, b, cols in ((o.classes, again.classes, ["iri"]), (o.labels, again.labels, ["iri", "pos", "label"]), (o.edges, again.edges, ["child", "parent"])):
        assert pairs(a, *cols) == pairs(b, *cols)


def test_triples(spark, tmp_path):
    (tmp_path / "t.nt").write_text('# c\n<http://a> <http://p> "x y"@en .\n<http://a> <http://q> <http://b> .\n\n')
    assert pairs(ontology.read_ntriples(spark, str(tmp_path / "t.nt")), "s", "p", "o") == [("<http://a>", "<http://p>", '"x y"@en'), ("<http://a>", "<http://q>", "<http://b>")]
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="r" xmlns:skos="s"><skos:Concept rdf:about="1"><skos:prefLabel xml:lang="en">One</skos:prefLabel><skos:broader rdf:resource="2"/></skos:Concept></rdf:RDF>')
    got = ontology.read_rdf_xml(spark, str(tmp_path / "c.rdf"), "skos:Concept", {"skos:prefLabel": "label", "skos:broader": "broader"}, "http://x/")
    assert pairs(got, "s", "p", "o") == [("http://x/1", "broader", "http://x/2"), ("http://x/1", "label", "One")]
    t = spark.createDataFrame([("/cpc/A1", "p", "x"), ("/cpc/G1", "p", "/cpc/H2"), ("/cpc/G1", "p", "y")], "s string, p string, o string")
    assert pairs(ontology.without_sections(t, "/cpc/[A-FH]"), "s", "o") == [("/cpc/G1", "y")]
    assert pairs(ontology.not_in_language(spark.createDataFrame([('"a"@en',), ('"b"@de',), ("c",)], "label string")), "label") == [('"b"@de',)]


VARIANTS = """<rdf:RDF xmlns="http://a#" xmlns:rdf="r"><Alignment><map><Cell><entity1 rdf:resource="http://x/1"/><entity2 rdf:resource='http://y/1'/><measure rdf:datatype="xsd:float">0.5</measure><relation>=</relation></Cell></map>
<map><Cell><relation>=</relation><measure rdf:datatype='http://www.w3.org/2001/XMLSchema#float'>8.0</measure><entity2 rdf:resource="http://y/2"/><entity1 rdf:resource="http://x/2"/></Cell></map>
<map><Cell><entity1 rdf:resource="http://x/3"/><entity2 rdf:resource="http://y/3"/><measure rdf:datatype="xsd:float">1.0</measure><relation>?</relation></Cell></map></Alignment></rdf:RDF>"""


def test_alignments(spark, tmp_path):
    (tmp_path / "a.rdf").write_text(VARIANTS)
    got = alignment.read_alignment(spark, str(tmp_path / "a.rdf"))
    assert pairs(got, "entity1", "entity2", "measure") == [("http://x/1", "http://y/1", 0.5), ("http://x/2", "http://y/2", 8.0)]
    assert alignment.read_alignment(spark, str(tmp_path / "a.rdf"), excluded=True).count() == 3
    short = spark.createDataFrame([("x:1", "y:1", 0.95), ("x:2", "y:&2", 1.7), ("x:3", "y:3", 0.2)], "entity1 string, entity2 string, measure double")
    alignment.write_alignment(short, f"{tmp_path}/out", {"x": "http://x/", "y": "http://y/"}, least=0.9)
    assert pairs(alignment.read_alignment(spark, f"{tmp_path}/out"), "entity1", "entity2", "measure") == [("http://x/1", "http://y/1", 0.95), ("http://x/2", "http://y/&2", 1.0)]
    assert "y:&amp;2" in "".join(r["value"] for r in alignment.template_lines(short).collect())


def test_lines(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", "y", 0.5, '"n","m"'), (2, "p", "q", 1.0, '"k"')], "id int, entity1 string, entity2 string, measure double, names string")
    alignment.write_lines(alignment.record_lines(a), f"{tmp_path}/r", "\n\n")
    assert pairs(alignment.read_records(spark, f"{tmp_path}/r"), "id", "entity1", "entity2", "measure", "names", "negative") == [("i=1", "x", "y", 0.5, '"n","m"', False), ("i=2", "p", "q", 1.0, '"k"', False)]
    alignment.write_lines(alignment.pipe_lines(a), f"{tmp_path}/p")
    assert pairs(alignment.read_pipes(spark, f"{tmp_path}/p"), "entity1", "entity2", "measure", "relation") == [("p", "q", 1.0, "="), ("x", "y", 0.5, "=")]
    (tmp_path / "q").write_text("3, a|b\nc|d|=|0.25|CLS\n")
    assert pairs(alignment.read_pipes(spark, str(tmp_path / "q")), "entity1", "measure") == [("a", 1.0), ("c", 0.25)]
    (tmp_path / "log").write_text("x\n[SRC: 1][Mapping: ('a', 'b', 0.75)]\n[TGT: 2][Mapping: ('c', 'd', 1e-2)]\n")
    assert pairs(alignment.read_mapping_log(spark, str(tmp_path / "log")), "direction", "entity1", "entity2", "measure") == [("SRC", "a", "b", 0.75), ("TGT", "c", "d", 0.01)]


def test_tables_and_options(spark, tmp_path):
    df = spark.createDataFrame([("NULL", "1"), ("NA", "2"), ("aé", None)], "l string, n string")
    delimited.write_tsv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, delimited.read_tsv(spark, f"{tmp_path}/t").collect()), key=str) == [("NULL", "1"), ("aé", None), (None, "2")]
    delimited.write_tables({"a": df}, f"{tmp_path}/w")
    assert delimited.read_tables(spark, f"{tmp_path}/w", ["a"])["a"].count() == 3
    with pytest.raises(FileNotFoundError):
        delimited.read_tables(spark, f"{tmp_path}/w", ["b"])
    (tmp_path / "m.json").write_text('{"k": ["a", "b"]}')
    assert delimited.read_json_map(spark, str(tmp_path / "m.json")).first()["values"] == ["a", "b"]
    assert delimited.Options.read("threshold=1.3\nlegacy=true\nother=1", n_best=2) == delimited.Options(threshold=1.3, legacy=True, n_best=2)
    assert delimited.Options.read('{"candidates": 25}').candidates == 25
