import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontoweave.functions import similarity as S
from ontoweave.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_porter():
    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form formalize formal electriciti electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [(w, T.porter(w)) for w in known[::2]] == list(zip(known[::2], known[1::2], strict=True))


def test_text(spark):
    lit = F.lit
    assert one(spark, T.quote(lit("a b/c*~+é"))) == "a%20b/c%2A~%2B%C3%A9"
    assert one(spark, T.unquote(T.quote(lit("a b/c*~+é")))) == "a b/c*~+é"
    assert [tuple(x) for x in one(spark, T.scored_labels(lit("a b (1.0); c (0.8)")))] == [("a b", 1.0), ("c", 0.8)]
    assert one(spark, T.scored_labels(lit(""))) == []
    assert one(spark, T.clean_literal(lit('"{a (x) b  (y) c}"@en'))) == "a c"
    assert one(spark, T.camel_words(lit("someXMLNameIs"))) == ["some", "XML", "Name", "Is"]
    assert one(spark, T.words(lit("A-b, c!  d"))) == ["a", "b", "c", "d"] and one(spark, T.words(lit(""))) == []
    assert one(spark, T.path_to_symbol(lit("G06F8-10"))) == "G06F 8/10" and one(spark, T.symbol_to_path(lit("G06F 8/10"))) == "G06F8-10"
    assert one(spark, T.iri_tail(lit("http://x/a#b"))) == "b" and one(spark, T.iri_base(lit("http://x/a#b"))) == "http://x/a#"
    p = {"x": "http://x/", "xa": "http://x/a/"}
    assert one(spark, T.abbreviate(lit("http://x/a/b"), p)) == "xa:b" and one(spark, T.expand(lit("xa:b"), p)) == "http://x/a/b"
    assert one(spark, T.padded(F.array(lit(1)), 3, lit(0))) == [1, 0, 0] and one(spark, T.fixed(lit(0.12345))) == "0.123"
    assert one(spark, T.grams(lit("ab"))) == ["ab"] and one(spark, T.grams(lit("abcd"))) == ["abc", "bcd"] and one(spark, T.grams(lit(""))) == []
    assert one(spark, T.xml_escape(lit("a<b & c"))) == "a&lt;b &amp; c"
    cut = T.word_pieces({"un", "##aff", "##able", "a"})
    assert one(spark, cut(lit("unaffable"))) == ["un", "##aff", "##able"] and one(spark, cut(lit("xyz"))) == ["[UNK]"]


def test_similarities(spark):
    lit = F.lit
    assert one(spark, S.levenshtein(lit("kitten"), lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, S.levenshtein(lit(""), lit(""))) == 1 and one(spark, S.raw_levenshtein(lit("ab"), lit("cd"))) == -1
    assert one(spark, S.levenshtein_at_least(lit("kitten"), lit("sitting"), 0.9)) is None
    assert one(spark, S.jaro_winkler(lit("MARTHA"), lit("MARHTA"))) == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, S.jaro_winkler(lit("DIXON"), lit("DICKSONX"))) == pytest.approx(0.813333, abs=1e-6)
    assert one(spark, S.ngram(lit("same"), lit("same"))) == 1 and one(spark, S.ngram(lit("ab"), lit("ac"))) == 0.5
    assert 0 < one(spark, S.ngram(lit("contexts"), lit("context"))) < 1
    assert one(spark, S.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0)))) == pytest.approx(0.707107, abs=1e-6)
    assert one(spark, S.relative_distance(F.array(lit(3.0)), F.array(lit(-1.0)))) == 1
    assert one(spark, S.two_stage(lit(0.5), lit(0.8), 0.6, 0.7)) == 0.8 and one(spark, S.clamp(lit(1.5))) == 1 and one(spark, S.clamp(lit(0.01))) == 0
    S.register("length", lambda a, b: (F.length(a) == F.length(b)).cast("double"))
    assert one(spark, S.best_of(["exact", "length"], lit("ab"), lit("cd"))) == 1


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=80, deadline=None)
def test_scores_are_symmetric_and_bounded(a, b):
    for f in (S.ngram_score, S.jaro_winkler_score):
        assert 0 <= f(a, b) <= 1 and f(a, a) == 1
    assert S.ngram_score(a, b) == pytest.approx(S.ngram_score(b, a))
