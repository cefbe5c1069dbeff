"""The term codec, in Python and as columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom import terms as T

X = T.XSD


@pytest.mark.parametrize(
    "lexical, kind, expected",
    [
        ("01", "integer", "1"), ("+5", "integer", "5"), ("-007", "integer", "-7"), ("-0", "integer", "0"), ("99999999999999999999", "integer", "99999999999999999999"),
        ("3.140", "decimal", "3.14"), ("03.0", "decimal", "3"), ("1.00", "double", "1.0"), ("1e10", "double", "10000000000.0"), ("0.5", "double", "0.5"),
        ("1e-9", "double", "1.0E-9"), ("x", "integer", "x"), ("TRUE", "boolean", "true"), ("0", "boolean", "false"), ("INF", "double", "INF"),
    ],
)
def test_canonical_forms(lexical, kind, expected):
    assert T.canonical_lexical(lexical, X + kind) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(), st.sampled_from([None, X + "string", "http://e/custom"]), st.sampled_from(["", "en", "de-AT"]))
def test_literals_round_trip(text, datatype, lang):
    got = T.parse_literal(T.literal(text, datatype, lang))
    assert got.lexical == text
    assert got.lang == lang
    if not lang:
        assert got.datatype == (datatype or X + "string")


def test_columns_agree_with_python(spark):
    texts = ["", 'a"b', "back\\slash", "line\nbreak", "\\n", 'x"@en', '"^^<y>', "é😀", "<< a >>", "\\\\"]
    terms = [T.literal(t) for t in texts] + [T.literal(t, lang="en") for t in texts] + [T.literal(t, "http://e/t") for t in texts]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    rows = df.select("t", T.lexical_col(F.col("t")).alias("x"), T.lang_col(F.col("t")).alias("l"), T.datatype_col(F.col("t")).alias("d")).collect()
    for r in rows:
        lit = T.parse_literal(r.t)
        assert (r.x, r.l, r.d) == (lit.lexical, lit.lang, lit.datatype)
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.concat(F.lit('"'), T.escape_col(F.col("t")), F.lit('"')).alias("x")).collect()
    assert all(r.x == T.literal(r.t) for r in plain)


def test_nested_triple_terms(spark):
    inner = T.triple_term("<a>", "<p>", T.literal('>> "quoted" <<'))
    outer = T.triple_term(inner, "<q>", T.triple_term("_:b", "<r>", '"z"@en'))
    df = spark.createDataFrame([(outer,), (inner,), ("<a>",)], "t string")
    rows = df.select(*[T.part_col(F.col("t"), k) for k in (1, 2, 3)]).collect()
    assert tuple(rows[0]) == (inner, "<q>", T.triple_term("_:b", "<r>", '"z"@en'))
    assert tuple(rows[1]) == ("<a>", "<p>", T.literal('>> "quoted" <<'))
    assert tuple(rows[2]) == (None, None, None)


def test_triple_terms_of_any_depth(spark):
    t = '<< <http://e/a> <http://e/p> "x >> \\" << "@en >>'
    for depth in range(8):
        t = T.triple_term(t, "<http://e/q>", f'"{depth}"') if depth % 2 else T.triple_term("_:b", "<http://e/q>", t)
    s, p, o = T.split_triple(t)
    assert T.triple_term(s, p, o) == t and p == "<http://e/q>"
    bad = ["<http://e/a>", '"<< x"', "<< <http://e/a> <http://e/p> >>", "<< <http://e/a> <http://e/p> <http://e/b>", None]
    df = spark.createDataFrame([(x,) for x in [t, *bad]], "t string")
    got = [tuple(r) for r in df.select(*[T.part_col(F.col("t"), k).alias(f"x{k}") for k in (1, 2, 3)]).collect()]
    assert got == [(s, p, o)] + [(None, None, None)] * len(bad)
