"""Query semantics on small stored graphs."""

import itertools

import pytest

from quadloom import terms as T
from quadloom.engine import Engine
from quadloom.errors import LimitExceeded, ParseError, QueryTimeout, UnsupportedError
from quadloom.functions.library import register_function
from quadloom.functions.values import STRING, Val, text
from quadloom.operators import joins
from quadloom.plans.parser import parse_query
from quadloom.sources.mapping import MappedSource, Table
from quadloom.sources.quads import QUAD_SCHEMA, QuadSource
from quadloom.sources.rdf_files import parse_turtle
from quadloom.store import find

DATA = """
@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :Person ; :name "Ann" ; :age 30 ; :knows :b, :c, :a ; :city "Oslo" .
:b a :Person ; :name "Bob"@en ; :age 25 ; :knows :c ; :city "Oslo" .
:c a :Person ; :name "Cid" ; :age 41 ; :knows :a ; :nick "C" .
:d a :Robot ; :name "Ann" ; :age 19.5 ; :knows :e .
:e :name "Eve"@fr ; :age "x" ; :when "2024-05-06T07:08:09"^^xsd:dateTime .
GRAPH :g { :a :name "Ann" . :f :name "Fay" }
"""
PREFIX = {"": "http://e/", "xsd": T.XSD}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(QuadSource(spark.createDataFrame(parse_turtle(DATA), QUAD_SCHEMA).coalesce(2)), prefixes=PREFIX)


def rows(engine, query, **kw):
    r = engine.query(query, **kw)
    return sorted((tuple(x) for x in r.native().collect()), key=repr)


def names(engine, query):
    return [str(r[0]).removeprefix("http://e/") for r in rows(engine, query)]


def test_union_default_graph_is_a_set(engine):
    assert rows(engine, "SELECT ?n { :a :name ?n }") == [("Ann",)]
    assert rows(engine, "SELECT ?g ?n { GRAPH ?g { ?x :name ?n } }") == [("http://e/g", "Ann"), ("http://e/g", "Fay")]
    assert rows(engine, "SELECT (COUNT(*) AS ?n) FROM :g { ?x ?p ?o }") == [(2,)]


@pytest.mark.parametrize("bits", range(16))
def test_all_scan_shapes(engine, bits):
    quads = {tuple(r) for r in engine.source.quads.collect()}
    probe = ("<http://e/a>", "<http://e/name>", '"Ann"', "<http://e/g>")
    given = [t if bits >> k & 1 else None for k, t in enumerate(probe)]
    got = {tuple(r) for r in find(engine.source.quads, *given[:3], (given[3],) if given[3] else ()).collect()}
    assert got == {q for q in quads if all(g is None or g == x for g, x in zip(given, q))}


def test_filters_and_three_valued_logic(engine):
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(?a > 25) }") == ["a", "c"]
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(?a < 20 || ?a > 40) }") == ["c", "d"]
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(?a > 1 || true) }") == ["a", "b", "c", "d", "e"]
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(!(?a > 1)) }") == []
    assert names(engine, "SELECT ?x { ?x :name ?n FILTER(LANG(?n) = 'en') }") == ["b"]
    assert names(engine, "SELECT ?x { ?x :name ?n FILTER(LANGMATCHES(LANG(?n), '*')) }") == ["b", "e"]
    assert names(engine, "SELECT ?x { ?x :name ?n FILTER(?n = 'Ann') }") == ["a", "d"]
    assert names(engine, "SELECT ?x { ?x :name ?n FILTER(REGEX(?n, '^[ab]', 'i')) }") == ["a", "b", "d"]
    assert names(engine, "SELECT ?x { ?x :name ?n FILTER(REGEX(?n, '(')) }") == []
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(?a IN (30, 19.50)) }") == ["a", "d"]
    assert names(engine, "SELECT ?x { ?x :age ?a FILTER(?a NOT IN (30)) }") == ["b", "c", "d"]
    assert names(engine, "SELECT ?x { ?x :when ?w FILTER(?w < '2025-01-01T00:00:00'^^xsd:dateTime && YEAR(?w) = 2024) }") == ["e"]


def test_optional_minus_exists(engine):
    assert rows(engine, "SELECT ?x ?k { ?x a :Person OPTIONAL { ?x :nick ?k } }") == [("http://e/a", None), ("http://e/b", None), ("http://e/c", "C")]
    assert names(engine, "SELECT ?x { ?x a :Person MINUS { ?x :nick ?k } }") == ["a", "b"]
    assert names(engine, "SELECT ?x { ?x a :Person FILTER EXISTS { ?x :knows ?x } }") == ["a"]
    assert names(engine, "SELECT ?x { ?x a :Person FILTER NOT EXISTS { ?x :city ?c } }") == ["c"]
    # the filter of an OPTIONAL sees the left side; an unmatched left row appears once
    assert rows(engine, "SELECT ?x ?y { ?x :age ?a ; a :Person OPTIONAL { ?x :knows ?y . ?y :age ?b FILTER(?b > ?a) } }") == [("http://e/a", "http://e/c"), ("http://e/b", "http://e/c"), ("http://e/c", None)]


def test_unbound_join_variables(engine):
    q = "SELECT ?x ?k ?v { { ?x a :Person OPTIONAL { ?x :nick ?k } } VALUES (?k ?v) { ('C' 1) ('D' 2) (UNDEF 3) } }"
    got = rows(engine, q)
    want = [("http://e/" + x, k, v) for x in "ab" for k, v in (("C", 1), ("D", 2), (None, 3))] + [("http://e/c", "C", 1), ("http://e/c", "C", 3)]
    assert got == sorted(want, key=repr)
    q = "SELECT ?x ?k ?v { { SELECT ?k { OPTIONAL { ?x :nick ?k FILTER(?k = 'none') } } } OPTIONAL { VALUES (?k ?v) { ('C' 1) } } }"
    assert rows(engine, q) == [(None, "C", 1)]


def test_aggregates(engine):
    assert rows(engine, "SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) { ?x :age ?a FILTER(ISNUMERIC(?a)) }") == [(4, "115.5", "19.5", "41")]
    assert rows(engine, "SELECT ?c (COUNT(DISTINCT ?x) AS ?n) { ?x :city ?c } GROUP BY ?c HAVING(COUNT(*) > 1)") == [("Oslo", 2)]
    assert rows(engine, "SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (AVG(?a) AS ?m) { ?x :none ?a }") == [(0, "0", None)]
    assert rows(engine, "SELECT (GROUP_CONCAT(DISTINCT ?n; SEPARATOR='|') AS ?all) { ?x :name ?n }") == [("Ann|Bob|Cid|Eve|Fay",)]
    assert rows(engine, "SELECT (COUNT(DISTINCT *) AS ?n) { { SELECT ?t ?k { ?x a ?t OPTIONAL { ?x :nick ?k } } } }") == [(3,)]


def test_exact_arithmetic(engine):
    one = lambda e: engine.query(f"SELECT ({e} AS ?x) {{}}").terms().first()[0]
    assert one("1 / 4") == T.literal("0.25", T.XSD + "decimal")
    assert one("0.1 + 0.2") == T.literal("0.3", T.XSD + "decimal")
    assert one("1 / 0") is None
    assert one("1e0 / 0") == T.literal("INF", T.XSD + "double")
    assert one("9007199254740993 + 0") == T.literal("9007199254740993", T.XSD + "integer")
    assert one("COALESCE(1/0, false)") == T.literal("false", T.XSD + "boolean")
    assert one("IF(1/0, 1, 2)") is None
    assert one("ROUND(-2.5)") == T.literal("-2", T.XSD + "decimal")
    assert one("SUBSTR('motor'@en, 2, 3)") == '"oto"@en'
    assert one("STRAFTER('abc', 'x')") == '""'
    assert one("CONTAINS('abc', 'b')") == T.literal("true", T.XSD + "boolean")


def test_order_and_slices(engine):
    got = [r[0] for r in engine.query("SELECT ?v { VALUES ?v { 'b' 2 <http://e/z> 10 UNDEF 'a'@en 1.5 } } ORDER BY ?v").native().collect()]
    assert got == [None, "http://e/z", "1.5", "2", "10", "a", "b"]
    got = [r[0] for r in engine.query("SELECT ?n { ?x :name ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1").native().collect()]
    assert got == ["Eve", "Cid"]
    assert [r[0] for r in engine.query("SELECT DISTINCT ?c { ?x :city ?c ; :age ?a } ORDER BY ?a").native().collect()] == ["Oslo"]


def test_paths(engine):
    assert names(engine, "SELECT ?y { :b :knows+ ?y }") == ["a", "b", "c"]
    assert names(engine, "SELECT ?y { :d :knows* ?y }") == ["d", "e"]
    assert names(engine, "SELECT ?x { ?x :knows+ :e }") == ["d"]
    assert names(engine, "SELECT ?y { :b (:knows|^:knows)+ ?y }") == ["a", "b", "c"]
    assert names(engine, "SELECT ?y { :b ^:knows/:name ?y }") == ["Ann"]
    assert names(engine, "SELECT ?y { :c !(:knows|a|:age) ?y }") == ["C", "Cid"]
    assert names(engine, "SELECT ?x { ?x :knows+ ?x }") == ["a", "b", "c"]
    assert names(engine, "SELECT ?y { :nowhere :knows? ?y }") == ["nowhere"]
    assert rows(engine, "ASK { :d :knows+ :a }") == [(False,)]


def test_path_cap_is_an_error(spark, engine):
    with pytest.raises(LimitExceeded):
        Engine(engine.source, path_cap=3, prefixes=PREFIX).query("SELECT * { ?x :knows+ ?y }")


def test_triple_terms(spark):
    data = '@prefix : <http://e/> . :s :p "v" {| :conf 0.9 ; :by :x |} . << :t :p :u >> :conf 0.3 . << << :s :p :o >> :q :r >> :conf 1 .'
    e = Engine(QuadSource(spark.createDataFrame(parse_turtle(data), QUAD_SCHEMA)), prefixes=PREFIX)
    assert names(e, "SELECT ?s { << ?s :p ?o >> :conf ?c FILTER(?c > 0.5) }") == ["s"]
    assert names(e, "SELECT ?w { << :s :p 'v' >> :by ?w }") == ["x"]
    assert names(e, "SELECT ?z { << << ?z :p ?o >> :q ?r >> :conf ?c }") == ["s"]
    assert rows(e, "SELECT (COUNT(*) AS ?n) { ?t :conf ?c FILTER(ISTRIPLE(SUBJECT(?t))) }") == [(1,)]
    assert e.query("SELECT (TRIPLE(:a, :b, 'c') AS ?t) {}").terms().first()[0] == '<< <http://e/a> <http://e/b> "c" >>'


QUERIES = [
    "SELECT ?x ?y { ?x :knows ?y . ?y :knows ?x }",
    "SELECT ?x ?n { ?x :knows ?y . ?y :name ?n . ?x :age ?a FILTER(?a > 20) }",
    "SELECT ?x ?k { ?x :name ?n OPTIONAL { ?x :nick ?k } FILTER(!BOUND(?k)) }",
    "SELECT ?x ?y { { ?x :knows ?y } UNION { ?y :knows ?x } }",
    "SELECT ?a ?b { ?a :city ?c . ?b :city ?c FILTER(STR(?a) < STR(?b)) }",
]


@pytest.mark.parametrize("q", QUERIES)
def test_reordering_changes_nothing(engine, q):
    assert rows(engine, q) == rows(Engine(engine.source, reorder=False, prefixes=PREFIX), q)


def test_joins_against_brute_force(spark):
    """Every small binding table joined by hand and by the engine."""
    values = [None, '"1"', '"2"']
    left = list(itertools.product(values, values))[:7]
    right = list(itertools.product(values, values))[2:]
    cell = lambda v: v.replace('"', "'") if v else "UNDEF"
    table = lambda vs, rs: f"VALUES ({vs}) {{ {' '.join('(' + ' '.join(map(cell, r)) + ')' for r in rs)} }}"
    e = Engine(QuadSource(spark.createDataFrame([], QUAD_SCHEMA)), prefixes=PREFIX)
    agree = lambda a, b: a is None or b is None or a == b
    strip = lambda v: v and v.strip('"')
    pairs = [(l[0] or r[0], l[1] or r[1]) for l in left for r in right if agree(l[0], r[0]) and agree(l[1], r[1])]  # noqa: E741
    want = sorted((tuple(map(strip, p)) for p in pairs), key=repr)
    assert rows(e, f"SELECT ?a ?b {{ {table('?a ?b', left)} {table('?a ?b', right)} }}") == want
    lonely = [l for l in left if not any(agree(l[0], r[0]) and agree(l[1], r[1]) for r in right)]  # noqa: E741
    got = rows(e, f"SELECT ?a ?b {{ {table('?a ?b', left)} OPTIONAL {{ {table('?a ?b', right)} }} }}")
    assert got == sorted([tuple(map(strip, p)) for p in pairs + lonely], key=repr)
    kept = [l for l in left if not any(agree(l[0], r[0]) and agree(l[1], r[1]) and any(x and y for x, y in zip(l, r)) for r in right[:2])]  # noqa: E741
    got = rows(e, f"SELECT ?a ?b {{ {table('?a ?b', left)} MINUS {{ {table('?a ?b', right[:2])} }} }}")
    assert got == sorted((tuple(map(strip, p)) for p in kept), key=repr)


def test_construct_describe_bindings_functions(engine):
    assert rows(engine, "CONSTRUCT { ?y :knownBy ?x } WHERE { ?x :knows ?y . ?x a :Robot }") == [("http://e/e", "http://e/knownBy", "http://e/d")]
    assert len(rows(engine, "DESCRIBE :c")) == 5
    assert rows(engine, "SELECT ?x ?n { ?x :name ?n }", bindings={"x": "<http://e/c>"}) == [("http://e/c", "Cid")]
    register_function("http://e/shout", lambda a: Val(STRING, __import__("pyspark").sql.functions.upper(text(a))))
    assert rows(engine, "SELECT (:shout(?n) AS ?s) { :c :name ?n }") == [("CID",)]


def test_errors_and_timeout(engine):
    for bad in ("SELECT", "SELECT ?x { ?x ?y }", "SELECT ?x { ?x :p ?y } LIMIT x", "SELECT ?x { BIND(1 AS ?x) BIND(2 AS ?x) }", "FROB { }"):
        with pytest.raises((ParseError, ValueError)):
            parse_query(bad, prefixes=PREFIX)
    with pytest.raises(UnsupportedError):
        parse_query("SELECT * { SERVICE <http://x> { ?s ?p ?o } }")
    with pytest.raises(QueryTimeout):
        engine.with_timeout(lambda: engine.source.spark.range(10**12).selectExpr("sum(hash(id) % 7)").collect(), 1.0)


def test_joins_follow_keys(spark, monkeypatch):
    """Two tables that share a foreign key are joined after what tells their rows apart, whatever their sizes."""
    n = 300
    frames = {
        "nation": spark.range(1).selectExpr("id", "'N' name"),
        "customer": spark.range(n).selectExpr("id", "0L nation"),
        "supplier": spark.range(n).selectExpr("id", "0L nation"),
        "sale": spark.range(2 * n).selectExpr("id", "id % 7 customer", "id % 11 supplier", "id amount", "repeat('x', 100) note"),
    }
    links = {"customer": {"nation": "nation"}, "supplier": {"nation": "nation"}, "sale": {"customer": "customer", "supplier": "supplier"}}
    columns = {"nation": ["name"], "sale": ["amount", "note"]}
    tables = [
        Table(t, f"http://e/{t}", lambda t=t: frames[t], "id", {f"http://e/{c}": c for c in columns.get(t, [])}, {f"http://e/{t}_{c}": (c, to) for c, to in links.get(t, {}).items()})
        for t in frames
    ]
    sizes, join = [], joins.join

    def counted(a, b):
        out = join(a, b)
        sizes.append(out.df.count())
        return out

    monkeypatch.setattr(joins, "join", counted)
    q = "SELECT (SUM(?a) AS ?n) WHERE { ?x :name 'N' . ?c :customer_nation ?x . ?s :supplier_nation ?x . ?l :sale_customer ?c ; :sale_supplier ?s ; :amount ?a }"
    assert rows(Engine(MappedSource(spark, tables), prefixes=PREFIX), q) == [(n * (2 * n - 1),)]
    assert max(sizes) <= 2 * n
