"""Registered queries over the star-schema graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .engine import Engine
from .errors import LimitExceeded
from .functions import values as V
from .operators import joins
from .plans.algebra import Pattern
from .runtime import new_path
from .schema import V as VOCAB
from .schema import tpch_source
from .sources.mapping import BASE, MappedSource
from .sources.quads import QuadSource
from .sources import rdf_files, writers
from .store import Store, batch_lookup, find, type_view
from .streaming import oplog

PREFIXES = {"v": VOCAB, "": BASE, "xsd": T.XSD, "rdf": T.RDF}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(tpch_source(spark, sf_dir), prefixes=PREFIXES, **options)


def mapped(name: str, sparql: str, sql: str) -> None:
    """A query over the mapped tables."""
    QUERIES[name] = lambda spark, d: engine(spark, d).query(sparql).native()
    ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ---- stored quads, derived from the tables


def quads(spark: SparkSession, sf_dir: str, *tables: str, graph: str | None = None) -> DataFrame:
    """The quads of whole mapped tables, in one graph."""
    source = tpch_source(spark, sf_dir)
    source = MappedSource(spark, [t for t in source.tables if t.name in tables])
    r = source._open(Pattern("?s", "?p", "?o"), ("default", None)).converted({"s": V.TERM, "p": V.TERM, "o": V.TERM})
    return r.df.select("s", "p", "o", F.lit(graph or T.DEFAULT_GRAPH).alias("c"))


def edges(spark: SparkSession, rows: DataFrame, predicate: str) -> DataFrame:
    """Quads between nodes <node/k> from (src, dst)."""
    node = lambda c: F.concat(F.lit(f"<{BASE}node/"), F.col(c).cast("string"), F.lit(">"))
    return rows.select(node("src").alias("s"), F.lit(f"<{VOCAB}{predicate}>").alias("p"), node("dst").alias("o"), F.lit(T.DEFAULT_GRAPH).alias("c"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """part k -> part k/2: a tree of logarithmic depth."""
    p = spark.read.parquet(f"{d}/part.parquet").where("p_partkey >= 2")
    return edges(spark, p.selectExpr("p_partkey src", "p_partkey div 2 dst"), "up")


def ring(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return edges(spark, n.selectExpr("n_nationkey src", "(n_nationkey + 1) % 25 dst"), "next")


def stored(name: str, build: Callable[[SparkSession, str], DataFrame], sparql: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: Engine(QuadSource(build(spark, d), one_graph=True), prefixes=PREFIXES).query(sparql).native()
    ORACLES[name] = sql


_TREE = "SELECT p_partkey src, p_partkey // 2 dst FROM part WHERE p_partkey >= 2"
_RING = "SELECT n_nationkey src, (n_nationkey + 1) % 25 dst FROM nation"
_NODE = "'http://ex.org/node/' || "


def _small(spark: SparkSession, d: str) -> DataFrame:
    return quads(spark, d, "nation", "region")


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    """nation in one graph, region in two and in the default graph."""
    n = quads(spark, d, "nation", graph=f"<{BASE}g/nations>")
    r = [quads(spark, d, "region", graph=g) for g in (f"<{BASE}g/regions>", f"<{BASE}g/copy>", None)]
    return reduce(lambda a, b: a.unionByName(b), [n, *r])


# ---- scans

mapped("op03_bgp", "SELECT ?name WHERE { ?n v:n_name ?name }", "SELECT n_name AS name FROM nation")
mapped("op04_exists_constant", "SELECT (COUNT(*) AS ?n) WHERE { :region\\/1 v:r_name ?x }", "SELECT count(*) AS n FROM region WHERE r_regionkey = 1")

_NQ = (
    "SELECT 'http://ex.org/nation/' || n_nationkey AS s, 'http://ex.org/v#n_name' AS p, n_name AS o FROM nation"
    " UNION ALL SELECT 'http://ex.org/nation/' || n_nationkey, 'http://ex.org/v#n_region', 'http://ex.org/region/' || n_regionkey FROM nation"
    " UNION ALL SELECT 'http://ex.org/nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/v#Nation' FROM nation"
    " UNION ALL SELECT 'http://ex.org/region/' || r_regionkey, 'http://ex.org/v#r_name', r_name FROM region"
    " UNION ALL SELECT 'http://ex.org/region/' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/v#Region' FROM region"
)
_S, _P, _O = f"<{BASE}nation/3>", f"<{VOCAB}n_region>", f"<{BASE}region/3>"
for _bits in range(8):
    _name = "op01_find_" + ("".join(k for k, b in zip("spo", (4, 2, 1)) if _bits & b) or "all")
    _given = {k: t for k, t, b in zip("spo", (_S, _P, _O), (4, 2, 1)) if _bits & b}

    def _find(spark, d, given=dict(_given)):
        f = find(_small(spark, d), **given)
        plain = lambda c: F.regexp_replace(F.regexp_replace(c, '^[<"]', ""), '[>"]$', "")
        return f.select(*[plain(F.col(c)).alias(c) for c in "spo"])

    QUERIES[_name] = _find
    ORACLES[_name] = f"SELECT * FROM ({_NQ}) WHERE true" + "".join(f" AND {k} = '{t[1:-1]}'" for k, t in _given.items())

stored("op05_repeated_var", lambda s, d: ring(s, d).unionByName(edges(s, s.read.parquet(f"{d}/region.parquet").selectExpr("r_regionkey src", "r_regionkey dst"), "next")), "SELECT ?x WHERE { ?x v:next ?x }", f"SELECT {_NODE} r_regionkey AS x FROM region")
mapped("op06_graph_const", "SELECT ?x WHERE { GRAPH <http://ex.org/graph/click> { ?e v:events_value ?x } }", "SELECT value AS x FROM events WHERE event_type = 'click'")
mapped("op06_graph_var", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e v:events_value ?x } } GROUP BY ?g", "SELECT 'http://ex.org/graph/' || event_type AS g, count(*) AS n FROM events GROUP BY 1")


@query("op06_union_default_graph", "SELECT r_name AS x FROM region")
def _union_default(spark, d):
    """A triple in three graphs is one solution where no graph is asked for."""
    return Engine(QuadSource(_graphs(spark, d)), prefixes=PREFIXES).query("SELECT ?x WHERE { ?r v:r_name ?x }").native()


@query("op06_graph_var_named_only", "SELECT 'http://ex.org/g/' || g AS g, count(*) AS n FROM region, (VALUES ('regions'), ('copy')) t(g) GROUP BY 1")
def _named_only(spark, d):
    return Engine(QuadSource(_graphs(spark, d)), prefixes=PREFIXES).query("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?r v:r_name ?x } } GROUP BY ?g").native()


@query("op16_from", "SELECT count(*) AS n FROM region")
def _from(spark, d):
    return Engine(QuadSource(_graphs(spark, d)), prefixes=PREFIXES).query("SELECT (COUNT(*) AS ?n) FROM :g\\/regions FROM :g\\/copy WHERE { ?r v:r_name ?x }").native()


@query("op16_from_named", "SELECT 'http://ex.org/g/copy' AS g, count(*) AS n FROM region")
def _from_named(spark, d):
    return Engine(QuadSource(_graphs(spark, d)), prefixes=PREFIXES).query("SELECT ?g (COUNT(*) AS ?n) FROM NAMED :g\\/copy WHERE { GRAPH ?g { ?r v:r_name ?x } } GROUP BY ?g").native()


mapped("op07_values", "SELECT ?r ?n WHERE { VALUES ?rn { 'ASIA' 'EUROPE' } ?x v:r_name ?rn . ?y v:n_region ?x ; v:n_name ?n BIND(?rn AS ?r) }", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
mapped(
    "op07_values_undef",
    "SELECT ?a ?n WHERE { VALUES (?rn ?a) { ('ASIA' 1) (UNDEF 2) } ?x v:r_name ?rn BIND(?rn AS ?n) }",
    "SELECT 1::BIGINT AS a, r_name AS n FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 2, r_name FROM region",
)
mapped("op08_singleton", "SELECT ?x WHERE { BIND(7 AS ?x) }", "SELECT 7::BIGINT AS x")
mapped("op09_empty", "SELECT ?x WHERE { ?n v:n_name ?x FILTER(false) }", "SELECT n_name AS x FROM nation WHERE false")
mapped("q10_type_lookup", "SELECT ?x WHERE { ?x a v:Supplier }", "SELECT 'http://ex.org/supplier/' || s_suppkey AS x FROM supplier")


@query("q10_type_view", "SELECT 'http://ex.org/v#Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'http://ex.org/v#Region', count(*) FROM region")
def _type_view(spark, d):
    return type_view(_small(spark, d)).groupBy(F.regexp_extract("type", "^<(.*)>$", 1).alias("type")).agg(F.count("*").alias("n"))


@query("op11_types_of_subject", "SELECT 'http://ex.org/v#Nation' AS type")
def _types_of(spark, d):
    return type_view(_small(spark, d)).where(F.col("s") == _S).select(F.regexp_extract("type", "^<(.*)>$", 1).alias("type"))


@query("op12_contexts", "SELECT * FROM (VALUES ('http://ex.org/g/copy'), ('http://ex.org/g/nations'), ('http://ex.org/g/regions')) t(g)")
def _contexts(spark, d):
    return QuadSource(_graphs(spark, d)).graph_names().select(F.regexp_extract("c", "^<(.*)>$", 1).alias("g"))


@query("op13_count_statements", "SELECT CASE g WHEN 1 THEN 'http://ex.org/g/nations' WHEN 2 THEN 'http://ex.org/g/regions' WHEN 3 THEN 'http://ex.org/g/copy' ELSE '' END AS g, CASE WHEN g = 1 THEN (SELECT 3 * count(*) FROM nation) ELSE (SELECT 2 * count(*) FROM region) END::BIGINT AS n FROM range(1, 5) t(g)")
def _count(spark, d):
    return _graphs(spark, d).groupBy(F.regexp_extract("c", "^<(.*)>$", 1).alias("g")).agg(F.count("*").alias("n"))


@query("op14_batch_lookup", "SELECT 'http://ex.org/nation/' || n_nationkey AS s, n_name AS o FROM nation WHERE n_regionkey = 1")
def _batch(spark, d):
    q = _small(spark, d)
    subjects = q.where((F.col("p") == _P) & (F.col("o") == f"<{BASE}region/1>")).select("s")
    found = batch_lookup(q, subjects, f"<{VOCAB}n_name>")
    return found.select(F.regexp_extract("s", "^<(.*)>$", 1).alias("s"), T.lexical_col(F.col("o")).alias("o"))


@query("op15_statements_in_contexts", "SELECT 4 * count(*) AS n FROM region")
def _statements(spark, d):
    return find(_graphs(spark, d), contexts=(f"<{BASE}g/regions>", f"<{BASE}g/copy>", f"<{BASE}g/copy>")).agg(F.count("*").alias("n"))


# ---- projection, filter, bind

mapped("op28_project", "SELECT ?t ?p ?none WHERE { ?x v:p_type ?t ; v:p_retailprice ?p }", "SELECT p_type AS t, p_retailprice AS p, NULL::VARCHAR AS none FROM part")
mapped("op29_alias", "SELECT (?n AS ?name) (?k AS ?type) WHERE { ?x v:p_name ?n ; v:p_type ?k }", "SELECT p_name AS name, p_type AS type FROM part")
mapped("op30_filter", "SELECT ?q ?p WHERE { ?l v:l_quantity ?q ; v:l_extendedprice ?p FILTER(?q > 45 && ?p < 20000) }", "SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_quantity > 45 AND l_extendedprice < 20000")
mapped("op31_bind", "SELECT ?a ?b WHERE { ?l v:l_extendedprice ?p ; v:l_discount ?d ; v:l_tax ?t BIND(?p * (1 - ?d) AS ?a) BIND(?a * (1 + ?t) AS ?b) }", "SELECT l_extendedprice * (1 - l_discount) AS a, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS b FROM lineitem")
mapped("op32_bind_above_group", "SELECT ?f ?n (?n * 2 AS ?m) WHERE { { SELECT ?f (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f } GROUP BY ?f } }", "SELECT l_returnflag AS f, count(*) AS n, count(*) * 2 AS m FROM lineitem GROUP BY 1")
mapped("op33_having", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c v:c_nation ?x . ?x v:n_name ?n } GROUP BY ?n HAVING(COUNT(?c) > 6)", "SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 6")


@query("op34_initial_bindings", "SELECT n_name AS n, 'http://ex.org/region/2' AS r FROM nation WHERE n_regionkey = 2")
def _bindings(spark, d):
    return engine(spark, d).query("SELECT ?n ?r WHERE { ?x v:n_region ?r ; v:n_name ?n }", {"r": f"<{BASE}region/2>"}).native()


# ---- joins

mapped(
    "op35_join_chain",
    "SELECT ?seg (SUM(?q) AS ?s) WHERE { ?l v:l_order ?o ; v:l_quantity ?q . ?o v:o_customer ?c . ?c v:c_mktsegment ?seg } GROUP BY ?seg",
    "SELECT c_mktsegment AS seg, sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
mapped("op36_cross", "SELECT ?a ?b WHERE { ?x v:r_name ?a . ?y v:r_name ?b }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
mapped("op37_optional", "SELECT ?d ?q WHERE { ?d v:documents_n_chars ?n OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q } }", "SELECT 'http://ex.org/documents/' || d.doc_id AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
mapped(
    "op37_optional_filter",
    "SELECT ?c ?p WHERE { ?c v:c_acctbal ?b OPTIONAL { ?o v:o_customer ?c ; v:o_totalprice ?p FILTER(?p > 300000 && ?b > 0) } }",
    "SELECT 'http://ex.org/customer/' || c_custkey AS c, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 AND c_acctbal > 0",
)
mapped(
    "op38_optional_chain",
    "SELECT ?d ?q ?t WHERE { ?d v:documents_lang 'de' OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q FILTER(?q = 0) } OPTIONAL { ?m v:labels_document ?d ; v:labels_toxic ?t FILTER(?t = 1) } }",
    "SELECT 'http://ex.org/documents/' || d.doc_id AS d, a.quality::BIGINT AS q, b.toxic::BIGINT AS t FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id AND a.quality = 0 LEFT JOIN labels b ON b.doc_id = d.doc_id AND b.toxic = 1 WHERE lang = 'de'",
)
mapped("op39_self_join", "SELECT ?a ?b WHERE { ?a v:s_nation ?n . ?b v:s_nation ?n }", "SELECT 'http://ex.org/supplier/' || a.s_suppkey AS a, 'http://ex.org/supplier/' || b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey)")
mapped("op39_self_join_less", "SELECT ?x ?y WHERE { ?a v:s_nation ?n ; v:s_name ?x . ?b v:s_nation ?n ; v:s_name ?y FILTER(?x < ?y) }", "SELECT a.s_name AS x, b.s_name AS y FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_name < b.s_name")
mapped("op40_enrich", "SELECT ?o ?name WHERE { ?o v:o_orderpriority '1-URGENT' ; v:o_customer ?c . ?c v:c_name ?name }", "SELECT 'http://ex.org/orders/' || o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
mapped(
    "op41_star_join",
    "SELECT ?q ?p ?d ?f ?s WHERE { ?l v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_returnflag ?f ; v:l_linestatus ?s }",
    "SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_returnflag AS f, l_linestatus AS s FROM lineitem",
)
mapped("op43_minus", "SELECT ?d WHERE { ?d a v:Document MINUS { ?l v:labels_document ?d } }", "SELECT 'http://ex.org/documents/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
mapped("op43_minus_disjoint", "SELECT ?n WHERE { ?x v:r_name ?n MINUS { ?y v:n_name ?m } }", "SELECT r_name AS n FROM region")
mapped("op43_exists", "SELECT ?o WHERE { ?o a v:Order FILTER EXISTS { ?l v:l_order ?o ; v:l_quantity ?q FILTER(?q = 50) } }", "SELECT 'http://ex.org/orders/' || o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
mapped("op43_not_exists", "SELECT ?o WHERE { ?o a v:Order FILTER NOT EXISTS { ?l v:l_order ?o } }", "SELECT 'http://ex.org/orders/' || o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
mapped("op43_exists_outer_var", "SELECT ?c WHERE { ?c v:c_acctbal ?b FILTER EXISTS { ?o v:o_customer ?c ; v:o_totalprice ?p FILTER(?p < ?b) } }", "SELECT 'http://ex.org/customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)")
mapped("op43_exists_in_expression", "SELECT ?d ?has WHERE { ?d v:documents_lang 'es' BIND(EXISTS { ?l v:labels_document ?d } AS ?has) }", "SELECT 'http://ex.org/documents/' || doc_id AS d, doc_id IN (SELECT doc_id FROM labels) AS has FROM documents WHERE lang = 'es'")
mapped("op44_ask", "ASK { ?c v:c_mktsegment 'BUILDING' ; v:c_acctbal ?b FILTER(?b > 9000) }", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) AS ask")


@query("op35_unbound_key", "SELECT n_name AS n, k FROM nation JOIN (VALUES ('NATION_1', 1), ('NATION_2', 2), (NULL, 3)) t(m, k) ON m IS NULL OR m = n_name")
def _unbound(spark, d):
    """An unbound join variable agrees with every value."""
    e = engine(spark, d)
    left = e.query("SELECT ?n WHERE { ?x v:n_name ?n }").rel
    right = e.query("SELECT ?n ?k WHERE { VALUES (?n ?k) { ('NATION_1' 1) ('NATION_2' 2) (UNDEF 3) } }").rel
    out = joins.join(left, right)
    return out.df.select("n", F.col("k").cast("int").alias("k"))


# ---- aggregation

mapped(
    "op46_group",
    "SELECT ?f ?s (SUM(?q) AS ?sq) (SUM(?p * (1 - ?d)) AS ?rev) (AVG(?q) AS ?aq) (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?s ; v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d } GROUP BY ?f ?s",
    "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sq, sum(l_extendedprice * (1 - l_discount)) AS rev, avg(l_quantity) AS aq, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
QUERIES["op46_group"] = lambda spark, d: _rounded(engine(spark, d).query(
    "SELECT ?f ?s (SUM(?q) AS ?sq) (SUM(?p * (1 - ?d)) AS ?rev) (AVG(?q) AS ?aq) (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?s ; v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d } GROUP BY ?f ?s").native(), "rev", "aq")
ORACLES["op46_group"] = "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sq, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_quantity), 2) AS aq, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


mapped("op47_count_bound", "SELECT (COUNT(*) AS ?a) (COUNT(?q) AS ?b) WHERE { ?d a v:Document OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q } }", "SELECT count(*) AS a, count(quality) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
mapped("op48_count_distinct", "SELECT ?f (COUNT(DISTINCT ?p) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_part ?p } GROUP BY ?f", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
mapped(
    "op48_count_distinct_rows",
    "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { { SELECT ?k ?q WHERE { ?d v:documents_lang ?k OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q } } } }",
    "SELECT count(*) AS n FROM (SELECT DISTINCT lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
)
mapped("op49_sum_integers", "SELECT (SUM(?s) AS ?t) WHERE { ?p v:p_size ?s }", "SELECT sum(p_size)::BIGINT AS t FROM part")


def _large(spark: SparkSession, d: str) -> DataFrame:
    """Integers of 22 digits: more than 64 bits hold."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("9"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 21, "0")).alias("v"))
    return p.select(F.format_string(f"<{BASE}part/%d>", "p_partkey").alias("s"), F.lit(f"<{VOCAB}large>").alias("p"), F.format_string(f'"%s"^^<{T.XSD}integer>', "v").alias("o"), F.lit(T.DEFAULT_GRAPH).alias("c"))


_LARGE = "(SELECT 9::HUGEINT * 1000000000000000000000::HUGEINT + p_partkey % 1000 AS v FROM part)"
for _name, _distinct in (("op49_sum_beyond_64_bits", ""), ("op50_sum_distinct_beyond_64_bits", "DISTINCT ")):
    QUERIES[_name] = lambda spark, d, q=_distinct: Engine(QuadSource(_large(spark, d), one_graph=True), prefixes=PREFIXES).query(f"SELECT (SUM({q}?v) AS ?t) WHERE {{ ?x v:large ?v }}").native()
    ORACLES[_name] = f"SELECT sum({_distinct}v)::VARCHAR AS t FROM {_LARGE}"
mapped("op50_sum_distinct", "SELECT (SUM(DISTINCT ?s) AS ?t) (AVG(DISTINCT ?s) AS ?a) WHERE { ?p v:p_size ?s }", "SELECT sum(DISTINCT p_size)::BIGINT AS t, avg(DISTINCT p_size) AS a FROM part")
QUERIES["op50_sum_distinct"] = lambda spark, d: _rounded(engine(spark, d).query("SELECT (SUM(DISTINCT ?s) AS ?t) (AVG(DISTINCT ?s) AS ?a) WHERE { ?p v:p_size ?s }").native(), "a")
ORACLES["op50_sum_distinct"] = "SELECT sum(DISTINCT p_size)::BIGINT AS t, round(avg(DISTINCT p_size), 2) AS a FROM part"
QUERIES["op51_avg_integers"] = lambda spark, d: _rounded(engine(spark, d).query("SELECT ?b (AVG(?s) AS ?a) WHERE { ?p v:p_size ?s ; v:p_brand ?b } GROUP BY ?b").native(), "a")
ORACLES["op51_avg_integers"] = "SELECT p_brand AS b, round(avg(p_size), 2) AS a FROM part GROUP BY 1"
mapped("op52_min_max", "SELECT ?s (MIN(?p) AS ?lo) (MAX(?d) AS ?hi) WHERE { ?o v:o_orderstatus ?s ; v:o_totalprice ?p ; v:o_orderdate ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1")
mapped("op53_empty_group", "SELECT (COUNT(*) AS ?n) (SUM(?b) AS ?s) (MIN(?b) AS ?m) WHERE { ?c v:c_acctbal ?b FILTER(?b > 1e9) }", "SELECT count(*) AS n, coalesce(sum(c_acctbal), 0) AS s, min(c_acctbal) AS m FROM customer WHERE c_acctbal > 1e9")
mapped("op55_group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=',') AS ?all) WHERE { ?x v:n_region ?y ; v:n_name ?n . ?y v:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS all FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1".replace(" AS all", ' AS "all"'))
mapped("op55_sample", "SELECT ?r (SAMPLE(?r2) AS ?s) WHERE { ?x v:n_region ?y . ?y v:r_name ?r BIND(?r AS ?r2) } GROUP BY ?r", "SELECT DISTINCT r_name AS r, r_name AS s FROM region JOIN nation ON n_regionkey = r_regionkey")
mapped("op56_group_expression", "SELECT ?y (COUNT(*) AS ?n) (SUM(?q) AS ?s) WHERE { ?l v:l_shipdate ?d ; v:l_quantity ?q } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(l_shipdate)::BIGINT AS y, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1")

# ---- sort, limit, set operations

mapped("op58_order", "SELECT ?n ?b WHERE { ?c v:c_name ?n ; v:c_acctbal ?b } ORDER BY DESC(?b) ?n LIMIT 20", "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
mapped("op58_order_unbound", "SELECT ?d ?q WHERE { ?x v:documents_n_chars ?d OPTIONAL { ?l v:labels_document ?x ; v:labels_quality ?q } } ORDER BY ?q ?d ?x LIMIT 30", "SELECT n_chars AS d, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality NULLS FIRST, n_chars, 'http://ex.org/documents/' || d.doc_id LIMIT 30")
mapped("op60_slice", "SELECT ?n WHERE { ?c v:c_name ?n } ORDER BY ?n OFFSET 10 LIMIT 15", "SELECT c_name AS n FROM customer ORDER BY 1 LIMIT 15 OFFSET 10")
mapped("op61_top_k", "SELECT ?o ?p WHERE { ?o v:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10", "SELECT 'http://ex.org/orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
mapped("op62_distinct_order", "SELECT DISTINCT ?t WHERE { ?p v:p_type ?t } ORDER BY ?t LIMIT 5", "SELECT DISTINCT p_type AS t FROM part ORDER BY 1 LIMIT 5")
mapped("op62_distinct_hidden_key", "SELECT DISTINCT ?b WHERE { ?p v:p_brand ?b ; v:p_retailprice ?r } ORDER BY ?r ?b LIMIT 4", "SELECT p_brand AS b FROM part GROUP BY 1 ORDER BY min(p_retailprice), 1 LIMIT 4")
mapped("op63_reduced", "SELECT REDUCED ?s WHERE { ?o v:o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders")
mapped("op64_union_bag", "SELECT ?x WHERE { { ?n v:n_name ?x } UNION { ?r v:r_name ?x } UNION { ?m v:n_name ?x } }", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
mapped("op64_union_hetero", "SELECT ?a ?b WHERE { { ?n v:n_name ?a } UNION { ?r v:r_name ?b } }", "SELECT n_name AS a, NULL AS b FROM nation UNION ALL SELECT NULL, r_name FROM region")

# ---- property paths

stored("op66_plus", tree, "SELECT ?x ?y WHERE { ?x v:up+ ?y }", f"WITH RECURSIVE e AS ({_TREE}), t AS (SELECT * FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src) SELECT {_NODE} src AS x, {_NODE} dst AS y FROM t")
stored("op66_plus_bound", ring, "SELECT ?y WHERE { <http://ex.org/node/3> v:next+ ?y }", f"SELECT {_NODE} n_nationkey AS y FROM nation")
stored("op66_plus_bound_object", tree, "SELECT ?x WHERE { ?x v:up+ <http://ex.org/node/5> }", f"WITH RECURSIVE e AS ({_TREE}), t AS (SELECT src FROM e WHERE dst = 5 UNION SELECT e.src FROM t JOIN e ON e.dst = t.src) SELECT {_NODE} src AS x FROM t")
stored("op67_star", ring, "SELECT ?x ?y WHERE { ?x v:next* ?y }", f"SELECT {_NODE} a.n_nationkey AS x, {_NODE} b.n_nationkey AS y FROM nation a, nation b")
stored("op67_star_absent", ring, "SELECT ?y WHERE { <http://ex.org/elsewhere> v:next* ?y }", "SELECT 'http://ex.org/elsewhere' AS y")
stored("op68_optional_step", ring, "SELECT ?x ?y WHERE { ?x v:next? ?y }", f"SELECT {_NODE} src AS x, {_NODE} dst AS y FROM ({_RING} UNION SELECT n_nationkey, n_nationkey FROM nation)")
mapped("op69_sequence", "SELECT ?o ?r WHERE { ?o v:o_customer/v:c_nation/v:n_region/v:r_name ?r }", "SELECT 'http://ex.org/orders/' || o_orderkey AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
mapped("op69_alternative", "SELECT ?x ?n WHERE { ?x v:c_nation|v:s_nation ?n }", "SELECT 'http://ex.org/customer/' || c_custkey AS x, 'http://ex.org/nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'http://ex.org/supplier/' || s_suppkey, 'http://ex.org/nation/' || s_nationkey FROM supplier")
mapped("op69_inverse", "SELECT ?r ?n WHERE { ?r ^v:n_region/v:n_name ?n }", "SELECT 'http://ex.org/region/' || n_regionkey AS r, n_name AS n FROM nation")
stored("op69_negated_set", _small, "SELECT ?s ?o WHERE { ?s !(a|v:n_name|v:r_name) ?o }", "SELECT 'http://ex.org/nation/' || n_nationkey AS s, 'http://ex.org/region/' || n_regionkey AS o FROM nation")
stored(
    "op70_alternative_plus",
    lambda s, d: tree(s, d).unionByName(ring(s, d)),
    "SELECT ?y WHERE { <http://ex.org/node/40> (v:up|v:next)+ ?y }",
    f"WITH RECURSIVE e AS ({_TREE} UNION {_RING}), t AS (SELECT dst FROM e WHERE src = 40 UNION SELECT e.dst FROM t JOIN e ON t.dst = e.src) SELECT {_NODE} dst AS y FROM t",
)
stored("op71_repeated_path_var", ring, "SELECT ?x WHERE { ?x v:next+ ?x }", f"SELECT {_NODE} n_nationkey AS x FROM nation")


def _zero(name: str, path: str) -> None:
    @query(name, "SELECT 'http://ex.org/g/' || g AS g, count(*) AS n FROM nation, (VALUES ('nations'), ('regions'), ('copy')) t(g) WHERE n_nationkey = 1 GROUP BY 1")
    def run(spark, d):
        """The path of no steps is in every named graph."""
        return Engine(QuadSource(_graphs(spark, d)), prefixes=PREFIXES).query(f"SELECT ?g (COUNT(?y) AS ?n) WHERE {{ GRAPH ?g {{ <http://ex.org/elsewhere> v:next{path} ?y }} }} GROUP BY ?g").native()


_zero("op67_star_in_graphs", "*")
_zero("op68_optional_step_in_graphs", "?")


@query("op73_path_in_graph", f"SELECT {_NODE} b.n_nationkey AS y FROM nation b")
def _path_in_graph(spark, d):
    g = ring(spark, d).withColumn("c", F.lit(f"<{BASE}g/ring>"))
    other = tree(spark, d).withColumn("p", F.lit(f"<{VOCAB}next>"))
    q = "SELECT ?y WHERE { GRAPH <http://ex.org/g/ring> { <http://ex.org/node/24> v:next+ ?y } }"
    return Engine(QuadSource(g.unionByName(other)), prefixes=PREFIXES).query(q).native()


# ---- triple terms


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Each order's status is a triple, annotated with a confidence and the customer who says so."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = F.concat(F.lit(f"<{BASE}orders/"), F.col("o_orderkey").cast("string"), F.lit(">"))
    status = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    p = F.lit(f"<{VOCAB}status>")
    t = F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), status, F.lit(" >>"))
    confidence = V.typed(T.double_text(F.round(F.col("o_totalprice") / 600000, 3)), "double")
    who = F.concat(F.lit(f"<{BASE}customer/"), F.col("o_custkey").cast("string"), F.lit(">"))
    graph = F.lit(T.DEFAULT_GRAPH).alias("c")
    base = o.select(s.alias("s"), p.alias("p"), status.alias("o"), graph)
    conf = o.select(t.alias("s"), F.lit(f"<{VOCAB}confidence>").alias("p"), confidence.alias("o"), graph)
    says = o.select(t.alias("s"), F.lit(f"<{VOCAB}saidBy>").alias("p"), who.alias("o"), graph)
    return base.unionByName(conf).unionByName(says)


stored("op74_constant_triple", _annotated, "SELECT ?w WHERE { << <http://ex.org/orders/7> v:status ?s >> v:saidBy ?w }", "SELECT 'http://ex.org/customer/' || o_custkey AS w FROM orders WHERE o_orderkey = 7")
stored(
    "op75_decompose",
    _annotated,
    "SELECT ?o ?s WHERE { << ?o v:status ?s >> v:confidence ?c FILTER(?c > 0.5) }",
    "SELECT 'http://ex.org/orders/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE round(o_totalprice / 600000, 3) > 0.5",
)
stored("op75_shared_variable", _annotated, "SELECT ?o ?w WHERE { ?o v:status 'F' . << ?o v:status ?s >> v:saidBy ?w }", "SELECT 'http://ex.org/orders/' || o_orderkey AS o, 'http://ex.org/customer/' || o_custkey AS w FROM orders WHERE o_orderstatus = 'F'")
stored("op76_annotation", _annotated, "SELECT (COUNT(*) AS ?n) WHERE { ?o v:status ?s {| v:saidBy ?w |} }", "SELECT count(*) AS n FROM orders")
stored("op77_triple_terms", _annotated, "SELECT (COUNT(DISTINCT ?t) AS ?n) WHERE { ?t v:confidence ?c FILTER(isTRIPLE(?t) && PREDICATE(?t) = v:status) }", "SELECT count(*) AS n FROM orders")

# ---- index cases, files, result formats, typing of results


_CASES = {"spo": "1", "sp": "1", "so": "1", "po": "(SELECT count(*) FROM nation WHERE n_regionkey = 3)", "s": "3", "p": "(SELECT count(*) FROM nation)", "o": "(SELECT count(*) FROM nation WHERE n_regionkey = 3)", "all": "(SELECT 3 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region)"}


@query("op02_index_cases", " UNION ALL ".join(f"SELECT '{k}' AS bound, ({n})::BIGINT AS n" for k, n in _CASES.items()))
def _index_cases(spark, d):
    """Every choice of bound subject, predicate and object."""
    source = QuadSource(_small(spark, d), one_graph=True)
    term = {"s": _S, "p": _P, "o": _O}
    out = []
    for case in _CASES:
        p = Pattern(*(term[k] if k in case and case != "all" else f"?{k}" for k in "spo"))
        found = source.scan(p, ("default", None)).df
        out.append(found.agg(F.lit(case).alias("bound"), F.count(F.lit(1)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Terms as text: IRIs without brackets, literals by their lexical form."""
    return df.select(*[V.native(V.Val(V.TERM, F.col(c))).alias(c) for c in columns])


@query("op17_ntriples", _NQ)
def _ntriples(spark, d):
    """Written as N-Triples and read back."""
    path = new_path(spark, "ntriples")
    rdf_files.write_ntriples(_small(spark, d).select("s", "p", "o"), path)
    return _plain(rdf_files.read_nquads(spark, path), "s", "p", "o")


@query("op18_nquads", "SELECT s, p, o, 'http://ex.org/g/nations' AS c FROM (" + _NQ + ") WHERE s LIKE '%nation/%' UNION ALL SELECT s, p, o, g FROM (" + _NQ + ") CROSS JOIN (VALUES ('http://ex.org/g/regions'), ('http://ex.org/g/copy'), ('urn-less:default')) AS x(g) WHERE s LIKE '%region/%'")
def _nquads(spark, d):
    path = new_path(spark, "nquads")
    rdf_files.write_nquads(_graphs(spark, d), path)
    return _plain(rdf_files.read_nquads(spark, path), "s", "p", "o", "c")


@query("op18_turtle", _NQ)
def _turtle(spark, d):
    """Written as Turtle and parsed again."""
    text = "".join(writers.graph_turtle(_small(spark, d)))
    return _plain(spark.createDataFrame(rdf_files.parse_turtle(text), "s string, p string, o string, c string"), "s", "p", "o")


def _written(name: str, sparql: str, writer, sql: str) -> None:
    """The lines of a written result."""

    @query(name, sql)
    def run(spark, d):
        result = Engine(QuadSource(_small(spark, d), one_graph=True), prefixes=PREFIXES).query(sparql)
        text = writer(result.native().first()[0]) if result.form == "ask" else writer(result.terms())
        return spark.createDataFrame([(line,) for line in "".join(text).splitlines()], "line string")


_NAMES = "SELECT ?r ?name WHERE { ?r v:r_name ?name } ORDER BY ?r"
_BY_KEY = "string_agg({0}, '{1}' ORDER BY r_regionkey) FROM region"
_written("op19_select_csv", _NAMES, writers.select_csv, "SELECT 'r,name' AS line UNION ALL SELECT 'http://ex.org/region/' || r_regionkey || ',' || r_name FROM region")
_written("op19_select_tsv", _NAMES, writers.select_tsv, "SELECT '?r' || chr(9) || '?name' AS line UNION ALL SELECT '<http://ex.org/region/' || r_regionkey || '>' || chr(9) || '\"' || r_name || '\"' FROM region")
_written(
    "op19_select_json", _NAMES, writers.select_json,
    "SELECT '{\"head\":{\"vars\":[\"r\", \"name\"]},\"results\":{\"bindings\":[' || (SELECT "
    + _BY_KEY.format("'{\"r\": {\"type\": \"uri\", \"value\": \"http://ex.org/region/' || r_regionkey || '\"}, \"name\": {\"type\": \"literal\", \"value\": \"' || r_name || '\"}}'", ",") + ") || ']}}' AS line",
)
_written(
    "op19_select_xml", _NAMES, writers.select_xml,
    "SELECT '<?xml version=\"1.0\"?>' AS line UNION ALL SELECT '<sparql xmlns=\"http://www.w3.org/2005/sparql-results#\"><head><variable name=\"r\"/><variable name=\"name\"/></head><results>' || (SELECT "
    + _BY_KEY.format("'<result><binding name=\"r\"><uri>http://ex.org/region/' || r_regionkey || '</uri></binding><binding name=\"name\"><literal>' || r_name || '</literal></binding></result>'", "") + ") || '</results></sparql>'",
)
_written("op20_ask_json", "ASK { ?r v:r_name 'ASIA' }", writers.ask_json, "SELECT '{\"head\": {}, \"boolean\": ' || (CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END) || '}' AS line FROM region WHERE r_name = 'ASIA'")
_written("op20_ask_xml", "ASK { ?r v:r_name 'NOWHERE' }", writers.ask_xml, "SELECT '<?xml version=\"1.0\"?>' AS line UNION ALL SELECT '<sparql xmlns=\"http://www.w3.org/2005/sparql-results#\"><head/><boolean>' || (CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END) || '</boolean></sparql>' FROM region WHERE r_name = 'NOWHERE'")
_COPY = "CONSTRUCT { ?r v:label ?name } WHERE { ?r v:r_name ?name }"
_LABEL = "'<http://ex.org/region/' || r_regionkey || '> <http://ex.org/v#label> \"' || r_name || '\" .'"
_written("op21_construct_ntriples", _COPY, writers.graph_ntriples, f"SELECT {_LABEL} AS line FROM region")
_written("op21_construct_turtle", _COPY, writers.graph_turtle, f"SELECT {_LABEL} AS line FROM region")
_written(
    "op21_construct_rdfxml", _COPY, writers.graph_rdfxml,
    "SELECT '<?xml version=\"1.0\"?>' AS line UNION ALL SELECT '<rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\">' UNION ALL SELECT '<rdf:Description rdf:about=\"http://ex.org/region/' || r_regionkey || '\"><n:label xmlns:n=\"http://ex.org/v#\">' || r_name || '</n:label></rdf:Description>' FROM region UNION ALL SELECT '</rdf:RDF>'",
)

_TYPED = "'\"' || {0} || '\"^^<http://www.w3.org/2001/XMLSchema#{1}>'"


@query("op54_result_types", "SELECT " + _TYPED.format("count(*)", "integer") + " AS n, " + _TYPED.format("sum(p_size)", "integer") + " AS total, '\"' || max(p_name) || '\"' AS last, " + _TYPED.format("CASE WHEN min(p_size) >= 1 THEN 'true' ELSE 'false' END", "boolean") + " AS positive FROM part")
def _result_types(spark, d):
    """Whole terms, with their datatypes."""
    return engine(spark, d).query("SELECT (COUNT(*) AS ?n) (SUM(?size) AS ?total) (MAX(?name) AS ?last) (MIN(?size) >= 1 AS ?positive) WHERE { ?p v:p_size ?size ; v:p_name ?name }").terms()


@query("op59_order_triple_terms", "SELECT '<< <http://ex.org/a> <http://ex.org/v#b> ' || t || ' >>' AS x FROM (VALUES ('\"c\"'), ('<< <http://ex.org/d> <http://ex.org/v#e> \"f\" >>')) AS v(t)")
def _order_triples(spark, d):
    """Triple terms come after all other terms."""
    q = "SELECT ?x WHERE { VALUES ?x { << :a v:b << :d v:e 'f' >> >> 'z' :z << :a v:b 'c' >> 5 } } ORDER BY ?x OFFSET 3"
    return Engine(QuadSource(_small(spark, d)), prefixes=PREFIXES).query(q).terms()


@query("op72_path_cap", "SELECT CASE WHEN count(*) * count(*) > 600 THEN 'stopped' ELSE 'whole' END AS outcome FROM nation")
def _path_cap(spark, d):
    """All pairs of the ring are more than the cap: an error, and no part of an answer."""
    try:
        Engine(QuadSource(ring(spark, d), one_graph=True), path_cap=600, prefixes=PREFIXES).query("SELECT ?x ?y WHERE { ?x v:next+ ?y }").native()
        outcome = "whole"
    except LimitExceeded:
        outcome = "stopped"
    return spark.createDataFrame([(outcome,)], "outcome string")


# ---- transactions and updates


def _loaded(spark: SparkSession, d: str, keep_stats: bool = False) -> Store:
    """A new store with nation and region in their graphs."""
    store = Store(spark, new_path(spark, "store"), keep_stats)
    tx = store.begin()
    tx.add_all(_graphs(spark, d))
    tx.commit()
    return store


def _by_graph(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.regexp_replace("c", "[<>]", "").alias("g")).agg(F.count("*").alias("n"))


_N3, _R2 = "(SELECT 3 * count(*) FROM nation)", "(SELECT 2 * count(*) FROM region)"
_G = "SELECT 'http://ex.org/g/{0}' AS g, {1} AS n"
_DEFAULT_N = f"SELECT 'urn-less:default' AS g, {_R2} AS n"
_UNION = " UNION ALL "


@query("op79_add_twice", _UNION.join([_G.format("nations", _N3), _G.format("regions", _R2), _G.format("copy", _R2), _DEFAULT_N]))
def _add_twice(spark, d):
    store = _loaded(spark, d)
    tx = store.begin()
    tx.add_all(_graphs(spark, d))
    tx.add_all(_graphs(spark, d))
    tx.commit()
    return _by_graph(store.quads())


@query("op80_delete", _UNION.join([_G.format("nations", "(SELECT 2 * count(*) FROM nation)"), _G.format("copy", "(SELECT count(*) FROM region)"), _DEFAULT_N]))
def _delete(spark, d):
    """A predicate in one graph, all of another graph, whose name goes with its last quad, and a quad that isn't there."""
    store = _loaded(spark, d)
    tx = store.begin()
    tx.remove(None, f"<{VOCAB}n_name>", None)
    tx.remove(None, None, None, (f"<{BASE}g/regions>",))
    tx.remove(None, f"<{VOCAB}r_name>", None, (f"<{BASE}g/copy>",))
    tx.remove(f"<{BASE}nobody>", f"<{VOCAB}n_name>", '"x"', (f"<{BASE}g/copy>",))
    tx.commit()
    return _by_graph(store.quads())


@query("op82_own_writes", f"SELECT 'before' AS seen, {_N3} AS n UNION ALL SELECT 'within', {_N3} + 1 UNION ALL SELECT 'outside', {_N3}")
def _own_writes(spark, d):
    store, g = _loaded(spark, d), f"<{BASE}g/nations>"
    tx = store.begin()
    rows = [("before", tx.size(g))]
    tx.add(_S, f"<{VOCAB}n_name>", '"another name"', g)
    rows += [("within", tx.size(g)), ("outside", store.size(g))]
    tx.rollback()
    return spark.createDataFrame(rows, "seen string, n long")


@query("op84_rollback_and_clear", f"SELECT 'after rollback' AS step, 3::BIGINT AS graphs, {_N3} + 3 * {_R2} AS n UNION ALL SELECT 'after clear', 2, {_N3} + 2 * {_R2}")
def _rollback(spark, d):
    store = _loaded(spark, d)
    tx = store.begin()
    tx.clear()
    tx.rollback()
    rows = [("after rollback", store.contexts().count(), store.size())]
    tx.clear(f"<{BASE}g/copy>")
    tx.commit()
    rows.append(("after clear", store.contexts().count(), store.size()))
    return spark.createDataFrame(rows, "step string, graphs long, n long")


@query("op85_update", "SELECT 'http://ex.org/nation/' || n_nationkey AS s, n_name AS name, CASE WHEN n_regionkey = 1 THEN 'label' ELSE 'n_name' END AS p, g FROM nation CROSS JOIN (VALUES ('http://ex.org/g/nations'), ('http://ex.org/g/more')) AS x(g) WHERE g LIKE '%nations' OR n_regionkey = 1")
def _update(spark, d):
    """DELETE/INSERT WHERE, INSERT with GRAPH, COPY and CLEAR in one request."""
    store = Store(spark, new_path(spark, "store"))
    tx = store.begin()
    tx.add_all(quads(spark, d, "nation", graph=f"<{BASE}g/nations>"))
    names = " ".join(f"PREFIX {k}: <{v}>" for k, v in PREFIXES.items())
    tx.update(
        names
        + " DELETE { GRAPH <http://ex.org/g/nations> { ?n v:n_name ?x } } INSERT { GRAPH <http://ex.org/g/nations> { ?n v:label ?x } } WHERE { ?n v:n_name ?x ; v:n_region <http://ex.org/region/1> } ;"
        + " INSERT { GRAPH <http://ex.org/g/temporary> { ?n v:label ?x } } WHERE { ?n v:label ?x } ;"
        + " COPY <http://ex.org/g/temporary> TO <http://ex.org/g/more> ; CLEAR GRAPH <http://ex.org/g/temporary>"
    )
    tx.commit()
    found = store.quads().where(F.col("p").isin(f"<{VOCAB}n_name>", f"<{VOCAB}label>"))
    return _plain(found, "s", "o", "p", "c").select("s", F.col("o").alias("name"), F.regexp_extract("p", "#(.*)$", 1).alias("p"), F.col("c").alias("g"))


@query("op86_remove_wildcards", _UNION.join([_G.format("nations", "(SELECT 3 * count(*) FROM nation WHERE n_regionkey <> 3) + (SELECT 2 * count(*) FROM nation WHERE n_regionkey = 3)"), _G.format("regions", "(SELECT 2 * count(*) - 1 FROM region)"), _G.format("copy", _R2), _DEFAULT_N]))
def _remove_wildcards(spark, d):
    store = _loaded(spark, d)
    tx = store.begin()
    tx.remove(None, None, _O)
    tx.remove(f"<{BASE}region/1>", f"<{VOCAB}r_name>", None, (f"<{BASE}g/regions>", f"<{BASE}g/nations>"))
    tx.commit()
    return _by_graph(store.quads())


@query("op88_kept_stats", "SELECT 'http://ex.org/v#n_region' AS p, count(*) AS n, count(*) AS subjects, count(DISTINCT n_regionkey) AS objects FROM nation UNION ALL SELECT 'http://ex.org/v#r_name', 3 * count(*) + 1, count(*) + 1, count(DISTINCT r_name) + 1 FROM region UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + 3 * count(*), (SELECT count(*) FROM nation) + count(*), 2 FROM region")
def _kept_stats(spark, d):
    """Statistics after two commits: the second adds a name and takes a predicate's last quads away."""
    store = _loaded(spark, d, keep_stats=True)
    tx = store.begin()
    tx.remove(None, f"<{VOCAB}n_name>", None)
    tx.add(f"<{BASE}region/new>", f"<{VOCAB}r_name>", '"NEW"')
    tx.commit()
    return store.stats().withColumn("p", F.regexp_extract("p", "^<(.*)>$", 1))


@query("op89_namespaces", "SELECT 'a' AS prefix, 'http://a2/' AS iri UNION ALL SELECT 'c', 'http://c/'")
def _namespaces(spark, d):
    store = Store(spark, new_path(spark, "store"))
    store.set_namespace("lost", "http://lost/")
    store.clear_namespaces()
    for prefix, iri in (("a", "http://a/"), ("b", "http://b/"), ("c", "http://c/"), ("a", "http://a2/")):
        store.set_namespace(prefix, iri)
    store.remove_namespace("b")
    return spark.createDataFrame(sorted(store.namespaces().items()), "prefix string, iri string")


# ---- updates and statistics


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    """A change log from events: views delete, errors clear the user's graph, the rest add."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_type") == "view", "del").when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "clear").otherwise("add")
    term = lambda kind, c: F.concat(F.lit(f"<{BASE}{kind}/"), c.cast("string"), F.lit(">"))
    clear = op == "clear"
    return e.select(
        op.alias("op"),
        F.when(~clear, term("user", F.col("user_id"))).alias("s"),
        F.when(~clear, F.lit(f"<{VOCAB}did>")).alias("p"),
        F.when(~clear, term("thing", F.col("event_id") % 7)).alias("o"),
        term("g", F.col("user_id") % 5).alias("c"),
        F.col("event_id").alias("tx_time"),
        F.lit(0).cast("long").alias("seq"),
    )


_LOG = "SELECT CASE WHEN event_type = 'view' THEN 'del' WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'clear' ELSE 'add' END AS op, user_id AS u, event_id % 7 AS t, user_id % 5 AS g, event_id AS tm FROM events"
_FOLD = f"WITH l AS ({_LOG}), x AS (SELECT u, t, g, max(tm) AS tm, arg_max(op, tm) AS op FROM l WHERE op <> 'clear' GROUP BY 1, 2, 3), k AS (SELECT g, max(tm) AS til FROM l WHERE op = 'clear' GROUP BY 1), live AS (SELECT x.* FROM x LEFT JOIN k USING (g) WHERE op = 'add' AND (til IS NULL OR tm > til))"


@query("op81_fold_with_clears", _FOLD + " SELECT 'http://ex.org/g/' || g AS g, count(*) AS n, max(tm) AS newest FROM live GROUP BY 1")
def _fold(spark, d):
    return oplog.fold(_event_log(spark, d)).groupBy(F.regexp_extract("c", "^<(.*)>$", 1).alias("g")).agg(F.count("*").alias("n"), F.max("tx_time").alias("newest"))


@query("op90_stream_ingest", _FOLD + " SELECT 'http://ex.org/g/' || g AS g, count(*) AS n, max(tm) AS newest FROM live GROUP BY 1")
def _stream_ingest(spark, d):
    """The change log as a stream of files, ingested in micro-batches."""
    source, store = new_path(spark, "changes"), Store(spark, new_path(spark, "store"))
    _event_log(spark, d).write.parquet(source)
    changes = spark.readStream.schema(oplog.LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    oplog.ingest(changes, store, new_path(spark, "progress")).awaitTermination()
    return store.quads().groupBy(F.regexp_extract("c", "^<(.*)>$", 1).alias("g")).agg(F.count("*").alias("n"), F.max("tx_time").alias("newest"))


@query("op83_commit_netting", f"WITH l AS ({_LOG}), x AS (SELECT u, t, g, max(tm) AS tm, arg_max(op, tm) AS op FROM l WHERE op <> 'clear' GROUP BY 1, 2, 3), k AS (SELECT g, max(tm) AS til FROM l WHERE op = 'clear' GROUP BY 1) SELECT op, count(*) AS n FROM (SELECT x.op FROM x LEFT JOIN k USING (g) WHERE til IS NULL OR tm > til UNION ALL SELECT 'clear' FROM k) GROUP BY 1")
def _net(spark, d):
    return oplog.net(_event_log(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@query("op87_predicate_stats", "SELECT 'http://ex.org/v#n_name' AS p, count(*) AS n, count(*) AS subjects, count(DISTINCT n_name) AS objects FROM nation UNION ALL SELECT 'http://ex.org/v#n_region', count(*), count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'http://ex.org/v#r_name', count(*), count(*), count(DISTINCT r_name) FROM region UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM nation) + count(*), (SELECT count(*) FROM nation) + count(*), 2 FROM region")
def _stats(spark, d):
    return oplog.predicate_stats(_small(spark, d)).withColumn("p", F.regexp_extract("p", "^<(.*)>$", 1))


@query("op87_global_stats", "SELECT (SELECT 3 * count(*) FROM nation) + 2 * count(*) AS triples, 4::BIGINT AS predicates, (SELECT count(*) FROM nation) + count(*) AS subjects FROM region")
def _global(spark, d):
    return oplog.global_stats(_small(spark, d))


@query("op85_construct", "SELECT 'http://ex.org/region/' || n_regionkey AS s, 'http://ex.org/v#has' AS p, n_name AS o FROM nation")
def _construct(spark, d):
    return engine(spark, d).query("CONSTRUCT { ?r v:has ?n } WHERE { ?x v:n_region ?r ; v:n_name ?n }").native()


@query("op85_describe", "SELECT 'http://ex.org/nation/5' AS s, p, o FROM (SELECT 'http://ex.org/v#n_name' AS p, n_name AS o, n_nationkey AS k FROM nation UNION ALL SELECT 'http://ex.org/v#n_region', 'http://ex.org/region/' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/v#Nation', n_nationkey FROM nation) WHERE k = 5")
def _describe(spark, d):
    return Engine(QuadSource(_small(spark, d), one_graph=True), prefixes=PREFIXES).query("DESCRIBE <http://ex.org/nation/5>").native()


# ---- expressions

mapped("ex02_equal", "SELECT ?p WHERE { ?x v:p_name ?p ; v:p_size ?s FILTER(?s = 7.0) }", "SELECT p_name AS p FROM part WHERE p_size = 7")
mapped("ex03_not_equal", "SELECT ?n WHERE { ?r v:r_name ?n FILTER(?n != 'ASIA') }", "SELECT r_name AS n FROM region WHERE r_name <> 'ASIA'")
mapped("ex04_compare_dates", 'SELECT ?o WHERE { ?o v:o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime && ?d < "1997-02-01T00:00:00"^^xsd:dateTime) }', "SELECT 'http://ex.org/orders/' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
mapped("ex05_three_valued", "SELECT ?d WHERE { ?d a v:Document OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q } FILTER(?q = 0 || !BOUND(?q)) }", "SELECT 'http://ex.org/documents/' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0 OR quality IS NULL")
mapped("ex06_arithmetic", "SELECT ?a ?b ?c WHERE { ?p v:p_size ?s ; v:p_retailprice ?r BIND(?s * 3 - 1 AS ?a) BIND(?r / 2 AS ?b) BIND(-?s AS ?c) }", "SELECT p_size::BIGINT * 3 - 1 AS a, p_retailprice / 2 AS b, -p_size::BIGINT AS c FROM part")
mapped("ex06_divide", "SELECT (COUNT(?z) AS ?none) (COUNT(?i) AS ?some) WHERE { ?p v:p_size ?s ; v:p_retailprice ?r BIND(?s / 0 AS ?z) BIND(?r / 0 AS ?i) }", "SELECT 0::BIGINT AS none, count(*) AS some FROM part")
mapped("ex07_str", "SELECT (STR(?n) AS ?s) (STR(?k) AS ?t) WHERE { ?n v:n_name 'NATION_3' . ?p v:p_size ?k FILTER(?k = 9) }", "SELECT 'http://ex.org/nation/3' AS s, '9' AS t FROM part WHERE p_size = 9")
mapped("ex08_lang", "SELECT (LANG(?n) AS ?l) WHERE { ?x v:r_name ?n }", "SELECT '' AS l FROM region")
mapped("ex09_datatype", "SELECT (STR(DATATYPE(?s)) AS ?a) (STR(DATATYPE(?r)) AS ?b) WHERE { ?p v:p_size ?s ; v:p_retailprice ?r }", "SELECT 'http://www.w3.org/2001/XMLSchema#integer' AS a, 'http://www.w3.org/2001/XMLSchema#double' AS b FROM part")
mapped("ex10_langmatches", "SELECT ?x ?m WHERE { VALUES ?x { 'a'@en 'b'@en-GB 'c'@fr } BIND(LANGMATCHES(LANG(?x), 'EN') AS ?m) }", "SELECT * FROM (VALUES ('a', true), ('b', true), ('c', false)) t(x, m)")
mapped("ex11_regex", "SELECT ?n WHERE { ?p v:p_type ?n FILTER(REGEX(?n, '^standard.*(tin|steel)$', 'i')) }", "SELECT p_type AS n FROM part WHERE regexp_matches(p_type, '(?i)^standard.*(tin|steel)$')")
mapped("ex12_same_term", "SELECT ?a ?b WHERE { ?a v:n_region ?r . ?b v:n_region ?r FILTER(SAMETERM(?a, ?b)) }", "SELECT 'http://ex.org/nation/' || n_nationkey AS a, 'http://ex.org/nation/' || n_nationkey AS b FROM nation")
mapped("ex13_in", "SELECT ?n ?o WHERE { ?r v:r_name ?n FILTER(?n IN ('ASIA', 'EUROPE')) BIND(?n NOT IN ('ASIA') AS ?o) }", "SELECT r_name AS n, r_name <> 'ASIA' AS o FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
mapped("ex14_in_subquery", "SELECT ?n WHERE { ?x v:n_name ?n ; v:n_region ?r FILTER(?r IN ({ SELECT ?y WHERE { ?y v:r_name 'AFRICA' } })) }", "SELECT n_name AS n FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA')")
mapped("ex15_coalesce", "SELECT ?d (COALESCE(?q, -1) AS ?v) WHERE { ?d a v:Document OPTIONAL { ?l v:labels_document ?d ; v:labels_quality ?q } }", "SELECT 'http://ex.org/documents/' || d.doc_id AS d, coalesce(quality, -1)::BIGINT AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
mapped("ex17_if", "SELECT ?n (IF(?b > 0, 'plus', 'minus') AS ?s) WHERE { ?c v:c_name ?n ; v:c_acctbal ?b }", "SELECT c_name AS n, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s FROM customer")
mapped("ex18_kinds", "SELECT (ISIRI(?x) AS ?a) (ISLITERAL(?n) AS ?b) (ISNUMERIC(?n) AS ?c) (ISBLANK(?x) AS ?d) WHERE { ?x v:r_name ?n }", "SELECT true AS a, true AS b, false AS c, false AS d FROM region")
stored("ex19_is_triple", _annotated, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER(ISTRIPLE(?s)) }", "SELECT 2 * count(*) AS n FROM orders")
stored("ex20_parts", _annotated, "SELECT (STR(SUBJECT(?t)) AS ?s) (OBJECT(?t) AS ?o) WHERE { ?t v:saidBy ?w }", "SELECT 'http://ex.org/orders/' || o_orderkey AS s, o_orderstatus AS o FROM orders")
mapped("ex21_triple", "SELECT (STR(OBJECT(TRIPLE(?x, v:r_name, ?n))) AS ?o) WHERE { ?x v:r_name ?n }", "SELECT r_name AS o FROM region")
mapped("ex22_ebv", "SELECT ?a ?b WHERE { ?p v:p_size ?s ; v:p_brand ?t BIND(!?s AS ?a) BIND(?t && true AS ?b) }", "SELECT p_size = 0 AS a, p_brand <> '' AS b FROM part")

# ---- function library

mapped("fn_strings", "SELECT (STRLEN(?n) AS ?a) (SUBSTR(?n, 3, 4) AS ?b) (UCASE(?n) AS ?c) (LCASE(?n) AS ?d) (CONCAT(?n, '-', ?n) AS ?e) WHERE { ?p v:p_name ?n }", "SELECT length(p_name) AS a, substr(p_name, 3, 4) AS b, upper(p_name) AS c, lower(p_name) AS d, p_name || '-' || p_name AS e FROM part")
mapped("fn_tests", "SELECT (STRSTARTS(?n, 'S') AS ?a) (STRENDS(?n, 'L') AS ?b) (CONTAINS(?n, 'AN') AS ?c) WHERE { ?p v:p_type ?n }", "SELECT starts_with(p_type, 'S') AS a, suffix(p_type, 'L') AS b, contains(p_type, 'AN') AS c FROM part")
mapped("fn_before_after", "SELECT (STRBEFORE(?n, ' ') AS ?a) (STRAFTER(?n, ' ') AS ?b) (STRBEFORE(?n, '~') AS ?c) WHERE { ?p v:p_type ?n }", "SELECT CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, 1, strpos(p_type, ' ') - 1) ELSE '' END AS a, CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS b, '' AS c FROM part")
mapped("fn_replace", "SELECT (REPLACE(?n, '[AEIOU]', '*') AS ?a) WHERE { ?p v:p_type ?n }", "SELECT regexp_replace(p_type, '[AEIOU]', '*', 'g') AS a FROM part")
mapped("fn_encode", "SELECT (ENCODE_FOR_URI(?n) AS ?a) WHERE { ?p v:p_type ?n }", "SELECT replace(p_type, ' ', '%20') AS a FROM part")
mapped("fn_numbers", "SELECT (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) WHERE { ?x v:c_acctbal ?b }", "SELECT abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer")
mapped("fn_dates", "SELECT (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?k) (HOURS(?d) AS ?h) WHERE { ?o v:o_orderdate ?d }", "SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS k, hour(o_orderdate)::BIGINT AS h FROM orders")
mapped("fn_hashes", "SELECT (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x v:n_name ?n }", "SELECT md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
mapped("fn_casts", "SELECT (xsd:integer(?s) AS ?a) (xsd:string(?z) AS ?b) (xsd:double(?z) AS ?c) WHERE { ?p v:p_size ?z BIND(STR(?z) AS ?s) }", "SELECT p_size::BIGINT AS a, p_size::VARCHAR AS b, p_size::DOUBLE AS c FROM part")
mapped("fn_iri", "SELECT (STR(IRI(CONCAT('http://ex.org/', ?n))) AS ?a) (STR(STRDT(?n, xsd:token)) AS ?b) (LANG(STRLANG(?n, 'en')) AS ?c) WHERE { ?x v:r_name ?n }", "SELECT 'http://ex.org/' || r_name AS a, r_name AS b, 'en' AS c FROM region")

# ---- catalogue-style queries on the star schema

mapped("bsbm_q1", "SELECT DISTINCT ?n WHERE { ?p v:p_name ?n ; v:p_brand 'Brand#11' ; v:p_size ?s FILTER(?s > 20) } ORDER BY ?n LIMIT 10", "SELECT DISTINCT p_name AS n FROM part WHERE p_brand = 'Brand#11' AND p_size > 20 ORDER BY 1 LIMIT 10")
mapped("bsbm_q2", "SELECT ?n ?b ?t ?z ?r WHERE { <http://ex.org/part/17> v:p_name ?n ; v:p_brand ?b ; v:p_type ?t ; v:p_size ?z ; v:p_retailprice ?r }", "SELECT p_name AS n, p_brand AS b, p_type AS t, p_size::BIGINT AS z, p_retailprice AS r FROM part WHERE p_partkey = 17")
mapped("bsbm_q3", "SELECT ?p ?s WHERE { ?p v:p_size ?s ; v:p_brand 'Brand#11' FILTER(?s > 30) OPTIONAL { ?p v:p_type ?x FILTER(CONTAINS(?x, 'TIN')) } FILTER(!BOUND(?x)) }", "SELECT 'http://ex.org/part/' || p_partkey AS p, p_size::BIGINT AS s FROM part WHERE p_brand = 'Brand#11' AND p_size > 30 AND NOT contains(p_type, 'TIN')")
mapped("bsbm_q4", "SELECT DISTINCT ?p WHERE { { ?p v:p_brand 'Brand#11' ; v:p_size ?s FILTER(?s > 40) } UNION { ?p v:p_brand 'Brand#12' ; v:p_size ?s FILTER(?s < 10) } }", "SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE p_brand = 'Brand#11' AND p_size > 40 OR p_brand = 'Brand#12' AND p_size < 10")
mapped("bsbm_q5", "SELECT DISTINCT ?q WHERE { <http://ex.org/part/17> v:p_size ?s ; v:p_retailprice ?r . ?q v:p_size ?t ; v:p_retailprice ?u FILTER(?t < ?s + 5 && ?t > ?s - 5 && ?u < ?r + 50 && ?u > ?r - 50 && ?q != <http://ex.org/part/17>) }", "SELECT 'http://ex.org/part/' || b.p_partkey AS q FROM part a, part b WHERE a.p_partkey = 17 AND b.p_size < a.p_size + 5 AND b.p_size > a.p_size - 5 AND b.p_retailprice < a.p_retailprice + 50 AND b.p_retailprice > a.p_retailprice - 50 AND b.p_partkey <> 17")
mapped("bsbm_q7", "SELECT ?n ?price ?sn WHERE { ?p v:p_brand 'Brand#11' ; v:p_name ?n OPTIONAL { ?l v:l_part ?p ; v:l_extendedprice ?price ; v:l_supplier ?s . ?s v:s_nation ?x ; v:s_name ?sn . ?x v:n_name 'NATION_3' } }", "SELECT p_name AS n, price, sn FROM part LEFT JOIN (SELECT l_partkey, l_extendedprice AS price, s_name AS sn FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3') ON l_partkey = p_partkey WHERE p_brand = 'Brand#11'")
mapped("bsbm_q8", "SELECT ?d ?q ?t WHERE { ?l v:labels_document ?x ; v:labels_quality ?q . ?x v:documents_lang 'en' ; v:documents_n_chars ?d OPTIONAL { ?l v:labels_toxic ?t FILTER(?t > 0) } }", "SELECT n_chars AS d, quality::BIGINT AS q, CASE WHEN toxic > 0 THEN toxic END::BIGINT AS t FROM labels JOIN documents USING (doc_id) WHERE lang = 'en'")
mapped("bsbm_q10", 'SELECT DISTINCT ?o ?p WHERE { ?l v:l_order ?o ; v:l_extendedprice ?p ; v:l_shipdate ?d ; v:l_supplier ?s . ?s v:s_nation ?n . ?n v:n_region ?r . ?r v:r_name \'EUROPE\' FILTER(?d > "1998-01-01T00:00:00"^^xsd:dateTime && ?p > 50000) }', "SELECT DISTINCT 'http://ex.org/orders/' || l_orderkey AS o, l_extendedprice AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND l_shipdate > TIMESTAMP '1998-01-01' AND l_extendedprice > 50000")
mapped("bsbm_q11", "SELECT ?p ?o WHERE { <http://ex.org/orders/5> ?p ?o FILTER(?p != v:o_orderdate && ?p != v:o_totalprice) }", "SELECT p, o FROM (SELECT o_orderkey AS k, 'http://ex.org/v#o_orderstatus' AS p, o_orderstatus AS o FROM orders UNION ALL SELECT o_orderkey, 'http://ex.org/v#o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'http://ex.org/v#o_customer', 'http://ex.org/customer/' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/v#Order' FROM orders) WHERE k = 5")
mapped("bsbm_qj1", "SELECT ?pn ?sn ?p WHERE { ?l v:l_part ?x ; v:l_supplier ?s ; v:l_extendedprice ?p . ?x v:p_name ?pn ; v:p_brand 'Brand#22' . ?s v:s_name ?sn }", "SELECT p_name AS pn, s_name AS sn, l_extendedprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand = 'Brand#22'")
QUERIES["bsbm_qj2"] = lambda spark, d: _rounded(engine(spark, d).query("SELECT ?n (SUM(?p * (1 - ?d)) AS ?rev) WHERE { ?l v:l_order ?o ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_supplier ?s . ?o v:o_customer ?c . ?c v:c_nation ?x . ?s v:s_nation ?x . ?x v:n_name ?n ; v:n_region ?r . ?r v:r_name 'ASIA' } GROUP BY ?n").native(), "rev")
ORACLES["bsbm_qj2"] = "SELECT n_name AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"
mapped("bsbm_qj3", "SELECT ?c (COUNT(?o) AS ?n) (MAX(?p) AS ?hi) WHERE { ?c v:c_mktsegment 'BUILDING' . ?o v:o_customer ?c ; v:o_totalprice ?p } GROUP BY ?c", "SELECT 'http://ex.org/customer/' || c_custkey AS c, count(*) AS n, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
mapped("bsbm_qj4", "SELECT ?b (COUNT(DISTINCT ?c) AS ?n) WHERE { ?l v:l_part ?x ; v:l_order ?o . ?x v:p_brand ?b . ?o v:o_customer ?c } GROUP BY ?b", "SELECT p_brand AS b, count(DISTINCT o_custkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
