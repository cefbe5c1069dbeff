"""Transactions, updates, streams, files, formats and the endpoint."""

import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from quadloom import terms as T
from quadloom.engine import Engine
from quadloom.errors import PartialCommit
from quadloom.server import Endpoint, serve
from quadloom.sources import rdf_files, writers
from quadloom.sources.quads import QUAD_SCHEMA, QuadSource
from quadloom.store import Store
from quadloom.streaming import oplog

A, B, P, G, G2 = "<http://e/a>", "<http://e/b>", "<http://e/p>", "<http://e/g>", "<http://e/g2>"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def quads(df):
    return {(r.s, r.o, r.c) for r in df.collect()}


def test_transactions(store):
    tx = store.begin()
    tx.add(A, P, '"1"')
    tx.add(A, P, '"1"')
    tx.add(A, P, '"2"', G)
    assert quads(tx.quads()) == {(A, '"1"', T.DEFAULT_GRAPH), (A, '"2"', G)}
    assert store.size() == 0
    tx.commit()
    assert store.size() == 2 and store.size(G) == 1
    tx.remove(A, P, '"2"', (G,))
    tx.add(A, P, '"3"', G2)
    assert {r.c for r in tx.contexts().collect()} == {G2}
    tx.rollback()
    assert store.size() == 2
    tx.clear(G)
    tx.add(B, P, '"4"', G)
    tx.commit()
    assert quads(store.statements(contexts=(G,))) == {(B, '"4"', G)}
    tx.add(B, P, '"5"', G)
    tx.clear(G)
    tx.commit()
    assert store.size(G) == 0
    tx.remove(None, P, None)
    tx.commit()
    assert store.size() == 0


def test_the_later_commit_wins(store):
    first, second = store.begin(), store.begin()
    first.remove(A, P, '"1"', (G,))
    second.add(A, P, '"1"', G)
    second.commit()
    first.commit()
    assert store.size() == 0


def test_kept_statistics(spark, tmp_path):
    store = Store(spark, str(tmp_path / "counted"), keep_stats=True)
    store.update("INSERT DATA { <http://e/a> <http://e/p> 1, 2 . <http://e/a> <http://e/q> 1 }")
    store.update("DELETE DATA { <http://e/a> <http://e/q> 1 } ; INSERT DATA { <http://e/b> <http://e/p> 2 }")
    assert [tuple(r) for r in store.stats().collect()] == [(P, 3, 2, 2)]
    store.update("DROP ALL")
    assert store.stats().count() == 0


def test_bad_quads(store):
    literal = store.spark.createDataFrame([('"lit"', P, A, G)], QUAD_SCHEMA)
    tx = store.begin()
    tx.add_all(literal)
    with pytest.raises(PartialCommit):
        tx.commit()
    for bad in (('"lit"', P, A, G), (A, '"p"', A, G), (A, P, A, "<< <a> <b> <c> >>")):
        with pytest.raises(ValueError):
            store.begin().add(*bad)


def test_updates(store):
    store.set_namespace("e", "http://e/")
    store.update("INSERT DATA { e:a e:p 1 . GRAPH e:g { e:a e:p 2 . e:b e:p 3 } }")
    store.update("DELETE { ?s e:p ?o } INSERT { ?s e:q ?o } WHERE { ?s e:p ?o FILTER(?o > 2) }")
    assert sorted(r.o for r in store.query("SELECT ?o { ?s e:p ?o }").native().collect()) == ["1", "2"]
    assert [r.o for r in store.query("SELECT ?o { ?s e:q ?o }").native().collect()] == ["3"]
    store.update("COPY e:g TO e:h ; DELETE WHERE { e:a e:p ?o } ; CLEAR GRAPH e:g")
    assert {r.c for r in store.contexts().collect()} == set()
    store.update("INSERT DATA { << e:a e:p 1 >> e:says e:b }")
    assert store.query("ASK { << ?x e:p ?y >> e:says e:b }").native().first()[0]
    store.update("DROP ALL")
    assert store.size() == 0
    store.remove_namespace("e")
    assert store.namespaces() == {}


def test_fold_against_a_replay(spark):
    import random

    rng = random.Random(5)
    log = []
    for t in range(400):
        op = rng.choice(["add"] * 6 + ["del"] * 3 + ["clear"])
        g = rng.choice(["g1", "g2", "g3"])
        log.append((op, None, None, None, None if rng.random() < 0.1 else g, t, 0) if op == "clear" else (op, rng.choice("abc"), "p", rng.choice("xyz"), g, t, 0))
    live = set()
    for op, s, p, o, c, *_ in log:
        if op == "clear":
            live = {q for q in live if c is not None and q[3] != c}
        elif op == "add":
            live.add((s, p, o, c))
        else:
            live.discard((s, p, o, c))
    df = spark.createDataFrame(log, oplog.LOG_SCHEMA)
    assert {tuple(r)[:4] for r in oplog.fold(df).collect()} == live
    assert {tuple(r)[:4] for r in oplog.fold(oplog.net(df)).collect()} == live
    stats = oplog.predicate_stats(oplog.fold(df))
    assert stats.first().n == len(live)
    some = df.where("tx_time < 300")
    kept = oplog.refresh_stats(oplog.predicate_stats(oplog.fold(some)), oplog.fold(df), df.where("tx_time >= 300"))
    assert kept.collect() == stats.collect()


def test_stream_ingest(spark, store, tmp_path):
    src = str(tmp_path / "in")
    rows = [("add", A, P, f'"{k}"', G, k, 0) for k in range(5)] + [("del", A, P, '"0"', G, 9, 0)]
    spark.createDataFrame(rows, oplog.LOG_SCHEMA).write.parquet(src)
    oplog.ingest(spark.readStream.schema(oplog.LOG_SCHEMA).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    assert store.size() == 4
    compacted = store.compact(str(tmp_path / "small"))
    assert compacted.size() == 4 and compacted.log().count() == 4


def test_files(spark, tmp_path):
    text = '<http://e/a> <http://e/p> "01"^^<http://www.w3.org/2001/XMLSchema#integer> .\n# no\n\nbroken line\n<http://e/a> <http://e/p> "q\\"x"@en <http://e/g> .\n<< <http://e/a> <http://e/p> <http://e/b> >> <http://e/c> "1.50"^^<http://www.w3.org/2001/XMLSchema#decimal> . # end\n'
    (tmp_path / "f.nq").write_text(text)
    df = rdf_files.read_nquads(spark, str(tmp_path / "f.nq"))
    got = {(r.s, r.o, r.c) for r in df.collect()}
    x = T.XSD
    assert got == {(A, f'"1"^^<{x}integer>', T.DEFAULT_GRAPH), (A, '"q\\"x"@en', G), ("<< <http://e/a> <http://e/p> <http://e/b> >>", f'"1.5"^^<{x}decimal>', T.DEFAULT_GRAPH)}
    rdf_files.write_nquads(df, str(tmp_path / "out"))
    assert {(r.s, r.o, r.c) for r in rdf_files.read_nquads(spark, str(tmp_path / "out")).collect()} == got


def test_result_formats(spark):
    e = Engine(QuadSource(spark.createDataFrame([(A, P, '"x,\\"y"@en', T.DEFAULT_GRAPH), (A, P, B, T.DEFAULT_GRAPH)], QUAD_SCHEMA)))
    df = e.query("SELECT ?o ?u { ?s ?p ?o } ORDER BY ?o").terms()
    got = json.loads("".join(writers.select_json(df)))
    assert got["results"]["bindings"] == [{"o": {"type": "uri", "value": "http://e/b"}}, {"o": {"type": "literal", "value": 'x,"y', "xml:lang": "en"}}]
    assert "".join(writers.select_csv(df)).splitlines() == ["o,u", "http://e/b,", '"x,""y",']
    assert "<uri>http://e/b</uri>" in "".join(writers.select_xml(df))
    assert "".join(writers.select_tsv(df)).splitlines()[1] == f"{B}\t"
    triples = e.query("CONSTRUCT WHERE { ?s ?p ?o }").terms()
    assert sorted("".join(writers.graph_ntriples(triples)).splitlines())[0].startswith(A)
    assert "".join(writers.graph_turtle(triples)).count(";") == 1
    assert 'rdf:resource="http://e/b"' in "".join(writers.graph_rdfxml(triples))


def test_negotiation():
    offered = list(writers.SELECT)
    assert writers.negotiate(None, offered) == offered[0]
    assert writers.negotiate("text/csv;q=0.5, application/sparql-results+xml", offered) == "application/sparql-results+xml"
    assert writers.negotiate("text/*;q=0.3, */*;q=0.1", offered) == "text/csv"
    assert writers.negotiate("image/png", offered) is None


def test_endpoint(store):
    server = serve(Endpoint(None, store, allow_updates=True, auth_token="key", cors_origin="*"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, data=None, method=None, **headers):
        r = urllib.request.Request(base + path, data=data.encode() if data is not None else None, method=method, headers={k.replace("_", "-"): v for k, v in headers.items()})
        try:
            with urllib.request.urlopen(r) as x:
                return x.status, x.read().decode()
        except urllib.error.HTTPError as err:
            return err.code, err.read().decode()

    try:
        update = "INSERT DATA { <http://e/a> <http://e/p> 1 }"
        assert call("/update", update, Content_Type="application/sparql-update")[0] == 401
        assert call("/update", update, Content_Type="application/sparql-update", Authorization="Bearer key")[0] == 204
        status, body = call("/sparql?query=" + urllib.parse.quote("SELECT ?o { ?s ?p ?o }"), Accept="text/csv")
        assert (status, body.split()) == (200, ["o", "1"])
        assert json.loads(call("/sparql", "query=" + urllib.parse.quote("ASK {}"), Content_Type="application/x-www-form-urlencoded")[1])["boolean"] is True
        assert call("/sparql?query=SELEC")[0] == 400
        assert call("/sparql")[0] == 400
        assert call("/nothing")[0] == 404
        assert call("/health")[0] == 200
        assert call("/sparql", method="OPTIONS")[0] == 204
        assert "query_seconds_count" in call("/metrics")[1]
    finally:
        server.shutdown()
