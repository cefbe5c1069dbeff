"""A quad store over a Parquet change log: transactions that read their own writes, SPARQL updates, statistics, namespaces."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as T
from .engine import Engine, Result, instantiate
from .errors import PartialCommit, UnsupportedError
from .metrics import METRICS
from .plans import algebra as A
from .plans.parser import parse_update
from .runtime import cut
from .sources.quads import QuadSource
from .streaming import oplog


def check_quad(s: str, p: str, o: str, c: str) -> None:
    """Subjects are no literals, predicates IRIs, graphs no triple terms."""
    if T.is_triple(c) or c.startswith('"'):
        raise ValueError(f"not a graph name: {c}")
    if s.startswith('"') or not p.startswith("<") or T.is_triple(p):
        raise ValueError(f"not a triple: {s} {p} {o}")


class Store:
    """Commits append to the log in one Spark write, so other readers see all of a commit or nothing.

    With ``keep_stats`` each commit also counts the predicates it touched anew (all of them after a clear), which reads their
    quads; without it statistics are counted when asked for.
    """

    def __init__(self, spark: SparkSession, path: str, keep_stats: bool = False):
        self.spark, self.path, self.keep_stats = spark, path.rstrip("/"), keep_stats

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(oplog.LOG_SCHEMA).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], oplog.LOG_SCHEMA)

    def append(self, ops: DataFrame) -> None:
        ops.selectExpr(*(x.split()[0] for x in oplog.LOG_SCHEMA.split(", "))).write.mode("append").parquet(f"{self.path}/log")

    def quads(self) -> DataFrame:
        return oplog.fold(self.log())

    def compact(self, target: str) -> Store:
        """Write the visible quads as the log of a new store, in ranges of predicate and subject, so that no predicate is one task."""
        adds = self.quads().select(F.lit("add").alias("op"), "s", "p", "o", "c", "tx_time", F.lit(0).cast("long").alias("seq"))
        adds.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(f"{target.rstrip('/')}/log")
        return Store(self.spark, target)

    def begin(self) -> Transaction:
        return Transaction(self)

    def engine(self) -> Engine:
        return Engine(QuadSource(self.quads()), prefixes=self.namespaces())

    def query(self, text: str, bindings: dict[str, str] | None = None) -> Result:
        return self.engine().query(text, bindings)

    def update(self, text: str) -> None:
        """Run a sequence of updates as one transaction."""
        tx = self.begin()
        tx.update(text)
        tx.commit()

    # -- reading statements

    def statements(self, s: str | None = None, p: str | None = None, o: str | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
        return find(self.quads(), s, p, o, contexts)

    def size(self, *contexts: str) -> int:
        return find(self.quads(), None, None, None, contexts).count()

    def contexts(self) -> DataFrame:
        return self.quads().where(F.col("c") != T.DEFAULT_GRAPH).select("c").distinct()

    def types(self) -> DataFrame:
        """(type, s): the class view, each pair once."""
        return type_view(self.quads())

    # -- statistics: a version for each commit, the newest counts

    def stats(self) -> DataFrame:
        """(p, n, subjects, objects), as of the last commit where statistics are kept."""
        kept = self._kept_stats()
        return oplog.predicate_stats(self.quads()) if kept is None else kept

    def _kept_stats(self) -> DataFrame | None:
        try:
            versions = self.spark.read.parquet(f"{self.path}/stats")
        except AnalysisException:
            return None
        newest = versions.agg(F.max("version")).first()[0]
        return versions.where(F.col("version") == newest).where("p is not null").drop("version")

    def _count_again(self, ops: DataFrame, version: int) -> None:
        old = self._kept_stats()
        if old is None or not ops.where("op = 'clear'").isEmpty():
            new = oplog.predicate_stats(self.quads())
        else:
            new = oplog.refresh_stats(old, self.quads(), ops)
        stamp = F.lit(version).cast("long").alias("version")
        mark = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields])  # a version without quads is one too
        new.unionByName(mark).select("*", stamp).write.mode("append").parquet(f"{self.path}/stats")

    # -- namespaces: a small log of its own, the last word on a prefix counts

    def _names(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/namespaces")
        except AnalysisException:
            return None

    def namespaces(self) -> dict[str, str]:
        found = self._names()
        if found is None:
            return {}
        cleared = found.where("prefix is null").agg(F.max("at")).first()[0] or -1
        last = found.where(F.col("prefix").isNotNull() & (F.col("at") > cleared)).groupBy("prefix").agg(F.max_by("iri", "at").alias("iri"))
        return {r["prefix"]: r["iri"] for r in last.collect() if r["iri"] is not None}

    def _name(self, prefix: str | None, iri: str | None) -> None:
        row = [(prefix, iri, time.time_ns())]
        self.spark.createDataFrame(row, "prefix string, iri string, at long").write.mode("append").parquet(f"{self.path}/namespaces")

    def set_namespace(self, prefix: str, iri: str) -> None:
        self._name(prefix, iri)

    def remove_namespace(self, prefix: str) -> None:
        self._name(prefix, None)

    def clear_namespaces(self) -> None:
        self._name(None, None)


def find(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, contexts: tuple[str, ...] = ()) -> DataFrame:
    """Quads that match what is given; None matches everything."""
    condition: list[Column] = [F.col(k) == v for k, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    if contexts:
        condition.append(F.col("c").isin(*set(contexts)))
    return reduce(lambda df, c: df.where(c), condition, quads)


def type_view(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == T.RDF_TYPE).select(F.col("o").alias("type"), "s").distinct()


def batch_lookup(quads: DataFrame, subjects: DataFrame, p: str, c: str | None = None) -> DataFrame:
    """(s, o) of one predicate for the subjects of a DataFrame; Spark broadcasts them if they are few."""
    return find(quads, None, p, None, (c,) if c else ()).join(subjects.select("s").distinct(), "s", "left_semi").select("s", "o")


class Transaction:
    """Operations are held back until commit; queries within see them."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.pending: list[DataFrame] = []
        self.rows: list[tuple] = []
        self.seq = 0

    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def add(self, s: str, p: str, o: str, c: str = T.DEFAULT_GRAPH) -> None:
        check_quad(s, p, o, c)
        self.rows.append(("add", s, p, o, c, 0, self._next()))

    def add_all(self, quads: DataFrame) -> None:
        """Add a DataFrame of quads; those that are no quads stop the transaction's write, not this call."""
        ok = ~T.is_literal(F.col("s")) & T.is_iri_col(F.col("p")) & ~T.is_triple_col(F.col("c")) & ~T.is_literal(F.col("c"))
        bad = F.raise_error(F.concat_ws(" ", F.lit("not a quad:"), "s", "p", "o", "c"))
        self._frame("add", quads.select(F.when(ok, F.col("s")).otherwise(bad.cast("string")).alias("s"), "p", "o", "c"))

    def remove(self, s: str | None, p: str | None, o: str | None, contexts: tuple[str, ...] = ()) -> None:
        """Remove every quad, committed or pending, that matches."""
        if s and p and o and contexts:
            self.rows += [("del", s, p, o, c, 0, self._next()) for c in contexts]
        else:
            self._frame("del", cut(find(self.quads(), s, p, o, contexts).select("s", "p", "o", "c")))

    def clear(self, *contexts: str) -> None:
        self.rows += [("clear", None, None, None, c, 0, self._next()) for c in contexts or (None,)]

    def _frame(self, op: str, quads: DataFrame) -> None:
        n = self._next()
        self.pending.append(quads.select(F.lit(op).alias("op"), "s", "p", "o", "c", F.lit(0).cast("long").alias("tx_time"), F.lit(n).cast("long").alias("seq")))

    def ops(self) -> DataFrame | None:
        """The pending operations at the time of asking, so that a commit comes after all that were made before it."""
        parts = list(self.pending)
        if self.rows:
            parts.append(self.spark.createDataFrame(self.rows, oplog.LOG_SCHEMA))
        return reduce(lambda a, b: a.unionByName(b), parts).withColumn("tx_time", F.lit(time.time_ns())) if parts else None

    def quads(self) -> DataFrame:
        ops = self.ops()
        log = self.store.log()
        return oplog.fold(log if ops is None else log.unionByName(ops))

    def query(self, text: str, bindings: dict[str, str] | None = None) -> Result:
        return Engine(QuadSource(self.quads()), prefixes=self.store.namespaces()).query(text, bindings)

    def size(self, *contexts: str) -> int:
        return find(self.quads(), None, None, None, contexts).count()

    def contexts(self) -> DataFrame:
        return self.quads().where(F.col("c") != T.DEFAULT_GRAPH).select("c").distinct()

    def update(self, text: str) -> None:
        for u in parse_update(text, prefixes=self.store.namespaces()):
            self._apply(u)

    def _apply(self, u: A.Update) -> None:
        graph = lambda g: T.DEFAULT_GRAPH if g in (None, "default") else g
        match u.kind:
            case "insert_data":
                for s, p, o, g in u.insert:
                    self.add(*(ground(x) for x in (s, p, o)), graph(g))
            case "delete_data":
                for s, p, o, g in u.delete:
                    self.remove(*(ground(x) for x in (s, p, o)), (graph(g),))
            case "modify":
                rel = Engine(QuadSource(self.quads())).compiler().run(u.where)
                rel = type(rel)(cut(rel.df), rel.kinds, rel.certain)  # deletes and inserts see the same solutions
                if u.delete:
                    self._delete(instantiate(rel, u.delete), u.delete)
                if u.insert:
                    self._frame("add", cut(instantiate(rel, u.insert).distinct()))
            case "clear":
                names = {"all": [None], "named": [r["c"] for r in self.contexts().toLocalIterator()]}.get(u.target, [graph(u.target)])
                self.rows += [("clear", None, None, None, c, 0, self._next()) for c in names]
            case "copy" | "move" | "add":
                a, b = graph(u.source), graph(u.target)
                if a == b:
                    return
                moved = cut(find(self.quads(), contexts=(a,)).select("s", "p", "o", F.lit(b).alias("c")))
                if u.kind != "add":
                    self.clear(b)
                self._frame("add", moved)
                if u.kind == "move":
                    self.clear(a)
            case _:
                raise UnsupportedError(f"update {u.kind}")

    def _delete(self, quads: DataFrame, template: tuple) -> None:
        """A template without a graph deletes from every graph, as the union of graphs is what WHERE sees."""
        if any(g is None for *_, g in template):
            named = quads.where(F.col("c") != T.DEFAULT_GRAPH)
            anywhere = quads.where(F.col("c") == T.DEFAULT_GRAPH).drop("c").join(self.quads().select("s", "p", "o", "c"), ["s", "p", "o"])
            quads = named.unionByName(anywhere)
        self._frame("del", cut(quads.distinct()))

    def commit(self) -> None:
        ops = self.ops()
        if ops is None:
            return
        try:
            ops = cut(oplog.net(ops)) if self.store.keep_stats else oplog.net(ops)
            self.store.append(ops)
        except Exception as e:
            METRICS.transaction("failed")
            raise PartialCommit(0, self.seq, e) from e
        METRICS.transaction("committed")
        if self.store.keep_stats:
            self.store._count_again(ops, time.time_ns())
        self._reset()

    def rollback(self) -> None:
        METRICS.transaction("rolled_back")
        self._reset()

    def _reset(self) -> None:
        self.pending, self.rows = [], []


def ground(t) -> str:
    return T.triple_term(ground(t.s), ground(t.p), ground(t.o)) if isinstance(t, A.TripleTerm) else t
