"""The engine: query text in, DataFrames out."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import terms as T
from .errors import QueryTimeout
from .functions import values as V
from .metrics import METRICS
from .operators import joins
from .operators.compiler import Compiler
from .plans import algebra as A
from .plans.parser import parse_query
from .relation import Rel


@dataclass
class Result:
    """Lazy: nothing runs before an action on one of its DataFrames."""

    form: str
    rel: Rel

    @property
    def vars(self) -> list[str]:
        return self.rel.vars

    def native(self) -> DataFrame:
        """Native columns: numbers, texts, booleans, timestamps, whole IRIs as text."""
        return self.rel.df.select(*[V.native(self.rel.val(v)).alias(v) for v in self.vars])

    def terms(self) -> DataFrame:
        """Canonical term strings."""
        return self.rel.df.select(*[V.term(self.rel.val(v)).alias(v) for v in self.vars])


class Engine:
    """Runs queries over a source of patterns (stored quads or mapped tables)."""

    def __init__(self, source, reorder: bool = True, path_cap: int = 1_000_000, prefixes: dict[str, str] | None = None):
        self.source, self.reorder, self.path_cap, self.prefixes = source, reorder, path_cap, prefixes or {}

    def compiler(self, source=None, unneeded: frozenset[str] = frozenset()) -> Compiler:
        return Compiler(source or self.source, self.reorder, self.path_cap, unneeded)

    def run(self, plan: A.Node) -> Result:
        """Run an algebra tree built by hand."""
        return Result("select", self.compiler().run(plan))

    def query(self, text: str, bindings: dict[str, str] | None = None) -> Result:
        """``bindings`` give variables terms before the query is compiled, as a prepared query's parameters."""
        q = parse_query(text, prefixes=self.prefixes)
        source = self.source.with_dataset(q.from_, q.from_named) if q.from_ or q.from_named else self.source
        plan = A.substitute(q.plan, bindings) if bindings else q.plan
        c = self.compiler(source, A.subjects_only(plan) if q.form == "select" else frozenset())
        match q.form:
            case "select":
                return Result("select", c.run(plan))
            case "ask":
                found = c.run(A.Slice(plan, 0, 1)).df
                df = found.agg((F.count(F.lit(1)) > 0).alias("ask"))
                return Result("ask", Rel(df, {"ask": V.BOOLEAN}, frozenset({"ask"})))
            case "construct":
                return Result("construct", construct(c.run(plan), q.template))
        return Result("describe", self.describe(c, plan, q.describe, source))

    def describe(self, c: Compiler, plan: A.Node, wanted: tuple, source) -> Rel:
        """The triples whose subject is one of the described terms."""
        rel = c.run(plan)
        parts = [self_terms(rel, t[1:]) for t in wanted if A.is_var(t) and t[1:] in rel.kinds]
        constants = [(t,) for t in wanted if not A.is_var(t)]
        if constants:
            parts.append(Rel(source.spark.createDataFrame(constants, "s string"), {"s": V.TERM}, frozenset({"s"})))
        out = None
        for p in parts:
            out = p if out is None else joins.union(out, p)
        triples = c.run(A.BGP((A.Pattern("?s", "?p", "?o"),))).converted({"s": V.TERM, "p": V.TERM, "o": V.TERM})
        if out is None:
            return triples.where(F.lit(False))
        return Rel(joins.semi(triples, Rel(out.df.distinct(), out.kinds, out.certain), False).df.distinct(), triples.kinds, triples.certain)

    def with_timeout(self, action: Callable[[], Any], seconds: float) -> Any:
        """Run an action; past the timeout its Spark jobs are cancelled, not only abandoned."""
        sc = self.source.spark.sparkContext
        group = f"query-{uuid.uuid4().hex}"
        out: dict[str, Any] = {}

        def work() -> None:
            sc.setJobGroup(group, group, interruptOnCancel=True)
            try:
                out["value"] = action()
            except BaseException as e:  # noqa: BLE001  handed to the caller
                out["error"] = e

        thread = InheritableThread(target=work, daemon=True)
        late = threading.Event()
        with METRICS.query():
            thread.start()
            thread.join(seconds)
            if thread.is_alive():
                late.set()
                sc.cancelJobGroup(group)
                thread.join(10)
            if late.is_set():
                raise QueryTimeout(f"the query took more than {seconds} s")
            if "error" in out:
                raise out["error"]
            return out.get("value")


def self_terms(rel: Rel, var: str) -> Rel:
    return Rel(rel.df.select(V.term(rel.val(var)).alias("s")).where(F.col("s").isNotNull()), {"s": V.TERM}, frozenset({"s"}))


def instantiate(rel: Rel, template: tuple) -> DataFrame:
    """(s, p, o, c) of a template for every solution; incomplete or ill-formed quads are left out, blank nodes are new for each solution."""
    terms = {v: V.term(rel.val(v)) for v in rel.kinds}
    row = F.md5(F.encode(F.concat_ws("\u0001", *[F.coalesce(t, F.lit("")) for t in terms.values()]), "UTF-8")) if terms else F.lit("0")

    def column(t: Any):
        if isinstance(t, A.TripleTerm):
            return F.concat(F.lit("<< "), column(t.s), F.lit(" "), column(t.p), F.lit(" "), column(t.o), F.lit(" >>"))
        if A.is_var(t):
            return terms.get(t[1:], F.lit(None).cast("string"))
        if t.startswith("_:"):
            return F.concat(F.lit(t + "_"), row)
        return F.lit(t)

    parts = []
    for s, p, o, g in template:
        parts.append(rel.df.select(column(s).alias("s"), column(p).alias("p"), column(o).alias("o"), (column(g) if g is not None else F.lit(T.DEFAULT_GRAPH)).alias("c")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    ok = F.col("s").isNotNull() & F.col("o").isNotNull() & F.col("c").isNotNull() & T.is_iri_col(F.col("p")) & ~T.is_literal(F.col("s"))
    return out.where(ok)


def construct(rel: Rel, template: tuple) -> Rel:
    if not template:
        return rel.only(["s", "p", "o"]).where(F.lit(False))
    df = instantiate(rel, template).select("s", "p", "o").distinct()
    return Rel(df, {v: V.TERM for v in "spo"}, frozenset("spo"))
