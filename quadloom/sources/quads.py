"""Stored quads: s, p, o, c as canonical term strings, best partitioned by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..functions.values import TERM
from ..plans.algebra import Pattern, is_var
from ..relation import Rel

QUAD_SCHEMA = "s string, p string, o string, c string"


class Graphs:
    """The active graph: ("default", None), ("const", term) or ("var", name)."""

    DEFAULT = ("default", None)


class QuadSource:
    """Patterns over a DataFrame of quads.

    Without GRAPH the default graph is the union of all graphs, each triple once; ``one_graph`` says that no triple is in two
    graphs, which saves the DISTINCT. Named graphs are those other than the default one.
    """

    def __init__(self, quads: DataFrame, one_graph: bool = False, from_: tuple[str, ...] = (), from_named: tuple[str, ...] = ()):
        self.quads, self.one_graph, self.from_, self.from_named = quads, one_graph, from_, from_named

    @property
    def spark(self) -> SparkSession:
        return self.quads.sparkSession

    def with_dataset(self, from_: tuple[str, ...], from_named: tuple[str, ...]) -> QuadSource:
        return QuadSource(self.quads, self.one_graph and len(from_) <= 1, from_, from_named)

    def active(self, graph: tuple) -> DataFrame:
        kind, name = graph
        limited = bool(self.from_ or self.from_named)
        if kind == "default":
            return self.quads.where(F.col("c").isin(*self.from_)) if limited else self.quads
        named = self.quads.where(F.col("c").isin(*self.from_named)) if limited else self.quads.where(F.col("c") != T.DEFAULT_GRAPH)
        return named.where(F.col("c") == name) if kind == "const" else named

    def bgp(self, patterns: tuple[Pattern, ...], graph: tuple, unneeded: frozenset[str] = frozenset()) -> list[Rel]:
        """``unneeded`` is of no use here: a triple's subject is part of its identity."""
        return [self.scan(p, graph) for p in patterns]

    def scan(self, p: Pattern, graph: tuple) -> Rel:
        df = self.active(graph)
        seen: dict[str, str] = {}
        terms = {"s": p.s, "p": p.p, "o": p.o}
        if graph[0] == "var":
            terms["c"] = f"?{graph[1]}"
        for column, t in terms.items():
            if not is_var(t):
                df = df.where(F.col(column) == t)
            elif t[1:] in seen:
                df = df.where(F.col(column) == F.col(seen[t[1:]]))
            else:
                seen[t[1:]] = column
        df = df.select(*[F.col(c).alias(v) for v, c in seen.items()]) if seen else df.select(F.lit(1).alias("_row")).limit(1)
        if graph[0] == "default" and seen and not (self.one_graph or len(self.from_) == 1):
            df = df.distinct()
        return Rel(df, {v: TERM for v in seen}, frozenset(seen))

    def size(self, p: Pattern) -> float:
        """A guess at a pattern's rows, for ordering."""
        bound = "".join(k for k, t in zip("spo", (p.s, p.p, p.o)) if not is_var(t))
        return {"spo": 1, "sp": 10, "po": 100, "so": 10, "s": 100, "o": 1000, "p": 10_000, "": 1_000_000}[bound]

    def nodes(self, graph: tuple) -> Rel:
        """Every subject and object of the active graph."""
        df = self.active(graph)
        both = df.select(F.col("s").alias("n")).union(df.select(F.col("o").alias("n"))).distinct()
        return Rel(both, {"n": TERM}, frozenset({"n"}))

    def graph_names(self) -> DataFrame:
        return self.active(("var", "g")).select("c").distinct()
