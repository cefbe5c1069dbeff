"""Relational tables as a virtual graph: no quad is ever materialised.

A bound predicate is a column of one table, so a pattern is a projection of that table. Patterns that share a subject and a
table are one scan (star collapse), constants become native predicates that reach the file scan, and foreign keys join as
their native keys, since both sides carry the same IRI prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import terms as T
from ..functions import values as V
from ..functions.values import NATIVE, TERM, Kind, Val
from ..plans.algebra import Pattern, is_var
from ..relation import Rel
from ..runtime import estimated_bytes

BASE = "http://ex.org/"
#: The key of a table without one: the row's place in its single file, read only where the subject is asked for.
ROW_ID = "_row_id"


@dataclass
class Table:
    """columns: predicate IRI to column; links: predicate IRI to (column, target table's name)."""

    name: str
    cls: str
    read: Callable[[], DataFrame]
    key: str
    columns: dict[str, str]
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    graph: str | None = None
    graph_column: str | None = None

    @property
    def subject(self) -> Kind:
        return Kind("iri", f"{BASE}{self.name}/")


def _kind(t: ST.DataType) -> Kind:
    if isinstance(t, (ST.ByteType, ST.ShortType, ST.IntegerType, ST.LongType)):
        return V.INTEGER
    if isinstance(t, (ST.FloatType, ST.DoubleType)):
        return V.DOUBLE
    if isinstance(t, ST.DecimalType):
        return V.DECIMAL
    if isinstance(t, ST.BooleanType):
        return V.BOOLEAN
    if isinstance(t, (ST.TimestampType, ST.TimestampNTZType)):
        return V.DATETIME
    return V.STRING


_NATIVE_TYPE = {"integer": "bigint", "double": "double", "decimal": "decimal(38,18)"}


class MappedSource:
    def __init__(self, spark: SparkSession, tables: list[Table], from_: tuple[str, ...] = (), from_named: tuple[str, ...] = ()):
        self.spark, self.tables, self.from_, self.from_named = spark, tables, from_, from_named
        self._read: dict[str, DataFrame] = {}

    def with_dataset(self, from_: tuple[str, ...], from_named: tuple[str, ...]) -> MappedSource:
        return MappedSource(self.spark, self.tables, from_, from_named)

    def frame(self, table: Table) -> DataFrame:
        if table.name not in self._read:
            self._read[table.name] = table.read()
        return self._read[table.name]

    # -- graphs: a table with a graph column has its rows in the named graph <graph><value>; all rows are in the default one

    def _in_graph(self, table: Table, df: DataFrame, graph: tuple) -> tuple[DataFrame, Kind | None]:
        kind, name = graph
        limited = bool(self.from_ or self.from_named)
        if kind == "default":
            if not limited:
                return df, None
            return self._graph_filter(table, df, self.from_), None
        df = self._graph_filter(table, df, self.from_named) if limited else df
        if table.graph_column is None:
            return df.where(F.lit(False)), Kind("iri", "none:")
        if kind == "const":
            return self._graph_filter(table, df, (name,)), None
        return df, Kind("iri", table.graph, text=True)

    def _graph_filter(self, table: Table, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        keys = [n[1:-1].removeprefix(table.graph) for n in names if table.graph_column and n[1:-1].startswith(table.graph)]
        return df.where(F.col(table.graph_column).isin(*keys)) if keys else df.where(F.lit(False))

    # -- patterns

    def _predicates(self, table: Table) -> list[str]:
        return [T.RDF_TYPE[1:-1], *table.columns, *table.links]

    def _value(self, table: Table, df: DataFrame, predicate: str) -> Val:
        """The object of a predicate for each row."""
        if predicate == T.RDF_TYPE[1:-1]:
            return Val(TERM, F.lit(f"<{table.cls}>"))
        if predicate in table.links:
            column, target = table.links[predicate]
            return Val(Kind("iri", f"{BASE}{target}/"), F.col(column).cast("bigint"))
        column = table.columns[predicate]
        kind = _kind(df.schema[column].dataType)
        return Val(kind, F.col(column).cast(_NATIVE_TYPE[kind.tag]) if kind.tag in _NATIVE_TYPE else F.col(column))

    def _tables_for(self, predicates: list[str], subject: str) -> list[Table]:
        out = []
        for t in self.tables:
            if all(p in self._predicates(t) for p in predicates) and (is_var(subject) or subject.startswith(f"<{t.subject.prefix}")):
                out.append(t)
        return out

    def bgp(self, patterns: tuple[Pattern, ...], graph: tuple, unneeded: frozenset[str] = frozenset()) -> list[Rel]:
        groups: dict[str, list[Pattern]] = {}
        single: list[list[Pattern]] = []
        for p in patterns:
            if is_var(p.p):
                single.append([p])
            else:
                groups.setdefault(p.s, []).append(p)
        out = []
        for s, ps in groups.items():
            # patterns of one subject that no table has all of are answered separately and joined; a class given for the
            # subject narrows the tables
            if self._tables_for([p.p[1:-1] for p in ps], s) or len(ps) == 1:
                out.append(self._star(s, ps, graph, s[1:] in unneeded))
            else:
                split: dict[tuple, list[Pattern]] = {}
                for p in ps:
                    split.setdefault(tuple(t.name for t in self._tables_for([p.p[1:-1]], s)), []).append(p)
                out += [self._star(s, q, graph) for q in split.values()]
        return out + [self._open(p[0], graph) for p in single]

    def _star(self, s: str, patterns: list[Pattern], graph: tuple, unneeded: bool = False) -> Rel:
        parts = []
        for t in self._tables_for([p.p[1:-1] for p in patterns], s):
            if any(p.p == T.RDF_TYPE and not is_var(p.o) and p.o != f"<{t.cls}>" for p in patterns):
                continue
            parts.append(self._scan(t, s, patterns, graph, unneeded))
        return self._union(parts, patterns, graph)

    def _union(self, parts: list[Rel], patterns: list[Pattern], graph: tuple) -> Rel:
        from ..operators.joins import union

        if parts:
            return reduce(union, parts)
        names = sorted({x[1:] for p in patterns for x in (p.s, p.p, p.o) if is_var(x)} | ({graph[1]} if graph[0] == "var" else set()))
        empty = self.spark.createDataFrame([], ", ".join(f"`{v}` string" for v in names) or "_row int")
        return Rel(empty, {v: TERM for v in names}, frozenset(names))

    def _scan(self, table: Table, s: str, patterns: list[Pattern], graph: tuple, unneeded: bool = False) -> Rel:
        df = self.frame(table)
        if table.key == ROW_ID and not unneeded:
            df = df.withColumn(ROW_ID, F.col("_metadata.row_index"))
        df, graph_kind = self._in_graph(table, df, graph)
        bound: dict[str, Val] = {}
        conditions: list[Column] = []

        def bind(t: str, v: Val) -> None:
            if not is_var(t):
                conditions.append(V.is_term(v, t))
            elif t[1:] in bound:
                conditions.append(V.same_term(bound[t[1:]], v))
            else:
                bound[t[1:]] = v

        if not unneeded:
            bind(s, Val(table.subject, F.col(table.key).cast("bigint")))
        for p in patterns:
            if not is_var(p.p) and p.p == T.RDF_TYPE:
                bind(p.o, self._value(table, df, T.RDF_TYPE[1:-1]))
                continue
            v = self._value(table, df, p.p[1:-1])
            conditions.append(v.col.isNotNull())
            bind(p.o, v)
        if graph[0] == "var" and graph_kind is not None and table.graph_column:
            bind(f"?{graph[1]}", Val(Kind("iri", table.graph, text=True), F.col(table.graph_column)))
        for c in conditions:
            df = df.where(c)
        if not bound:
            return Rel(df.select(F.lit(1).alias("_row")))
        rel = Rel(df).select({v: (x.kind, x.col) for v, x in bound.items()}, frozenset(bound))
        rel.key = s[1:] if is_var(s) and not unneeded else None
        return rel

    def _open(self, p: Pattern, graph: tuple) -> Rel:
        """An unbound predicate: every mapped column that the subject and object allow."""
        parts = []
        for t in self.tables:
            if not is_var(p.s) and not p.s.startswith(f"<{t.subject.prefix}"):
                continue
            for predicate in self._predicates(t):
                if predicate != T.RDF_TYPE[1:-1] and not is_var(p.o):
                    kind = self._value(t, self.frame(t), predicate).kind
                    if kind.tag == "iri" and not p.o.startswith(f"<{kind.prefix}") or kind.tag in NATIVE and V.const(p.o).kind != kind:
                        continue
                found = self._scan(t, p.s, [Pattern(p.s, f"<{predicate}>", p.o)], graph)
                name = p.p[1:]
                if name in found.kinds:
                    found = found.where(V.term(found.val(name)) == f"<{predicate}>")
                else:
                    cols = {v: (k, F.col(f"`{v}`")) for v, k in found.kinds.items()} | {name: (TERM, F.lit(f"<{predicate}>"))}
                    found = found.select(cols, frozenset(cols))
                parts.append(found)
        return self._union(parts, [p], graph)

    def size(self, p: Pattern) -> float:
        tables = self._tables_for([p.p[1:-1]] if not is_var(p.p) else [], p.s)
        n = sum(estimated_bytes(self.frame(t)) for t in tables) or 1
        return n / (1 if is_var(p.o) else 20) / (1 if is_var(p.s) else 1000)

    def nodes(self, graph: tuple) -> Rel:
        found = self._open(Pattern("?s", "?p", "?o"), graph).converted({"s": TERM, "o": TERM})
        both = found.df.select(F.col("s").alias("n")).union(found.df.select(F.col("o").alias("n"))).distinct()
        return Rel(both, {"n": TERM}, frozenset({"n"}))
