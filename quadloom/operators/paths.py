"""Property paths: each path expression is a DataFrame of (s, o) pairs, closures are semi-naive loops.

A closure starts from a bound endpoint where there is one. Rounds are cut through the checkpoint folder; the number of pairs is
guarded by a cap that stops the query with an error, never with a partial answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..errors import LimitExceeded
from ..functions import values as V
from ..functions.values import TERM
from ..plans.algebra import Pattern, is_var
from ..relation import Rel, unify
from ..runtime import cut
from . import joins

S, O, M = "_s", "_o", "_m"
#: Rounds whose pairs are kept apart before they are put together.
PARTS = 8


class PathCompiler:
    def __init__(self, source, graph: tuple, cap: int):
        self.source, self.graph, self.cap = source, graph, cap
        self.extra = [graph[1]] if graph[0] == "var" else []

    def edges(self, s: str, p: str, o: str) -> Rel:
        rels = self.source.bgp((Pattern(s, p, o),), self.graph)
        return reduce(joins.join, rels)

    def pairs(self, path: tuple) -> Rel:
        match path:
            case ("iri", p):
                return self.edges(f"?{S}", p, f"?{O}")
            case ("inv", a):
                return self.pairs(a).renamed({S: O, O: S})
            case ("seq", a, b):
                out = joins.join(self.pairs(a).renamed({O: M}), self.pairs(b).renamed({S: M}))
                return out.only([S, O, *self.extra])
            case ("alt", a, b):
                return joins.union(self.pairs(a), self.pairs(b))
            case ("nps", forward, inverse):
                parts = []
                if forward or not inverse:
                    parts.append(self._except(forward, f"?{S}", f"?{O}"))
                if inverse:
                    parts.append(self._except(inverse, f"?{O}", f"?{S}"))
                return reduce(joins.union, parts)
            case ("opt", a):
                return self._distinct(joins.union(self.pairs(a), self.identity()))
            case ("plus", a):
                return self.closure(self.pairs(a))
            case ("star", a):
                return self._distinct(joins.union(self.closure(self.pairs(a)), self.identity()))
        raise ValueError(path)

    def _except(self, predicates: tuple, s: str, o: str) -> Rel:
        found = self.edges(s, "?_p", o)
        p = V.term(found.val("_p"))
        return found.where(~p.isin(*predicates) if predicates else F.lit(True)).only([S, O, *self.extra])

    @staticmethod
    def _distinct(r: Rel) -> Rel:
        return Rel(r.df.distinct(), r.kinds, r.certain)

    def identity(self) -> Rel:
        nodes = self.source.nodes(self.graph)
        k = nodes.kinds["n"]
        n = F.col("n")
        return nodes.select({S: (k, n), O: (k, n)}, frozenset({S, O}))

    def _one_kind(self, r: Rel) -> Rel:
        k = V.common(r.kinds[S], r.kinds[O])
        return r.converted({S: k, O: k})

    def closure(self, step: Rel, start: str | None = None, end: str | None = None) -> Rel:
        """One or more steps; with ``start`` (or ``end``) only from (or to) that term."""
        step = self._one_kind(self._distinct(step))
        names = [S, O, *self.extra]
        edges = cut(step.only(names).df)
        backwards = start is None and end is not None
        a, b = (O, S) if backwards else (S, O)
        bound = end if backwards else start
        frontier = edges if bound is None else cut(edges.where(V.is_term(V.Val(step.kinds[a], F.col(a)), bound)))
        hop = edges.select(F.col(a).alias(M), F.col(b).alias("_next"), *self.extra)
        parts, pairs = [frontier], frontier.count()
        while True:
            reached = frontier.withColumnRenamed(b, M).join(hop, [M, *self.extra]).select(F.col(a), F.col("_next").alias(b), *self.extra).distinct()
            seen = reduce(lambda x, y: x.unionByName(y), parts)
            frontier = cut(reached.join(seen, [a, b, *self.extra], "left_anti").select(*names))
            new = frontier.count()
            if not new:
                break
            pairs += new
            if self.cap and pairs > self.cap:
                raise LimitExceeded(f"a path closure has more than {self.cap} pairs; bind an endpoint or raise the cap")
            parts.append(frontier)
            if len(parts) > PARTS:  # few parts, each pair written about once in PARTS rounds
                parts = [cut(reduce(lambda x, y: x.unionByName(y), parts))]
        seen = reduce(lambda x, y: x.unionByName(y), parts)
        return Rel(seen, {v: step.kinds[v] for v in names}, frozenset(names))

    def solve(self, s: str, path: tuple, o: str) -> Rel:
        start, end = (None if is_var(t) else t for t in (s, o))
        if path[0] in ("plus", "star") and (start or end):
            found = self.closure(self.pairs(path[1]), start, end)
            if path[0] == "star":
                found = self._with_zero(found, start, end)
        elif path[0] in ("opt", "star"):
            if start or end:
                found = self._with_zero(self.pairs(path[1]) if path[0] == "opt" else self.closure(self.pairs(path[1])), start, end)
            else:
                found = self.pairs(path)
        else:
            found = self.pairs(path)
        if start:
            found = found.where(V.is_term(found.val(S), start))
        if end:
            found = found.where(V.is_term(found.val(O), end))
        if is_var(s) and s == o:
            found = self._one_kind(found)
            found = found.where(F.col(S) == F.col(O))
        cols = {}
        for t, column in ((s, S), (o, O)):
            if is_var(t):
                cols[t[1:]] = (found.kinds[column], F.col(column))
        cols |= {g: (found.kinds[g], F.col(f"`{g}`")) for g in self.extra if g in found.kinds}
        return found.select(cols, frozenset(cols))

    def _with_zero(self, found: Rel, start: str | None, end: str | None) -> Rel:
        """Add the path of no steps from a bound term to itself, whether or not the term is in the data."""
        term = start or end
        spark = self.source.spark
        same = [] if start and end and start != end else [(term, term)]
        zero = Rel(spark.createDataFrame(same, f"{S} string, {O} string"), {S: TERM, O: TERM}, frozenset({S, O}))
        if self.extra:  # the path of no steps is in every graph
            names = self._distinct(self.edges("?_a", "?_b", "?_c").only(self.extra))
            zero = joins.join(zero, names)
        a, b = unify(found, zero)
        return self._distinct(joins.union(a, b))
