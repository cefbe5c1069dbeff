"""Algebra to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..errors import UnsupportedError
from ..functions import values as V
from ..functions.library import compile_expr
from ..functions.values import TERM, Kind, Val
from ..plans import algebra as A
from ..relation import Rel
from ..runtime import fresh
from . import joins
from .aggregates import aggregate
from .paths import PathCompiler

_DEFAULT = ("default", None)


class Compiler:
    """``reorder`` lets patterns be joined by size and connection rather than as written; results are the same."""

    def __init__(self, source, reorder: bool = True, path_cap: int = 1_000_000, unneeded: frozenset[str] = frozenset()):
        self.source, self.reorder, self.path_cap, self.unneeded = source, reorder, path_cap, unneeded

    @property
    def spark(self):
        return self.source.spark

    def run(self, n: A.Node, graph: tuple = _DEFAULT) -> Rel:
        match n:
            case A.BGP(patterns):
                return self.bgp(patterns, graph)
            case A.PathPattern(s, path, o):
                return PathCompiler(self.source, graph, self.path_cap).solve(s, path, o)
            case A.Unit():
                return Rel(self.spark.range(1).select(F.lit(1).alias("_row")))
            case A.Nothing(vs):
                return self.table([], vs)
            case A.Values(vs, rows):
                return self.table(rows, vs)
            case A.Join():
                return self.joined(n, graph)
            case A.LeftJoin(a, b, c):
                left, right = self.run(a, graph), self.run(b, graph)
                return joins.left_join(left, right, self.condition(c) if c is not None else None)
            case A.Union(a, b):
                return joins.union(self.run(a, graph), self.run(b, graph))
            case A.Minus(a, b):
                return joins.minus(self.run(a, graph), self.run(b, graph))
            case A.Filter(sub, c):
                return self.filtered(self.run(sub, graph), c, graph)
            case A.Extend(sub, v, e):
                rel, e = self.lifted(self.run(sub, graph), e, graph)
                return self._drop_flags(self.extended(rel, v, compile_expr(e, rel.scope())))
            case A.Decompose():
                return self.decompose(n, graph)
            case A.Graph(g, sub):
                return self.run(sub, ("var", g[1:]) if A.is_var(g) else ("const", g))
            case A.Group(sub, keys, aggs):
                return self.grouped(self.run(sub, graph), keys, aggs)
            case A.OrderBy(sub, keys):
                rel = self.run(sub, graph)
                return Rel(rel.df.orderBy(*self.sort_columns(rel, keys)), rel.kinds, rel.certain)
            case A.Project(sub, vs):
                return self.run(sub, graph).only(list(vs))
            case A.Distinct(sub):
                rel = self.run(sub, graph)
                return Rel(rel.df.distinct(), rel.kinds, rel.certain)
            case A.Slice(sub, offset, limit):
                rel = self.run(sub, graph)
                df = rel.df.offset(offset) if offset > 0 else rel.df
                return Rel(df.limit(limit) if limit is not None and limit >= 0 else df, rel.kinds, rel.certain)
        raise UnsupportedError(f"operator {type(n).__name__}")

    # -- leaves

    def table(self, rows, vs) -> Rel:
        """Literal solutions: native columns where every value of a variable has one native kind."""
        if not vs:
            return Rel(self.spark.range(len(rows)).select(F.lit(1).alias("_row")))
        df = self.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{v}` string" for v in vs))
        certain = frozenset(v for k, v in enumerate(vs) if all(r[k] is not None for r in rows))
        rel = Rel(df, {v: TERM for v in vs}, certain)
        cols: dict[str, tuple[Kind, Column]] = {}
        for k, v in enumerate(vs):
            kinds = {V.const(r[k]).kind for r in rows if r[k] is not None}
            x = F.col(f"`{v}`")
            kind = kinds.pop() if len(kinds) == 1 else TERM
            lex = F.regexp_extract(x, T._LIT, 1)
            native = {"integer": lambda c: c.try_cast("bigint"), "double": lambda c: c.try_cast("double"), "string": T.unescape_col}.get(kind.tag)
            cols[v] = (kind, F.when(x.isNotNull(), native(lex))) if native else (TERM, x)
        return rel.select(cols, certain)

    def bgp(self, patterns, graph: tuple) -> Rel:
        if not patterns:
            return self.run(A.Unit())
        return self.join_all(self.source.bgp(patterns, graph, self.unneeded), patterns)

    def join_all(self, rels: list[Rel], patterns=()) -> Rel:
        """Greedy order: the smallest first, then always one that shares a variable, if any does.

        Of these, one that shares a key comes first: no side then grows beyond the other's rows, where two tables with a foreign key
        in common, as customers and suppliers of a nation, give the product of each group.
        """
        if len(rels) == 1:
            return rels[0]
        if self.reorder:
            from ..runtime import estimated_bytes

            rest = sorted(rels, key=lambda r: estimated_bytes(r.df))
            out = [rest.pop(0)]
            have, keys = set(out[0].kinds), {out[0].key} - {None}
            while rest:
                near = [k for k, r in enumerate(rest) if have & set(r.kinds)]
                at = next((k for k in near if rest[k].key in have or keys & set(rest[k].kinds)), near[0] if near else 0)
                r = rest.pop(at)
                # a side whose rows each meet one of the other at most hands its keys on
                keys = (keys if r.key in have else set()) | ({r.key} - {None} if keys & set(r.kinds) else set())
                out.append(r)
                have |= set(r.kinds)
            rels = out
        return reduce(joins.join, rels)

    def joined(self, n: A.Join, graph: tuple) -> Rel:
        parts: list[A.Node] = []

        def flatten(x: A.Node) -> None:
            if isinstance(x, A.Join):
                flatten(x.left)
                flatten(x.right)
            elif not isinstance(x, A.Unit):
                parts.append(x)

        flatten(n)
        rels = [self.run(p, graph) for p in parts] or [self.run(A.Unit())]
        return self.join_all(rels) if all(isinstance(p, (A.BGP, A.Values, A.PathPattern)) for p in parts) else reduce(joins.join, rels)

    # -- expressions

    def condition(self, e: tuple):
        return lambda scope: V.ebv(compile_expr(e, scope))

    def filtered(self, rel: Rel, e: tuple, graph: tuple) -> Rel:
        if e[0] == "and":
            return self.filtered(self.filtered(rel, e[1], graph), e[2], graph)
        if e[0] == "exists" or e[0] == "not" and e[1][0] == "exists":
            negated = e[1] if e[0] == "exists" else not e[1][1]
            pattern = e[2] if e[0] == "exists" else e[1][2]
            return self.exists(rel, pattern, negated, graph)
        rel, e = self.lifted(rel, e, graph)
        return self._drop_flags(rel.where(V.ebv(compile_expr(e, rel.scope()))))

    def exists(self, rel: Rel, pattern: A.Node, negated: bool, graph: tuple) -> Rel:
        condition = None
        if isinstance(pattern, A.Filter) and A.expr_vars(pattern.condition) - A.possible(pattern.sub):
            condition, pattern = self.condition(pattern.condition), pattern.sub
        return joins.semi(rel, self.run(pattern, graph), negated, condition)

    def lifted(self, rel: Rel, e: tuple, graph: tuple) -> tuple[Rel, tuple]:
        """Turn EXISTS and IN (subquery) inside an expression into boolean columns."""
        if not isinstance(e, tuple) or not e or e[0] in ("var", "const"):
            return rel, e
        if e[0] in ("exists", "insub"):
            flag = fresh("flag")
            if e[0] == "exists":
                hit = lambda neg: self.exists(rel, e[2], neg, graph)
            else:
                sub = self.run(e[3], graph)
                column = sub.vars[0]
                key = fresh("key")
                keyed = self.extended(rel, key, compile_expr(e[2], rel.scope()))
                sub = sub.renamed({column: key}).only([key])
                hit = lambda neg: joins.semi(keyed, Rel(sub.df.distinct(), sub.kinds, sub.certain), neg)
            # e[1] says that the expression is negated: it holds for the rows that match in its own form
            yes = self.extended(hit(e[1]), flag, V.boolean(F.lit(True)))
            no = self.extended(hit(not e[1]), flag, V.boolean(F.lit(False)))
            return joins.union(yes, no), ("var", flag)
        out = []
        for x in e:
            if isinstance(x, tuple) and x and isinstance(x[0], tuple):
                items = []
                for y in x:
                    rel, y = self.lifted(rel, y, graph)
                    items.append(y)
                out.append(tuple(items))
            else:
                rel, x = self.lifted(rel, x, graph)
                out.append(x)
        return rel, tuple(out)

    @staticmethod
    def _drop_flags(rel: Rel) -> Rel:
        keep = [v for v in rel.kinds if not v.startswith(("_flag", "_key"))]
        return rel if len(keep) == len(rel.kinds) else rel.only(keep)

    def extended(self, rel: Rel, var: str, v: Val) -> Rel:
        return Rel(rel.df.withColumn(var, v.col), {**{k: x for k, x in rel.kinds.items() if k != var}, var: v.kind}, rel.certain)

    def decompose(self, n: A.Node, graph: tuple) -> Rel:
        """Take triple terms apart where their pattern is scanned, so that variables in their parts are join keys."""
        steps = []
        while isinstance(n, A.Decompose):
            steps.append((n.var, n.parts))
            n = n.sub
        parts: list[A.Node] = []

        def flatten(x: A.Node) -> None:
            if isinstance(x, A.Join):
                flatten(x.left)
                flatten(x.right)
            elif not isinstance(x, A.Unit):
                parts.append(x)

        flatten(n)
        if not parts or not all(isinstance(p, (A.BGP, A.Values, A.PathPattern)) for p in parts):
            parts = [n]
        rels: list[Rel] = []
        for p in parts:
            rels += self.source.bgp(p.patterns, graph, self.unneeded) if isinstance(p, A.BGP) and p.patterns else [self.run(p, graph)]
        for v, of in reversed(steps):
            k = next(k for k, r in enumerate(rels) if v in r.kinds)
            rels[k] = self.decomposed(rels[k], v, of)
        return self.join_all(rels)

    def decomposed(self, rel: Rel, var: str, parts: tuple) -> Rel:
        """Match the parts of the triple term in ``var`` with constants, bound variables or new ones."""
        rel = rel.converted({var: TERM})
        t = rel.val(var).col
        rel = rel.where(T.is_triple_col(t))
        # cheap conditions that reach the scan; the parts themselves are compared below
        for k, x in enumerate(parts):
            if not A.is_var(x):
                rel = rel.where([F.startswith(t, F.lit(f"<< {x} ")), F.contains(t, F.lit(f" {x} ")), F.endswith(t, F.lit(f" {x} >>"))][k])
        names = [fresh("part") for _ in parts]
        whole = T.parts_col(t)
        # a generator: what is asked of the parts later isn't answered by splitting the term anew each time
        split = F.inline(F.filter(F.array(whole), lambda x: x.isNotNull())).alias(*names)
        df = rel.df.select(*[F.col(f"`{v}`") for v in rel.vars], split)
        kinds = dict(rel.kinds)
        certain = set(rel.certain)
        for name, x in zip(names, parts):
            part = F.col(name)
            if not A.is_var(x):
                df = df.where(part == x)
            elif x[1:] in kinds:
                df = df.where(V.term(Val(kinds[x[1:]], F.col(f"`{x[1:]}`"))) == part)
            else:
                df = df.withColumn(x[1:], part)
                kinds[x[1:]] = TERM
                certain.add(x[1:])
        return Rel(df.select(*[F.col(f"`{v}`") for v in kinds]), kinds, frozenset(certain))

    # -- grouping and order

    def grouped(self, rel: Rel, keys: tuple, aggs: tuple) -> Rel:
        scope = rel.scope()
        named = {k: scope.get(k, V.null()) for k in keys}
        everything = [F.col(f"`{v}`") for v in rel.vars]
        outs: dict[str, Val] = {}
        for name, (_, fn, distinct, arg, sep) in aggs:
            outs[name] = aggregate(fn, distinct, compile_expr(arg, scope) if arg is not None else None, sep, everything)
        # one grouping column for each key, equal terms grouped as they are
        grouped = rel.df.groupBy(*[v.col.alias(k) for k, v in named.items()])
        columns = [v.col.alias(name) for name, v in outs.items()]
        df = grouped.agg(*columns) if columns else rel.df.select(*[v.col.alias(k) for k, v in named.items()]).distinct()
        kinds = {k: v.kind for k, v in named.items()} | {k: v.kind for k, v in outs.items()}
        counts = {name for name, (_, fn, *_rest) in aggs if fn == "count"}
        return Rel(df, kinds, (rel.certain & set(keys)) | frozenset(counts))

    def sort_columns(self, rel: Rel, keys: tuple) -> list[Column]:
        out = []
        for e, asc in keys:
            for c in V.sort_keys(compile_expr(e, rel.scope())):
                out.append(c.asc_nulls_first() if asc else c.desc_nulls_last())
        return out
