"""Joins under SPARQL compatibility: an unbound variable agrees with anything.

Variables bound for certain on both sides are plain equi-join keys. Others are compared as "equal, or either unbound": as a
residual beside a certain key; without one, the sides are split by what is unbound, so that no condition has to be an OR alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..relation import Rel, never_equal, unify
from ..runtime import fresh


def _shared(a: Rel, b: Rel) -> tuple[list[str], list[str]]:
    both = [v for v in a.kinds if v in b.kinds]
    sure = [v for v in both if v in a.certain and v in b.certain]
    return sure, [v for v in both if v not in sure]


def _sides(a: Rel, b: Rel) -> tuple[Rel, Rel, dict[str, str]]:
    """b with its shared variables renamed, so that both columns can be named."""
    names = {v: fresh(v) for v in b.kinds if v in a.kinds}
    return a, b.renamed(names), names


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda x, y: x & y, conditions) if conditions else None


def _agree(v: str, w: str) -> Column:
    x, y = F.col(f"`{v}`"), F.col(f"`{w}`")
    return (x == y) | x.isNull() | y.isNull()


def _merged(a: Rel, b: Rel, names: dict[str, str], joined, certain: frozenset[str]) -> Rel:
    cols = {}
    for v, k in a.kinds.items():
        x = F.col(f"`{v}`")
        cols[v] = (k, F.coalesce(x, F.col(f"`{names[v]}`")) if v in names and v not in a.certain else x)
    for v, k in b.kinds.items():
        if v not in names.values():
            cols[v] = (k, F.col(f"`{v}`"))
    return Rel(joined).select(cols, certain)


def join(a: Rel, b: Rel) -> Rel:
    """All compatible pairs, as a bag."""
    if any(never_equal(a.kinds[v], b.kinds[v]) and v in a.certain and v in b.certain for v in a.kinds if v in b.kinds):
        a, b = unify(a, b)
        a = a.where(F.lit(False))
    else:
        a, b = unify(a, b)
    sure, maybe = _shared(a, b)
    certain = a.certain | b.certain
    left, right, names = _sides(a, b)
    if sure or not maybe:
        keys = [F.col(f"`{v}`") == F.col(f"`{names[v]}`") for v in sure]
        on = _all(keys + [_agree(v, names[v]) for v in maybe])
        joined = left.df.crossJoin(right.df.drop("_row")) if on is None else left.df.join(right.df.drop("_row"), on, "inner")
        return _merged(left, right, names, joined.drop("_row"), certain)
    # no certain key: one equi-join for each combination of what is bound, on the first such variable
    v, w = maybe[0], names[maybe[0]]
    x, y = F.col(f"`{v}`"), F.col(f"`{w}`")
    rest = [_agree(u, names[u]) for u in maybe[1:]]
    parts = []
    for lcond, rcond, eq in ((x.isNotNull(), y.isNotNull(), [x == y]), (x.isNull(), None, []), (x.isNotNull(), y.isNull(), [])):
        ldf = left.df.where(lcond)
        rdf = right.df.where(rcond) if rcond is not None else right.df
        on = _all(eq + rest)
        joined = ldf.crossJoin(rdf) if on is None else ldf.join(rdf, on, "inner")
        parts.append(_merged(left, right, names, joined, certain))
    return Rel(reduce(lambda p, q: p.unionByName(q), (p.df for p in parts)), parts[0].kinds, certain)


def left_join(a: Rel, b: Rel, condition=None) -> Rel:
    """OPTIONAL: ``condition(scope) -> Column`` sees both sides and is part of the match."""
    a, b = unify(a, b)
    sure, maybe = _shared(a, b)
    left, right, names = _sides(a, b)
    scope = left.scope()
    for v in right.kinds:
        if v not in names.values():
            scope[v] = right.val(v)
    for v in maybe:  # in the match, a variable unbound on the left has the right side's value
        scope[v] = type(scope[v])(scope[v].kind, F.coalesce(F.col(f"`{v}`"), F.col(f"`{names[v]}`")))
    extra = [condition(scope)] if condition is not None else []
    keys = [F.col(f"`{v}`") == F.col(f"`{names[v]}`") for v in sure]
    if sure or not maybe:
        on = _all(keys + [_agree(v, names[v]) for v in maybe] + extra)
        joined = left.df.join(right.df.drop("_row"), F.lit(True) if on is None else on, "left")
        return _merged(left, right, names, joined, a.certain)
    row = fresh("row")
    marked = Rel(a.df.withColumn(row, F.monotonically_increasing_id()), a.kinds, a.certain)
    from ..runtime import cut

    marked = Rel(cut(marked.df), a.kinds, a.certain)  # the row numbers must be the same in both uses
    keyed = Rel(marked.df, a.kinds | {row: type(next(iter(a.kinds.values())))("integer")}, a.certain | {row})
    inner = join(keyed, b)
    if condition is not None:
        inner = inner.where(condition(inner.scope()))
    unmatched = marked.df.join(inner.df.select(row).distinct(), row, "left_anti").drop(row)
    out = inner.df.drop(row).unionByName(unmatched, allowMissingColumns=True)
    kinds = {v: k for v, k in inner.kinds.items() if v != row}
    return Rel(out, kinds, a.certain)


def minus(a: Rel, b: Rel) -> Rel:
    """Drop solutions of ``a`` with a compatible one in ``b`` that shares at least one bound variable."""
    kinds = a.kinds
    ua, ub = unify(a, b)
    sure, maybe = _shared(ua, ub)
    if not sure and not maybe:
        return a
    shared = sure + maybe
    ub = ub.only(shared)
    names = {v: fresh(v) for v in shared}
    right = Rel(ub.df.distinct(), ub.kinds, ub.certain).renamed(names)
    equal = [F.col(f"`{v}`") == F.col(f"`{names[v]}`") for v in sure]
    conditions = equal + [_agree(v, names[v]) for v in maybe]
    if not sure:
        conditions.append(reduce(lambda x, y: x | y, [F.col(f"`{v}`").isNotNull() & F.col(f"`{names[v]}`").isNotNull() for v in maybe]))
    return Rel(ua.df.join(right.df, _all(conditions), "left_anti"), ua.kinds if ua.kinds != kinds else kinds, a.certain)


def semi(a: Rel, b: Rel, negated: bool, condition=None) -> Rel:
    """EXISTS and NOT EXISTS: correlated on the shared variables, with a condition over both sides."""
    ua, ub = unify(a, b)
    sure, maybe = _shared(ua, ub)
    left, right, names = _sides(ua, ub)
    scope = left.scope() | {v: right.val(v) for v in right.kinds if v not in names.values()}
    conditions = [F.col(f"`{v}`") == F.col(f"`{names[v]}`") for v in sure] + [_agree(v, names[v]) for v in maybe]
    if condition is not None:
        conditions.append(F.coalesce(condition(scope), F.lit(False)))
    on = _all(conditions)
    how = "left_anti" if negated else "left_semi"
    rdf = right.df if on is not None else right.df.limit(1)
    return Rel(left.df.join(rdf.drop("_row"), F.lit(True) if on is None else on, how), ua.kinds, ua.certain)


def union(a: Rel, b: Rel) -> Rel:
    """Bag union; variables of one side only are NULL in the other."""
    a, b = unify(a, b)
    out = a.df.unionByName(b.df, allowMissingColumns=True)
    return Rel(out.drop("_row") if a.kinds or b.kinds else out, a.kinds | b.kinds, a.certain & b.certain)
