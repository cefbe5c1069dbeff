"""SPARQL algebra as frozen dataclasses; they can be built by hand and run with ``Engine.run``.

Terms in patterns are strings: ``?name`` for a variable, otherwise a canonical N-Triples term; a ``TripleTerm`` holds three of
them. Expressions are tuples: ("var", name), ("const", term), (operator, argument, ...), ("agg", function, distinct, argument,
separator), ("exists", negated, pattern), ("in", negated, expression, [expressions]), ("insub", negated, expression, plan).
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class TripleTerm:
    s: Any
    p: Any
    o: Any


class Node:
    """Base of all operators."""


@dataclass(frozen=True)
class Pattern:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class BGP(Node):
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class PathPattern(Node):
    """path: ("iri", term), ("seq"|"alt", a, b), ("inv"|"star"|"plus"|"opt", a), ("nps", forward, inverse)."""

    s: Any
    path: tuple
    o: Any


@dataclass(frozen=True)
class Unit(Node):
    """One row without variables."""


@dataclass(frozen=True)
class Nothing(Node):
    """No rows."""

    vars: tuple[str, ...] = ()


@dataclass(frozen=True)
class Values(Node):
    vars: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    condition: tuple | None = None


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Filter(Node):
    sub: Node
    condition: tuple


@dataclass(frozen=True)
class Extend(Node):
    sub: Node
    var: str
    expr: tuple


@dataclass(frozen=True)
class Decompose(Node):
    """Binds or compares the parts of the triple term in ``var``."""

    sub: Node
    var: str
    parts: tuple


@dataclass(frozen=True)
class Graph(Node):
    graph: str
    sub: Node


@dataclass(frozen=True)
class Group(Node):
    sub: Node
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, tuple], ...]


@dataclass(frozen=True)
class OrderBy(Node):
    sub: Node
    keys: tuple[tuple[tuple, bool], ...]


@dataclass(frozen=True)
class Project(Node):
    sub: Node
    vars: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Node):
    sub: Node


@dataclass(frozen=True)
class Slice(Node):
    sub: Node
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Query:
    """form: select, ask, construct or describe."""

    form: str
    plan: Node
    template: tuple = ()
    describe: tuple = ()
    from_: tuple[str, ...] = ()
    from_named: tuple[str, ...] = ()


@dataclass(frozen=True)
class Update:
    """One update operation: kind is insert_data, delete_data, modify, clear, add or move-like copies."""

    kind: str
    delete: tuple = ()
    insert: tuple = ()
    where: Node | None = None
    target: Any = None
    source: Any = None


def is_var(t: Any) -> bool:
    return isinstance(t, str) and t.startswith("?")


def term_vars(t: Any) -> set[str]:
    if isinstance(t, TripleTerm):
        return term_vars(t.s) | term_vars(t.p) | term_vars(t.o)
    return {t[1:]} if is_var(t) else set()


def expr_vars(e: Any) -> set[str]:
    if isinstance(e, Node):
        return possible(e)
    if isinstance(e, (tuple, list)):
        if len(e) == 2 and e[0] == "var":
            return {e[1]}
        if e and e[0] == "const":
            return set()
        return set().union(*(expr_vars(x) for x in e)) if e else set()
    return set()


def possible(n: Node) -> set[str]:
    """Variables that some solution may bind."""
    match n:
        case BGP(ps):
            return set().union(*(term_vars(t) for p in ps for t in (p.s, p.p, p.o)))
        case PathPattern(s, _, o):
            return term_vars(s) | term_vars(o)
        case Values(vs, _) | Nothing(vs):
            return set(vs)
        case Join(a, b) | LeftJoin(a, b) | Union(a, b):
            return possible(a) | possible(b)
        case Minus(a, _):
            return possible(a)
        case Extend(s, v, _):
            return possible(s) | {v}
        case Decompose(s, v, parts):
            return possible(s) | {v} | set().union(*(term_vars(t) for t in parts))
        case Graph(g, s):
            return possible(s) | term_vars(g)
        case Group(_, ks, aggs):
            return {*ks, *(a for a, _ in aggs)}
        case Project(_, vs):
            return set(vs)
        case Filter(s, _) | OrderBy(s, _) | Distinct(s) | Slice(s, _, _):
            return possible(s)
    return set()


def substitute(x: Any, values: dict[str, str]) -> Any:
    """Replace variables by terms in patterns and expressions; BOUND of a replaced variable is true, projections keep it."""
    if isinstance(x, str):
        return values[x[1:]] if is_var(x) and x[1:] in values else x
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        return ("const", values[x[1]]) if x[1] in values else x
    if isinstance(x, tuple) and x and x[0] == "const":
        return x
    if isinstance(x, (tuple, list)):
        return type(x)(substitute(y, values) for y in x)
    if isinstance(x, Project):
        sub = substitute(x.sub, values)
        for v in x.vars:
            if v in values and v not in possible(sub):
                sub = Extend(sub, v, ("const", values[v]))
        return Project(sub, x.vars)
    if isinstance(x, Extend) and x.var in values:
        return Filter(substitute(x.sub, values), ("sameterm", substitute(x.expr, values), ("const", values[x.var])))
    if is_dataclass(x) and not isinstance(x, (Values, Group)):
        return replace(x, **{f.name: substitute(getattr(x, f.name), values) for f in fields(x)})
    if isinstance(x, Group):
        return Group(substitute(x.sub, values), x.keys, tuple((a, substitute(e, values)) for a, e in x.aggregates))
    return x


def subjects_only(plan: Node) -> frozenset[str]:
    """Variables that occur as the subject of one BGP's patterns and nowhere else, so that no column is needed for them."""
    once: dict[str, int] = {}
    used: set[str] = set()

    def walk(x: Any) -> None:
        if isinstance(x, BGP):
            for s in {p.s for p in x.patterns}:
                for v in term_vars(s):
                    once[v] = once.get(v, 0) + 1
                    if isinstance(s, TripleTerm):
                        used.add(v)
            for p in x.patterns:
                used.update(term_vars(p.p) | term_vars(p.o))
        elif isinstance(x, Group):
            used.update(x.keys)
            if any(a[1] == "count" and a[2] and a[3] is None for _, a in x.aggregates):
                used.update(possible(x.sub))
            walk(x.aggregates)
            walk(x.sub)
        elif isinstance(x, (Project, Values)):
            used.update(x.vars)
            if isinstance(x, Project):
                walk(x.sub)
        elif isinstance(x, Minus):
            used.update(possible(x.left) & possible(x.right))
            walk(x.left)
            walk(x.right)
        elif isinstance(x, Decompose):
            used.update({x.var}, *(term_vars(t) for t in x.parts))
            walk(x.sub)
        elif isinstance(x, Extend):
            used.add(x.var)
            walk(x.expr)
            walk(x.sub)
        elif is_dataclass(x):
            for f in fields(x):
                walk(getattr(x, f.name))
        elif isinstance(x, (tuple, list)):
            if len(x) == 2 and x[0] == "var":
                used.add(x[1])
            else:
                for y in x:
                    walk(y)
        elif isinstance(x, str) and is_var(x):
            used.add(x[1:])

    walk(plan)
    return frozenset(v for v, n in once.items() if n == 1 and v not in used)
