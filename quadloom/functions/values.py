"""Typed values: a Column with what is known of it before any row is read.

Kinds: TERM (a canonical term string), an IRI kind (native key and an IRI prefix), or a native literal (integer, decimal,
double, string, boolean, dateTime). Unbound and error are both NULL, so three-valued logic is SQL's own. Everything here is
built-in functions; nothing may throw under ANSI mode.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T


@dataclass(frozen=True)
class Kind:
    """``text``: the key of an IRI kind is a string, not a number."""

    tag: str
    prefix: str = ""
    text: bool = False

    @property
    def numeric(self) -> bool:
        return self.tag in ("integer", "decimal", "double")


TERM, INTEGER, DECIMAL, DOUBLE, STRING, BOOLEAN, DATETIME = (Kind(t) for t in ("term", "integer", "decimal", "double", "string", "boolean", "dateTime"))
NATIVE = {k.tag: k for k in (INTEGER, DECIMAL, DOUBLE, STRING, BOOLEAN, DATETIME)}


@dataclass(frozen=True)
class Val:
    kind: Kind
    col: Column


def null() -> Val:
    return Val(TERM, F.lit(None).cast("string"))


def boolean(c: Column) -> Val:
    return Val(BOOLEAN, c)


def typed(lexical: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), lexical, F.lit(f'"^^<{T.XSD}{datatype}>'))


def term(v: Val) -> Column:
    """The canonical term string."""
    k, c = v.kind, v.col
    match k.tag:
        case "iri":
            return F.concat(F.lit("<" + k.prefix), c.cast("string"), F.lit(">"))
        case "integer":
            return typed(c.cast("string"), "integer")
        case "decimal":
            return typed(T.decimal_text(c), "decimal")
        case "double":
            return typed(T.double_text(c), "double")
        case "boolean":
            return typed(c.cast("string"), "boolean")
        case "dateTime":
            return typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")
        case "string":
            return F.concat(F.lit('"'), T.escape_col(c), F.lit('"'))
    return c


def native(v: Val) -> Column:
    """What a caller sees: numbers, texts, whole IRIs without brackets; generic terms by their lexical form."""
    match v.kind.tag:
        case "iri":
            return F.concat(F.lit(v.kind.prefix), v.col.cast("string"))
        case "decimal":
            return v.col.cast("double")
        case "integer":
            return v.col.try_cast("bigint")
        case "term":
            return F.when(T.is_literal(v.col), T.lexical_col(v.col)).when(T.is_iri_col(v.col), F.regexp_extract(v.col, "^<(.*)>$", 1)).otherwise(v.col)
    return v.col


def const(t: str) -> Val:
    """A constant, native where its datatype is."""
    lit = T.parse_literal(t)
    if lit is None or lit.lang:
        return Val(TERM, F.lit(t))
    kind = lit.datatype.removeprefix(T.XSD)
    try:
        if kind == "string":
            return Val(STRING, F.lit(lit.lexical))
        if kind == "integer" and -(1 << 63) <= int(lit.lexical) < 1 << 63:
            return Val(INTEGER, F.lit(int(lit.lexical)).cast("bigint"))
        if kind == "decimal":
            return Val(DECIMAL, F.lit(lit.lexical).cast("decimal(38,18)"))
        if kind == "double":
            return Val(DOUBLE, F.lit(float(lit.lexical.replace("INF", "inf"))))
        if kind == "boolean" and lit.lexical in ("true", "false"):
            return Val(BOOLEAN, F.lit(lit.lexical == "true"))
        if kind == "dateTime" and len(lit.lexical) == 19:
            return Val(DATETIME, F.lit(lit.lexical).cast("timestamp_ntz"))
    except ValueError:
        pass
    return Val(TERM, F.lit(t))


def ebv(v: Val) -> Column:
    """Effective boolean value; NULL for errors."""
    c = v.col
    match v.kind.tag:
        case "boolean":
            return c
        case "integer" | "decimal":
            return c != 0
        case "double":
            return (c != 0) & ~F.isnan(c)
        case "string":
            return c != ""
        case "iri" | "dateTime":
            return F.lit(None).cast("boolean")
    kind = T.datatype_col(c)
    lex = F.regexp_extract(c, T._LIT, 1)
    number = T.double_col(c)
    return (
        F.when(kind == T.XSD + "boolean", lex.isin("true", "1"))
        .when(kind == T.XSD + "string", lex != "")
        .when(T.local_type(c).isin(*T.INTEGERS, "decimal", "double", "float"), F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
    )


def text(v: Val) -> Column:
    """STR: lexical form or IRI."""
    match v.kind.tag:
        case "string":
            return v.col
        case "iri":
            return F.concat(F.lit(v.kind.prefix), v.col.cast("string"))
        case "term":
            c = v.col
            return F.when(T.is_literal(c), T.lexical_col(c)).when(T.is_iri_col(c), F.regexp_extract(c, "^<(.*)>$", 1)).when(T.is_blank_col(c), F.substring(c, 3, 1 << 30))
    return F.regexp_extract(term(v), T._LIT, 1)


def number(v: Val) -> Column:
    """The value as a double; NULL if it is none."""
    if v.kind.numeric:
        return v.col.try_cast("double")
    return T.double_col(v.col) if v.kind == TERM else F.lit(None).cast("double")


def equal(a: Val, b: Val) -> Column:
    ka, kb = a.kind, b.kind
    if ka.numeric and kb.numeric:
        return _same_number(a, b)
    if ka == kb and ka != TERM:
        return a.col == b.col
    if "iri" in (ka.tag, kb.tag):
        if ka.tag == kb.tag:
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if not _nested_prefix(ka, kb) else term(a) == term(b)
        return term(a) == term(b)
    if TERM not in (ka, kb):  # literals of different, known types: not comparable
        return F.lit(None).cast("boolean")
    if ka.numeric or kb.numeric:
        found, t = _number_and_term(a, b, lambda p, q: p == q)
        return F.when(~T.is_literal(t), F.lit(False)).when(found.isNotNull(), found).when(T.lang_col(t) != "", F.lit(False))
    if STRING in (ka, kb):
        t, other = (b.col, a) if kb == TERM else (a.col, b)
        return F.when(t == term(other), F.lit(True)).when(~T.is_literal(t) | (T.datatype_col(t).isin(T.XSD + "string", T.LANG_STRING)), F.lit(False))
    x, y = term(a), term(b)
    dx, dy = T.datatype_col(x), T.datatype_col(y)
    nx, ny = T.double_col(x), T.double_col(y)
    ex, ey = T.exact_col(x), T.exact_col(y)
    numbers = F.when(ex.isNotNull() & ey.isNotNull(), ex == ey).otherwise(nx == ny)
    both = T.is_literal(x) & T.is_literal(y)
    lang = T.LANG_STRING
    tags = (T.lexical_col(x) == T.lexical_col(y)) & (F.lower(T.lang_col(x)) == F.lower(T.lang_col(y)))
    return (
        F.when(x == y, F.when(T.is_literal(x) & T.local_type(x).isin("double", "float") & F.isnan(nx), F.lit(False)).otherwise(F.lit(True)))
        .when(~both, F.when(T.is_triple_col(x) & T.is_triple_col(y), x == y).otherwise(F.lit(False)))
        .when(nx.isNotNull() & ny.isNotNull(), numbers)
        .when((dx == lang) & (dy == lang), tags)
        .when((dx == dy) & (dx.isin(T.XSD + "string", T.XSD + "boolean", T.XSD + "dateTime", T.XSD + "date")), T.lexical_col(x) == T.lexical_col(y))
        .when((dx == lang) | (dy == lang), F.lit(False))
        .when((dx == dy), T.lexical_col(x) == T.lexical_col(y))
    )


def _number_and_term(a: Val, b: Val, f) -> tuple[Column, Column]:
    """f(a, b) for a native number and a generic term, NULL where the term is no number; and the term's column."""
    swap = a.kind == TERM
    n, t = (b, a) if swap else (a, b)
    f_ = (lambda x, y: f(y, x)) if swap else f
    double = T.double_col(t.col)
    by_double = F.when(~F.isnan(double), f_(n.col.try_cast("double"), double)).when(F.isnan(double), F.lit(False))
    if n.kind.tag == "double":
        return by_double, t.col
    exact = T.exact_col(t.col)
    return F.when(exact.isNotNull(), f_(n.col.try_cast("decimal(38,18)"), exact)).otherwise(by_double), t.col


def _nested_prefix(a: Kind, b: Kind) -> bool:
    return a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix)


def _same_number(a: Val, b: Val) -> Column:
    if "double" in (a.kind.tag, b.kind.tag):
        x, y = a.col.try_cast("double"), b.col.try_cast("double")
        return (x == y) & ~F.isnan(x)
    return a.col == b.col


def less(a: Val, b: Val) -> tuple[Column, Column]:
    """(a < b, a = b) for ordering operators; NULL where the two can't be ordered."""
    ka, kb = a.kind, b.kind
    if ka.numeric and kb.numeric:
        if "double" in (ka.tag, kb.tag):
            x, y = a.col.try_cast("double"), b.col.try_cast("double")
            ok = ~F.isnan(x) & ~F.isnan(y)
            return ok & (x < y), ok & (x == y)
        return a.col < b.col, a.col == b.col
    if ka == kb and ka.tag in ("string", "boolean", "dateTime"):
        return a.col < b.col, a.col == b.col
    if (ka.numeric or kb.numeric) and TERM in (ka, kb):
        return _number_and_term(a, b, lambda p, q: p < q)[0], _number_and_term(a, b, lambda p, q: p == q)[0]
    x, y = term(a), term(b)
    dx, dy = T.datatype_col(x), T.datatype_col(y)
    nx, ny = T.double_col(x), T.double_col(y)
    ex, ey = T.exact_col(x), T.exact_col(y)
    iris = T.is_iri_col(x) & T.is_iri_col(y)
    tagged = (dx == dy) & (F.lower(T.lang_col(x)) == F.lower(T.lang_col(y)))
    lx, ly = T.lexical_col(x), T.lexical_col(y)
    numeric = (nx.isNotNull() & ny.isNotNull())
    nan = F.isnan(nx) | F.isnan(ny)
    exact = ex.isNotNull() & ey.isNotNull()

    def by(f) -> Column:
        return F.when(numeric, F.when(exact, f(ex, ey)).otherwise(~nan & f(nx, ny))).when(iris, f(x, y)).when(tagged, f(lx, ly))

    return by(lambda p, q: p < q), by(lambda p, q: p == q)


def same_term(a: Val, b: Val) -> Column:
    if a.kind == b.kind and a.kind.tag != "double":
        return a.col == b.col
    return term(a) == term(b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    ka, kb = a.kind, b.kind
    if ka.numeric and kb.numeric:
        if "double" in (ka.tag, kb.tag):
            return Val(DOUBLE, _double_op(op, a.col.try_cast("double"), b.col.try_cast("double")))
        if op == "div":
            return Val(DECIMAL, _divide(a.col, b.col))
        if ka.tag == kb.tag == "integer":
            exact = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op]
            return Val(INTEGER, exact(a.col, b.col))
        return Val(DECIMAL, _exact_op(op, a.col.try_cast("decimal(38,18)"), b.col.try_cast("decimal(38,18)")))
    if ka.tag in ("string", "boolean", "dateTime", "iri") or kb.tag in ("string", "boolean", "dateTime", "iri"):
        return null()
    x, y = term(a), term(b)
    ix, iy, ex, ey, nx, ny = T.integer_col(x), T.integer_col(y), T.exact_col(x), T.exact_col(y), T.double_col(x), T.double_col(y)
    doubles = typed(T.double_text(_double_op(op, nx, ny)), "double")
    decimals = typed(T.decimal_text(_divide(ex, ey) if op == "div" else _exact_op(op, ex, ey)), "decimal")
    out = F.when(ex.isNotNull() & ey.isNotNull(), decimals).when(nx.isNotNull() & ny.isNotNull(), doubles)
    if op != "div":
        exact = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op]
        out = F.when(ix.isNotNull() & iy.isNotNull(), typed(exact(ix, iy).cast("string"), "integer")).otherwise(out)
    return Val(TERM, out)


def _exact_op(op: str, x: Column, y: Column) -> Column:
    exact = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op]
    if op == "mul":
        x, y = x.try_cast("decimal(28,9)"), y.try_cast("decimal(28,9)")
    return exact(x, y).try_cast("decimal(38,18)")


def _divide(x: Column, y: Column) -> Column:
    """Exact division to 16 significant digits or more; by zero, NULL."""
    return F.try_divide(x.try_cast("decimal(20,6)"), y.try_cast("decimal(20,6)")).try_cast("decimal(38,18)")


def _double_op(op: str, x: Column, y: Column) -> Column:
    if op == "div":  # infinite or not a number, as IEEE has it
        by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        return F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(F.try_divide(x, y))
    return {"add": x + y, "sub": x - y, "mul": x * y}[op]


def sort_keys(v: Val) -> list[Column]:
    """Columns whose order is SPARQL's: blank nodes, IRIs, numbers, other literals, triple terms; unbound is NULL."""
    if v.kind.tag in ("term",):
        c = v.col
        n = T.double_col(c)
        rank = F.when(c.isNull(), None).when(T.is_blank_col(c), 1).when(T.is_iri_col(c), 2).when(n.isNotNull(), 3).when(T.is_literal(c), 4).otherwise(5)
        return [rank, n, F.when(n.isNull(), c)]
    if v.kind.tag == "iri":
        return [term(v)]
    return [v.col]


def as_kind(v: Val, kind: Kind) -> Column:
    """The column in another kind that holds it: the same one, or TERM."""
    return v.col if v.kind == kind else term(v)


def common(a: Kind, b: Kind) -> Kind:
    return a if a == b else TERM


def is_term(v: Val, t: str) -> Column:
    """v is the term t, compared natively where t can have v's kind."""
    if v.kind.tag == "iri":
        key = t[1:-1].removeprefix(v.kind.prefix) if t.startswith("<" + v.kind.prefix) else ""
        if v.kind.text:
            return v.col == key if key else F.lit(False)
        return v.col == int(key) if key.isdigit() and len(key) < 19 else F.lit(False)
    if v.kind == TERM:
        return v.col == t
    c = const(t)
    return v.col == c.col if c.kind == v.kind else F.lit(False)
