"""Expressions to columns: operators, the function library, and functions registered by IRI."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..errors import ParseError, UnsupportedError
from ..terms import XSD
from . import values as V
from .values import BOOLEAN, DECIMAL, DOUBLE, INTEGER, STRING, TERM, Val

#: Functions by IRI: each takes Vals and returns a Val.
REGISTERED: dict[str, Callable[..., Val]] = {}


def register_function(name: str, f: Callable[..., Val]) -> None:
    """Make ``<name>(...)`` available in expressions."""
    REGISTERED[name] = f


def string(c: Column) -> Val:
    return Val(STRING, c)


def _like(v: Val, out: Column) -> Val:
    """A text with the language tag or datatype of ``v``; NULL unless v is a plain or tagged string."""
    if v.kind == STRING:
        return Val(STRING, out)
    if v.kind != TERM:
        return V.null()
    dt = T.datatype_col(v.col)
    tail = F.when(dt == T.LANG_STRING, F.concat(F.lit("@"), T.lang_col(v.col))).when(dt == XSD + "string", F.lit(""))
    return Val(TERM, F.concat(F.lit('"'), T.escape_col(out), F.lit('"'), tail))


def _str(v: Val) -> Column:
    """Text of a string literal; NULL for others."""
    if v.kind == STRING:
        return v.col
    if v.kind != TERM:
        return F.lit(None).cast("string")
    return F.when(T.datatype_col(v.col).isin(T.LANG_STRING, XSD + "string"), T.lexical_col(v.col))


def _constant(e: tuple) -> str | None:
    if e[0] == "const":
        lit = T.parse_literal(e[1])
        return lit.lexical if lit else None
    return None


def _regex(args: list[Val], exprs: tuple) -> Val:
    flags = _constant(exprs[2]) if len(exprs) > 2 else ""
    pattern = _constant(exprs[1])
    if pattern is None or flags is None:
        if flags:
            flags = "".join(c for c in flags if c in "imsx")
        column = args[1].col if args[1].kind == STRING else T.lexical_col(V.term(args[1]))
        # a pattern from data may be malformed, which must not stop the query: only those made of ordinary parts are tried
        safe = column.rlike(r"^(?:[^\\\[\](){}*+?|]|\\[.\\dwsDWSbB^$|?*+(){}\[\]-]|(?<=[^*+?{(|^])[*+?])*$")
        return V.boolean(F.when(safe, _str(args[0]).rlike(F.concat(F.lit(f"(?{flags})" if flags else ""), F.when(safe, column).otherwise(F.lit(""))))))
    flags = "".join(c for c in flags if c in "imsx")
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", pattern))
    except re.error:
        if not _java_accepts(pattern):
            return V.boolean(F.lit(None).cast("boolean"))
    return V.boolean(_str(args[0]).rlike(f"(?{flags}){pattern}" if flags else pattern))


def _java_accepts(pattern: str) -> bool:
    from pyspark import SparkContext

    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001  py4j wraps PatternSyntaxException
        return False


def _replace(args: list[Val], exprs: tuple) -> Val:
    pattern, new = _constant(exprs[1]), _constant(exprs[2])
    flags = (_constant(exprs[3]) or "") if len(exprs) > 3 else ""
    if pattern is None or new is None:
        return _like(args[0], F.regexp_replace(_str(args[0]), _str(args[1]), _str(args[2])))
    if not _java_accepts(pattern):
        return V.null()
    return _like(args[0], F.regexp_replace(_str(args[0]), (f"(?{flags})" if flags else "") + pattern, new))


def _strbefore(a: Val, b: Val) -> Val:
    at = F.position(_str(b), _str(a))
    return _like(a, F.when(at > 0, F.substring(_str(a), F.lit(1), at - 1)).when(at.isNotNull(), F.lit("")))


def _strafter(a: Val, b: Val) -> Val:
    at = F.position(_str(b), _str(a))
    return _like(a, F.when(at > 0, F.substring(_str(a), at + F.length(_str(b)), F.lit(1 << 30))).when(at.isNotNull(), F.lit("")))


def _substr(a: Val, start: Val, *length: Val) -> Val:
    s = V.number(start).cast("int")
    first = F.greatest(s, F.lit(1))
    n = (V.number(length[0]).cast("int") + s - first) if length else F.lit(1 << 30)
    return _like(a, F.substring(_str(a), first, F.greatest(n, F.lit(0))))


def _concat(*args: Val) -> Val:
    return string(F.concat(*[_str(a) for a in args])) if args else string(F.lit(""))


def _rounded(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        if a.kind == INTEGER:
            return a
        if a.kind == DECIMAL:
            return Val(DECIMAL, f(a.col).try_cast("decimal(38,18)"))
        if a.kind == DOUBLE:
            return Val(DOUBLE, F.when(F.abs(a.col) < 2**52, f(a.col).cast("double")).otherwise(a.col))
        if a.kind != TERM:
            return V.null()
        t = a.col
        n, e = T.double_col(t), T.exact_col(t)
        return Val(
            TERM,
            F.when(T.integer_col(t).isNotNull(), t)
            .when(e.isNotNull(), V.typed(T.decimal_text(f(e).try_cast("decimal(38,18)")), "decimal"))
            .when(n.isNotNull(), V.typed(T.double_text(F.when(F.abs(n) < 2**52, f(n).cast("double")).otherwise(n)), "double")),
        )

    return run


_DATE = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?(Z|[+-]\d\d:\d\d)?$"


def _date_part(k: int) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        if a.kind == V.DATETIME:
            native = [F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second]
            if k == 6:
                return Val(DECIMAL, native[5](a.col).cast("decimal(38,18)"))
            return Val(INTEGER, native[k - 1](a.col).cast("bigint"))
        part = F.regexp_extract(T.lexical_col(V.term(a)), _DATE, k)
        part = F.when(T.local_type(V.term(a)).isin("dateTime", "date") & (part != ""), part)
        return Val(DECIMAL, part.try_cast("decimal(38,18)")) if k == 6 else Val(INTEGER, part.try_cast("bigint"))

    return run


def _tz(a: Val) -> Val:
    if a.kind == V.DATETIME:
        return string(F.when(a.col.isNotNull(), F.lit("")))
    return string(F.when(T.local_type(V.term(a)) == "dateTime", F.regexp_extract(T.lexical_col(V.term(a)), _DATE, 7)))


def _timezone(a: Val) -> Val:
    z = _tz(a).col
    sign = F.when(F.startswith(z, F.lit("-")), F.lit("-PT")).otherwise(F.lit("PT"))
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    text = F.when(z == "Z", F.lit("PT0S")).when(
        z != "", F.concat(sign, F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.when(hours == 0, F.lit("0S")).otherwise(F.lit(""))))
    )
    return Val(TERM, V.typed(text, "dayTimeDuration"))


def _iri(a: Val) -> Val:
    if a.kind.tag == "iri":
        return a
    t = V.term(a)
    return Val(TERM, F.when(T.is_iri_col(t), t).when(T.datatype_col(t) == XSD + "string", F.concat(F.lit("<"), T.lexical_col(t), F.lit(">"))))


def _datatype(a: Val) -> Val:
    if a.kind in (INTEGER, DECIMAL, DOUBLE, STRING, BOOLEAN, V.DATETIME):
        return Val(TERM, F.when(a.col.isNotNull(), F.lit(f"<{XSD}{a.kind.tag}>")))
    if a.kind.tag == "iri":
        return V.null()
    return Val(TERM, F.concat(F.lit("<"), T.datatype_col(a.col), F.lit(">")))


def _lang(a: Val) -> Val:
    if a.kind == TERM:
        return string(T.lang_col(a.col))
    return V.null() if a.kind.tag == "iri" else string(F.when(a.col.isNotNull(), F.lit("")))


def _langmatches(tag: Val, wanted: Val) -> Val:
    t, w = F.lower(_str(tag)), F.lower(_str(wanted))
    return V.boolean(F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))))


def _numeric(a: Val) -> Val:
    if a.kind.numeric:
        return V.boolean(F.when(a.col.isNotNull(), F.lit(True)))
    if a.kind != TERM:
        return V.boolean(F.when(a.col.isNotNull(), F.lit(False)))
    return V.boolean(F.when(a.col.isNotNull(), T.double_col(a.col).isNotNull()))


def _kind_test(native: Callable[[str], bool], test: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        if a.kind != TERM:
            return V.boolean(F.when(a.col.isNotNull(), F.lit(native(a.kind.tag))))
        return V.boolean(test(a.col))

    return run


def _cast(kind: str) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        s = V.text(a)
        match kind:
            case "string":
                return string(s)
            case "integer":
                if a.kind.numeric:
                    return Val(INTEGER, a.col.try_cast("bigint"))
                return Val(INTEGER, F.coalesce(F.when(s == "true", F.lit(1)).when(s == "false", F.lit(0)), F.when(s.rlike(r"^\s*[+-]?\d+\s*$"), s.try_cast("bigint")), V.number(a).try_cast("bigint")))
            case "decimal":
                return Val(DECIMAL, s.try_cast("decimal(38,18)"))
            case "double" | "float":
                return Val(DOUBLE, s.try_cast("double"))
            case "boolean":
                return V.boolean(F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False)).otherwise(V.number(a) != 0))
        return Val(TERM, F.when(s.rlike(_DATE), V.typed(s, kind)))

    return run


def _hash(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda a: string(f(F.encode(_str(a), "UTF-8")))


def _encode(a: Val) -> Val:
    out = F.url_encode(_str(a))
    for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return string(out)


_LIBRARY: dict[str, Callable[..., Val]] = {
    "str": lambda a: string(V.text(a)),
    "lang": _lang,
    "datatype": _datatype,
    "langmatches": _langmatches,
    "sameterm": lambda a, b: V.boolean(V.same_term(a, b)),
    "isiri": _kind_test(lambda t: t == "iri", T.is_iri_col),
    "isuri": _kind_test(lambda t: t == "iri", T.is_iri_col),
    "isblank": _kind_test(lambda t: False, T.is_blank_col),
    "isliteral": _kind_test(lambda t: t != "iri", T.is_literal),
    "istriple": _kind_test(lambda t: False, T.is_triple_col),
    "isnumeric": _numeric,
    "subject": lambda a: Val(TERM, T.part_col(V.term(a), 1)),
    "predicate": lambda a: Val(TERM, T.part_col(V.term(a), 2)),
    "object": lambda a: Val(TERM, T.part_col(V.term(a), 3)),
    "triple": lambda a, b, c: Val(TERM, F.concat(F.lit("<< "), V.term(a), F.lit(" "), V.term(b), F.lit(" "), V.term(c), F.lit(" >>"))),
    "strlen": lambda a: Val(INTEGER, F.length(_str(a)).cast("bigint")),
    "substr": _substr,
    "ucase": lambda a: _like(a, F.upper(_str(a))),
    "lcase": lambda a: _like(a, F.lower(_str(a))),
    "strstarts": lambda a, b: V.boolean(F.startswith(_str(a), _str(b))),
    "strends": lambda a, b: V.boolean(F.endswith(_str(a), _str(b))),
    "contains": lambda a, b: V.boolean(F.contains(_str(a), _str(b))),
    "strbefore": _strbefore,
    "strafter": _strafter,
    "concat": _concat,
    "encode_for_uri": _encode,
    "abs": lambda a: _absolute(a),
    "round": _rounded(lambda c: F.floor(c + F.expr("0.5BD"))),
    "ceil": _rounded(F.ceil),
    "floor": _rounded(F.floor),
    "rand": lambda: Val(DOUBLE, F.rand()),
    "now": lambda: Val(TERM, V.typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")),
    "year": _date_part(1),
    "month": _date_part(2),
    "day": _date_part(3),
    "hours": _date_part(4),
    "minutes": _date_part(5),
    "seconds": _date_part(6),
    "tz": _tz,
    "timezone": _timezone,
    "md5": _hash(F.md5),
    "sha1": _hash(F.sha1),
    "sha256": _hash(lambda c: F.sha2(c, 256)),
    "sha384": _hash(lambda c: F.sha2(c, 384)),
    "sha512": _hash(lambda c: F.sha2(c, 512)),
    "iri": _iri,
    "uri": _iri,
    "bnode": lambda *a: Val(TERM, F.concat(F.lit("_:b"), F.md5(F.encode(_str(a[0]), "UTF-8")) if a else F.replace(F.uuid(), F.lit("-"), F.lit("")))),
    "strdt": lambda a, b: Val(TERM, F.concat(F.lit('"'), T.escape_col(_str(a)), F.lit('"^^'), V.term(b))),
    "strlang": lambda a, b: Val(TERM, F.concat(F.lit('"'), T.escape_col(_str(a)), F.lit('"@'), _str(b))),
    "uuid": lambda: Val(TERM, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
    "struuid": lambda: string(F.uuid()),
}


def _absolute(a: Val) -> Val:
    if a.kind.numeric:
        return Val(a.kind, F.when(a.col < 0, V.arithmetic("sub", Val(a.kind, F.lit(0).cast({"integer": "bigint", "decimal": "decimal(38,18)", "double": "double"}[a.kind.tag])), a).col).otherwise(a.col))
    if a.kind != TERM:
        return V.null()
    lex = F.regexp_extract(a.col, T._LIT, 1)
    return Val(TERM, F.when(T.double_col(a.col).isNotNull(), F.when(F.startswith(lex, F.lit("-")), F.concat(F.lit('"'), F.substring(a.col, 3, 1 << 30))).otherwise(a.col)))


_CASTS = {XSD + k: _cast(k) for k in ("string", "integer", "decimal", "double", "float", "boolean", "dateTime", "date")}


def compile_expr(e: tuple, scope: dict[str, Val]) -> Val:
    """A Val for an expression whose EXISTS parts and aggregates have been taken out already."""
    op, *args = e
    if op == "var":
        return scope.get(args[0], V.null())
    if op == "const":
        return V.const(args[0])
    if op == "bound":
        v = scope.get(args[0][1])
        return V.boolean(v.col.isNotNull() if v is not None else F.lit(False))
    if op == "in":
        negated, x, options = args
        return _member(negated, compile_expr(x, scope), [compile_expr(o, scope) for o in options])
    if op == "call":
        name, *rest = args
        vals = [compile_expr(a, scope) for a in rest]
        if name in _CASTS:
            return _CASTS[name](*vals)
        if name in REGISTERED:
            return REGISTERED[name](*vals)
        raise UnsupportedError(f"unknown function <{name}>")
    if op in ("agg", "exists", "insub"):
        raise UnsupportedError(f"{op} is not allowed here")
    vals = [compile_expr(a, scope) for a in args]
    match op:
        case "and":
            return V.boolean(V.ebv(vals[0]) & V.ebv(vals[1]))
        case "or":
            return V.boolean(V.ebv(vals[0]) | V.ebv(vals[1]))
        case "not":
            return V.boolean(~V.ebv(vals[0]))
        case "eq":
            return V.boolean(V.equal(*vals))
        case "ne":
            return V.boolean(~V.equal(*vals))
        case "lt":
            return V.boolean(V.less(*vals)[0])
        case "gt":
            return V.boolean(V.less(vals[1], vals[0])[0])
        case "le":
            lt, eq = V.less(*vals)
            return V.boolean(lt | eq)
        case "ge":
            lt, eq = V.less(vals[1], vals[0])
            return V.boolean(lt | eq)
        case "add" | "sub" | "mul" | "div":
            return V.arithmetic(op, *vals)
        case "neg":
            return V.arithmetic("sub", V.const(T.literal("0", XSD + "integer")), vals[0])
        case "coalesce":
            kind = vals[0].kind
            for v in vals[1:]:
                kind = V.common(kind, v.kind)
            return Val(kind, F.coalesce(*[V.as_kind(v, kind) for v in vals]))
        case "if":
            c = V.ebv(vals[0])
            kind = V.common(vals[1].kind, vals[2].kind)
            return Val(kind, F.when(c, V.as_kind(vals[1], kind)).when(~c, V.as_kind(vals[2], kind)))
        case "regex":
            return _regex(vals, tuple(args))
        case "replace":
            return _replace(vals, tuple(args))
    if op not in _LIBRARY:
        raise ParseError(f"unknown function {op}")
    try:
        return _LIBRARY[op](*vals)
    except TypeError as err:
        raise ParseError(f"wrong arguments for {op}: {err}") from err


def _member(negated: bool, x: Val, options: list[Val]) -> Val:
    if not options:
        return V.boolean(F.lit(negated))
    out = V.equal(x, options[0])
    for o in options[1:]:
        out = out | V.equal(x, o)
    return V.boolean(~out if negated else out)
