"""RDF terms: canonical N-Triples strings, their Python codec, and Column functions over them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = f"<{RDF}type>"
LANG_STRING = RDF + "langString"
INTEGERS = frozenset(
    "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
)
#: Stands for the graph without a name; no user data can hold it, since it is no IRI.
DEFAULT_GRAPH = "urn-less:default"

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}


def escape(text: str) -> str:
    return re.sub(r'[\\"\n\r]', lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        return {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


def canonical_lexical(lexical: str, datatype: str) -> str:
    """The form in which a literal is stored; an invalid one stays as it is."""
    kind = datatype.removeprefix(XSD) if datatype.startswith(XSD) else ""
    try:
        if kind in INTEGERS and re.fullmatch(r"[+-]?\d+", lexical):
            n = int(lexical)
            return str(n) if -(1 << 63) <= n < 1 << 63 else lexical
        if kind == "decimal" and re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)", lexical):
            return plain_decimal(Decimal(lexical))
        if kind in ("double", "float"):
            return canonical_double(lexical)
        if kind == "boolean":
            return {"1": "true", "0": "false"}.get(lexical, lexical.lower() if lexical.lower() in ("true", "false") else lexical)
    except (ValueError, InvalidOperation):
        pass
    return lexical


def plain_decimal(d: Decimal) -> str:
    text = format(d, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def canonical_double(lexical: str) -> str:
    if lexical in ("INF", "-INF", "NaN", "+INF"):
        return lexical.lstrip("+")
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", lexical):
        return lexical
    d = float(lexical)
    if d in (float("inf"), float("-inf")):
        return lexical
    if d == int(d) and abs(d) < 1e15:
        return f"{d:.1f}"
    mantissa, _, exponent = repr(d).partition("e")
    if not exponent and 1e-3 <= abs(d) < 1e7:
        return mantissa
    digits = Decimal(repr(d)).as_tuple()
    text = "".join(map(str, digits.digits)).rstrip("0") or "0"
    power = len(digits.digits) - 1 + digits.exponent
    return f"{'-' if digits.sign else ''}{text[0]}.{text[1:] or '0'}E{power}"


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lexical: str, datatype: str | None = None, lang: str | None = None) -> str:
    if lang:
        return f'"{escape(lexical)}"@{lang}'
    if datatype and datatype != XSD + "string":
        return f'"{escape(canonical_lexical(lexical, datatype))}"^^<{datatype}>'
    return f'"{escape(lexical)}"'


def triple_term(s: str, p: str, o: str) -> str:
    return f"<< {s} {p} {o} >>"


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str
    lang: str


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?', re.S)


def parse_literal(term: str) -> Literal | None:
    """Read from the front, so that quotes and marks inside the text don't matter."""
    m = _LITERAL.fullmatch(term)
    if not m:
        return None
    return Literal(unescape(m[1]), m[3] or (LANG_STRING if m[2] else XSD + "string"), m[2] or "")


def is_triple(term: str) -> bool:
    return term.startswith("<< ")


# ---- Column functions; every one gives NULL where SPARQL has an unbound value or an error.

_FLAT = r'(?:<[^<> ]*>|_:[^ ]+|"(?:[^"\\\\]|\\\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'.replace("\\\\\\\\", "\\\\")


_TOKEN = rf"<<(?= )|>>|{_FLAT}"
_LIT = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def is_literal(t: Column) -> Column:
    return F.startswith(t, F.lit('"'))


def is_triple_col(t: Column) -> Column:
    return F.startswith(t, F.lit("<< "))


def is_iri_col(t: Column) -> Column:
    return F.startswith(t, F.lit("<")) & ~is_triple_col(t)


def is_blank_col(t: Column) -> Column:
    return F.startswith(t, F.lit("_:"))


def unescape_col(x: Column) -> Column:
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\u0000")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\u0000"), F.lit("\\"))
    return F.when(F.contains(x, F.lit("\\")), plain).otherwise(x)


def escape_col(x: Column) -> Column:
    marked = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(x.rlike('[\\\\"\\n\\r]'), marked).otherwise(x)


def lexical_col(t: Column) -> Column:
    return F.when(is_literal(t), unescape_col(F.regexp_extract(t, _LIT, 1)))


def lang_col(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LIT, 2))


def datatype_col(t: Column) -> Column:
    dt = F.regexp_extract(t, _LIT, 3)
    return F.when(is_literal(t), F.when(dt != "", dt).when(F.regexp_extract(t, _LIT, 2) != "", F.lit(LANG_STRING)).otherwise(F.lit(XSD + "string")))


def local_type(t: Column) -> Column:
    """The name of an XSD datatype, or NULL."""
    dt = datatype_col(t)
    return F.when(F.startswith(dt, F.lit(XSD)), F.substring(dt, len(XSD) + 1, 100))


def _numeric(*kinds: str) -> str:
    return rf"^\"([^\"]*)\"\^\^<{re.escape(XSD)}(?:{'|'.join(sorted(kinds))})>$"


_EXACT, _INTEGER, _NUMBER = _numeric(*INTEGERS, "decimal"), _numeric(*INTEGERS), _numeric(*INTEGERS, "decimal", "double", "float")


# Each of these names the term once, so that conditions on derived terms stay small.


def exact_col(t: Column) -> Column:
    """Value of integers and decimals."""
    return F.regexp_extract(t, _EXACT, 1).try_cast("decimal(38,18)")


def integer_col(t: Column) -> Column:
    return F.regexp_extract(t, _INTEGER, 1).try_cast("decimal(38,0)")


def double_col(t: Column) -> Column:
    """Value of any numeric literal as a double."""
    return F.regexp_extract(t, _NUMBER, 1).try_cast("double")


def parts_col(t: Column) -> Column:
    """(a, b, c): subject, predicate and object of a triple term at any depth of nesting, NULL for what is none.

    The term's tokens are folded once from the left; a part ends wherever the depth is one again.
    """
    zero = F.lit(0)
    start = F.struct(zero.alias("depth"), zero.alias("k"), *[F.lit("").alias(x) for x in "abc"])

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x == "<<", 1).when(x == ">>", -1).otherwise(0)
        inner = (acc["depth"] > 0) & (depth > 0)
        add = lambda n, name: F.when(inner & (acc["k"] == n), F.concat(acc[name], F.when(acc[name] == "", "").otherwise(" "), x)).otherwise(acc[name])
        k = acc["k"] + F.when(inner & (depth == 1), 1).otherwise(0)
        return F.struct(depth.alias("depth"), k.alias("k"), *[add(n, name).alias(name) for n, name in enumerate("abc")])

    def finish(acc: Column) -> Column:
        return F.when((acc["depth"] == 0) & (acc["k"] == 3), F.struct(*[acc[x].alias(x) for x in "abc"]))

    return F.when(is_triple_col(t), F.aggregate(F.regexp_extract_all(t, F.lit(_TOKEN), zero), start, step, finish))


def part_col(t: Column, k: int) -> Column:
    """Subject, predicate or object (1 to 3) of a triple term."""
    return parts_col(t)["abc"[k - 1]]


def split_triple(term: str) -> tuple[str, str, str]:
    """The parts of a triple term; quotes inside nested terms don't matter."""
    depth, parts, current = 0, [], []
    for x in re.findall(_TOKEN, term):
        before, depth = depth, depth + {"<<": 1, ">>": -1}.get(x, 0)
        if before and depth:
            current.append(x)
            if depth == 1:
                parts.append(" ".join(current))
                current = []
    if depth or len(parts) != 3:
        raise ValueError(f"not a triple term: {term}")
    return tuple(parts)


def double_text(d: Column) -> Column:
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    return (
        F.when(F.isnan(d), F.lit("NaN")).when(d == F.lit(float("inf")), F.lit("INF")).when(d == F.lit(float("-inf")), F.lit("-INF"))
        .when(whole, F.concat(F.when(F.isnan(d) | ~whole, F.lit(0.0)).otherwise(d).try_cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))
    )


def decimal_text(d: Column) -> Column:
    text = d.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
