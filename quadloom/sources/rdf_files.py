"""RDF files: N-Triples and N-Quads as distributed text scans, Turtle and TriG by a driver-side parser for small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..plans.parser import Parser
from ..plans import algebra as A

_FLAT = r'(?:<[^<> ]*>|_:[^\s<>"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'


def _term(depth: int) -> str:
    return _FLAT if depth == 0 else rf"(?:{_FLAT}|<<\s*{_term(depth - 1)}\s*<[^<> ]*>\s*{_term(depth - 1)}\s*>>)"


_LINE = rf"^\s*({_term(2)})\s*(<[^<> ]*>)\s*({_term(2)})\s*(<[^<> ]*>|_:[^\s<>\"]+)?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Triples or N-Quads files, one line each; comments, blank and malformed lines are passed over.

    Literals are put in canonical form where they are integers, decimals or booleans; other datatypes stay as written.
    """
    return parse_nquads(spark.read.text(path))


def parse_nquads(lines: DataFrame) -> DataFrame:
    """Quads of lines in a column ``value``."""
    m = lambda k: F.regexp_extract("value", _LINE, k)
    df = lines.select(m(1).alias("s"), m(2).alias("p"), m(3).alias("o"), m(4).alias("c")).where("s <> ''")
    return df.select("s", "p", canonical(F.col("o")).alias("o"), F.when(F.col("c") == "", F.lit(T.DEFAULT_GRAPH)).otherwise(F.col("c")).alias("c"))


def canonical(t):
    lex = F.regexp_extract(t, T._LIT, 1)
    kind = T.local_type(t)
    tail = F.concat(F.lit('"^^<'), T.datatype_col(t), F.lit(">"))
    integer = F.when(lex.rlike(r"^[+-]?\d{1,18}$"), lex.try_cast("bigint").cast("string"))
    decimal = F.when(lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), T.decimal_text(lex.try_cast("decimal(38,18)")))
    truth = F.when(F.lower(lex).isin("true", "1"), F.lit("true")).when(F.lower(lex).isin("false", "0"), F.lit("false"))
    double = F.when(lex.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), T.double_text(lex.try_cast("double")))
    new = F.when(kind.isin(*T.INTEGERS), integer).when(kind == "decimal", decimal).when(kind == "boolean", truth).when(kind.isin("double", "float"), double)
    plain = F.when(F.endswith(t, F.lit(f'^^<{T.XSD}string>')), F.regexp_replace(t, r"\^\^<[^>]*>$", ""))
    return F.when(T.is_literal(t), F.coalesce(F.concat(F.lit('"'), new, tail), plain, t)).otherwise(t)


def parse_turtle(text: str, base: str = "") -> list[tuple[str, str, str, str]]:
    """Quads of a small Turtle or TriG document, with triple terms and annotations; the query parser's triple grammar reads it."""
    p = Parser(text, base)
    p.in_template = True
    out: list[tuple[str, str, str, str]] = []

    def flush(found, graph: str) -> None:
        for q in found:
            out.append((_ground(q.s), _ground(q.p), _ground(q.o), graph))

    def block(graph: str) -> None:
        found: list[A.Pattern] = []
        subject = p.node(found, [])
        if p.text == "{" and graph == T.DEFAULT_GRAPH:
            p.next()
            while not p.accept("}"):
                if not p.accept("."):
                    block(subject)
            return
        if p.text not in (".", "}"):
            p.property_list(subject, found, [])
        flush(found, graph)

    while p.kind != "end":
        if p.accept("."):
            continue
        if p.kind == "lang" and p.text.lower() in ("@prefix", "@base") or p.word() in ("PREFIX", "BASE"):
            which = p.next().lstrip("@").upper()
            if which == "BASE":
                p.base = p.next()[1:-1]
            else:
                name = p.next()[:-1]
                p.prefixes[name] = p.resolve(p.next()[1:-1])
            continue
        if p.accept("GRAPH"):
            pass
        if p.text == "{":
            p.next()
            while not p.accept("}"):
                if not p.accept("."):
                    block(T.DEFAULT_GRAPH)
            continue
        block(T.DEFAULT_GRAPH)
    return out


def _ground(t) -> str:
    return T.triple_term(_ground(t.s), _ground(t.p), _ground(t.o)) if isinstance(t, A.TripleTerm) else t


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A small Turtle or TriG file; large data should come as N-Quads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_turtle(text), "s string, p string, o string, c string")


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def write_nquads(quads: DataFrame, path: str) -> None:
    nquads_lines(quads).write.text(path)


def nquads_lines(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("c") != T.DEFAULT_GRAPH, F.col("c"))
    return quads.select(F.concat_ws(" ", "s", "p", "o", graph, F.lit(".")).alias("value"))
