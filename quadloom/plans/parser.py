"""A recursive-descent parser for SPARQL queries and updates, with property paths and triple terms."""

from __future__ import annotations

import itertools
import re
from typing import Any

from ..errors import ParseError, UnsupportedError
from ..terms import RDF, RDF_TYPE, XSD, iri, literal, triple_term
from . import algebra as A

_TOKEN = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)
  |(?P<star><<|>>|\{\||\|\})
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<str>\"{3}(?:(?:"|"")?(?:[^"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<var>[?$][A-Za-z0-9_]+)
  |(?P<bnode>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
  |(?P<pname>(?:[A-Za-z](?:[\w.-]*[\w-])?)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?|\\[_~.\-!$&'()*+,;=/?#@%])*)
  |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>+\-*/!|^?])
""",
    re.X | re.S,
)

_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_COMPARE = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


class Parser:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None):
        self.base, self.prefixes = base, dict(prefixes or {})
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0
        self.fresh = (f"_f{k}" for k in itertools.count())
        self.bnodes: dict[str, str] = {}
        self.in_template = False

    # -- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def text(self) -> str:
        return self.tokens[self.i][1]

    def word(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def accept(self, *options: str) -> str | None:
        if self.kind in ("op", "star") and self.text in options or self.kind == "word" and self.text.upper() in options:
            return self.next().upper()
        return None

    def expect(self, *options: str) -> str:
        got = self.accept(*options)
        if got is None:
            raise ParseError(f"expected {' or '.join(options)}, found {self.text or 'the end'!r}")
        return got

    # -- entry points

    def prologue(self) -> None:
        while self.word() in ("PREFIX", "BASE"):
            if self.next().upper() == "BASE":
                self.base = self.next()[1:-1]
            else:
                name = self.next()
                if not name.endswith(":"):
                    raise ParseError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = self.resolve(self.next()[1:-1])

    def query(self) -> A.Query:
        self.prologue()
        form = self.word()
        template: tuple = ()
        describe: tuple = ()
        if form == "SELECT":
            shape = self.select_clause()
        elif form == "ASK":
            self.next()
        elif form == "CONSTRUCT":
            self.next()
            if self.text == "{":
                template = self.template()
        elif form == "DESCRIBE":
            self.next()
            terms = []
            if not self.accept("*"):
                while self.kind in ("var", "iri", "pname"):
                    terms.append(self.term())
            describe = tuple(terms)
        else:
            raise ParseError(f"unknown query form {self.text!r}")
        from_, named = [], []
        while self.accept("FROM"):
            (named if self.accept("NAMED") else from_).append(self.term())
        short = form == "CONSTRUCT" and not template
        has_where = bool(self.accept("WHERE"))
        if short:
            at = self.i
            template = self.template()
            self.i = at
        plan = self.group() if has_where or self.text == "{" else A.Unit()
        if form == "SELECT":
            plan = self.finish_select(plan, *shape)
        else:
            plan = self.modifiers(plan)
        if self.word() == "VALUES":
            plan = A.Join(plan, self.values())
        if form == "DESCRIBE" and not describe:
            describe = tuple(f"?{v}" for v in sorted(A.possible(plan)) if not v.startswith("_"))
        if self.kind != "end":
            raise ParseError(f"unexpected {self.text!r} after the query")
        return A.Query(form.lower(), plan, template, describe, tuple(from_), tuple(named))

    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out += self.update()
            if not self.accept(";") and self.kind != "end":
                raise ParseError(f"unexpected {self.text!r} after an update")

    def update(self) -> list[A.Update]:
        w = self.expect("INSERT", "DELETE", "WITH", "CLEAR", "DROP", "CREATE", "LOAD", "COPY", "MOVE", "ADD")
        if w == "LOAD":
            raise UnsupportedError("LOAD reads from the network; load files through the sources instead")
        if w in ("CLEAR", "DROP", "CREATE"):
            self.accept("SILENT")
            target = self.graph_ref()
            return [] if w == "CREATE" else [A.Update("clear", target=target)]
        if w in ("COPY", "MOVE", "ADD"):
            self.accept("SILENT")
            a = self.graph_ref()
            self.expect("TO")
            return [A.Update(w.lower(), source=a, target=self.graph_ref())]
        graph = None
        if w == "WITH":
            graph = self.term()
            w = self.expect("INSERT", "DELETE")
        if self.accept("DATA"):
            quads = self.template(graph)
            return [A.Update("insert_data", insert=quads) if w == "INSERT" else A.Update("delete_data", delete=quads)]
        delete: tuple = ()
        insert: tuple = ()
        if w == "DELETE" and self.accept("WHERE"):
            at = self.i
            delete = self.template(graph)
            self.i = at
            where: A.Node = self.group()
            return [A.Update("modify", delete=delete, where=A.Graph(graph, where) if graph else where)]
        if w == "DELETE":
            delete = self.template(graph)
            if self.accept("INSERT"):
                insert = self.template(graph)
        else:
            insert = self.template(graph)
        while self.accept("USING"):
            self.accept("NAMED")
            graph = self.term()
        self.expect("WHERE")
        where = self.group()
        return [A.Update("modify", delete=delete, insert=insert, where=A.Graph(graph, where) if graph else where)]

    def graph_ref(self) -> str:
        w = self.accept("DEFAULT", "NAMED", "ALL")
        if w:
            return w.lower()
        self.accept("GRAPH")
        return self.term()

    # -- select

    def select_clause(self) -> tuple:
        self.next()
        distinct = bool(self.accept("DISTINCT", "REDUCED"))
        items: list[tuple[str, tuple | None]] | None = []
        if self.accept("*"):
            return distinct, None
        while True:
            if self.kind == "var":
                items.append((self.next()[1:], None))
            elif self.accept("("):
                e = self.expression()
                self.expect("AS")
                items.append((self.next()[1:], e))
                self.expect(")")
            else:
                break
        if not items:
            raise ParseError("SELECT names nothing")
        return distinct, items

    def finish_select(self, plan: A.Node, distinct: bool, items) -> A.Node:
        keys: list[str] = []
        grouped = False
        if self.accept("GROUP"):
            self.expect("BY")
            grouped = True
            while self.kind == "var" or self.text == "(" or self.kind in ("iri", "pname") or self.kind == "word" and self.word() not in ("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                if self.kind == "var":
                    keys.append(self.next()[1:])
                    continue
                bracket = self.text == "("
                if bracket:
                    self.next()
                e = self.expression()
                name = next(self.fresh)
                if bracket:
                    if self.accept("AS"):
                        name = self.next()[1:]
                    self.expect(")")
                plan = A.Extend(plan, name, e)
                keys.append(name)
        having = []
        if self.accept("HAVING"):
            while self.text == "(" or self.kind == "word" and self.word() not in ("ORDER", "LIMIT", "OFFSET", "VALUES"):
                having.append(self.primary())
        order = self.order_by()
        aggs: dict[tuple, str] = {}

        def lift(e: Any) -> Any:
            """Replace aggregates by variables of the group."""
            if isinstance(e, tuple) and e and e[0] == "agg":
                return ("var", aggs.setdefault(e, f"_a{len(aggs)}"))
            if isinstance(e, (tuple, list)) and not (e and e[0] in ("const", "var")):
                return type(e)(lift(x) for x in e)
            return e

        extends = [(v, lift(e)) for v, e in items or () if e is not None]
        having = [lift(h) for h in having]
        order = [(lift(e), asc) for e, asc in order]
        if grouped or aggs:
            plan = A.Group(plan, tuple(keys), tuple((name, agg) for agg, name in aggs.items()))
        for h in having:
            plan = A.Filter(plan, h)
        for v, e in extends:
            plan = A.Extend(plan, v, e)
        vars_ = tuple(v for v, _ in items) if items is not None else tuple(sorted(v for v in A.possible(plan) if not v.startswith("_")))
        if distinct and order:
            hidden = tuple(sorted(set().union(*(A.expr_vars(e) for e, _ in order)) - set(vars_)))
            if hidden:  # keys outside the projection: a distinct row stands where its first solution does
                keys_ = tuple((f"_o{k}", ("agg", "min" if asc else "max", False, e, "")) for k, (e, asc) in enumerate(order))
                ranked = A.OrderBy(A.Group(plan, vars_, keys_), tuple((("var", f"_o{k}"), asc) for k, (_, asc) in enumerate(order)))
                plan = A.Project(ranked, vars_)
            else:
                plan = A.OrderBy(A.Distinct(A.Project(plan, vars_)), tuple(order))
        else:
            if order:
                plan = A.OrderBy(plan, tuple(order))
            plan = A.Project(plan, vars_)
            if distinct:
                plan = A.Distinct(plan)
        return self.slice(plan)

    def order_by(self) -> list:
        keys = []
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                w = self.accept("ASC", "DESC")
                if w or self.text == "(" or self.kind == "var" or self.kind in ("iri", "pname") or self.kind == "word" and self.word() not in ("LIMIT", "OFFSET", "VALUES"):
                    keys.append((self.primary(), w != "DESC"))
                else:
                    break
        return keys

    def modifiers(self, plan: A.Node) -> A.Node:
        order = self.order_by()
        if order:
            plan = A.OrderBy(plan, tuple(order))
        return self.slice(plan)

    def slice(self, plan: A.Node) -> A.Node:
        offset, limit = 0, None
        while w := self.accept("LIMIT", "OFFSET"):
            n = int(self.next())
            if w == "LIMIT":
                limit = n
            else:
                offset = n
        return A.Slice(plan, offset, limit) if offset or limit is not None else plan

    # -- group patterns

    def group(self) -> A.Node:
        self.expect("{")
        if self.word() == "SELECT":
            plan = self.finish_select_sub()
            self.expect("}")
            return plan
        plan: A.Node = A.Unit()
        filters = []

        def join(a: A.Node, b: A.Node) -> A.Node:
            if isinstance(a, A.Unit):
                return b
            if isinstance(a, A.BGP) and isinstance(b, A.BGP):
                return A.BGP(a.patterns + b.patterns)
            if isinstance(a, A.Join) and isinstance(a.right, A.BGP) and isinstance(b, A.BGP):
                return A.Join(a.left, A.BGP(a.right.patterns + b.patterns))
            return A.Join(a, b)

        while not self.accept("}"):
            if self.accept("."):
                continue
            w = self.word()
            if w == "FILTER":
                self.next()
                filters.append(self.primary())
            elif w == "OPTIONAL":
                self.next()
                right = self.group()
                if isinstance(right, A.Filter):
                    plan = A.LeftJoin(plan, right.sub, right.condition)
                else:
                    plan = A.LeftJoin(plan, right)
            elif w == "MINUS":
                self.next()
                plan = A.Minus(plan, self.group())
            elif w == "BIND":
                self.next()
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                v = self.next()[1:]
                if v in A.possible(plan):
                    raise ParseError(f"BIND of ?{v}, which is in scope")
                plan = A.Extend(plan, v, e)
                self.expect(")")
            elif w == "VALUES":
                plan = join(plan, self.values())
            elif w == "GRAPH":
                self.next()
                g = self.term()
                plan = join(plan, A.Graph(g, self.group()))
            elif w == "SERVICE":
                raise UnsupportedError("SERVICE is not supported")
            elif self.text == "{":
                sub = self.group()
                while self.accept("UNION"):
                    sub = A.Union(sub, self.group())
                plan = join(plan, sub)
            else:
                for part in self.triples():
                    plan = join(plan, part)
        if filters:
            condition = filters[0]
            for f in filters[1:]:
                condition = ("and", condition, f)
            plan = A.Filter(plan, condition)
        return plan

    def finish_select_sub(self) -> A.Node:
        distinct, items = self.select_clause()
        self.accept("WHERE")
        plan = self.finish_select(self.group(), distinct, items)
        if self.word() == "VALUES":
            plan = A.Join(plan, self.values())
        return plan

    def values(self) -> A.Values:
        self.next()
        names, rows = [], []
        if self.accept("("):
            while self.kind == "var":
                names.append(self.next()[1:])
            self.expect(")")
            self.expect("{")
            while self.accept("("):
                row = []
                while not self.accept(")"):
                    row.append(None if self.accept("UNDEF") else self.term())
                rows.append(tuple(row))
        else:
            names.append(self.next()[1:])
            self.expect("{")
            while self.text != "}":
                rows.append((None if self.accept("UNDEF") else self.term(),))
        self.expect("}")
        if any(len(r) != len(names) for r in rows):
            raise ParseError("VALUES rows and variables differ in number")
        return A.Values(tuple(names), tuple(rows))

    def triples(self) -> list[A.Node]:
        """One subject's property list: a BGP, path patterns, decompositions of triple terms."""
        out: list[A.Pattern] = []
        paths: list[A.Node] = []
        if self.text == "<<":
            subject = self.term(out)
            if self.text in (".", "}"):
                return self.shaped(out + [A.Pattern(subject, None, None)], paths)
        else:
            subject = self.node(out, paths)
        if self.text not in (".", "}") or self.kind == "num":
            self.property_list(subject, out, paths)
        return self.shaped(out, paths)

    def shaped(self, patterns: list[A.Pattern], paths: list[A.Node]) -> list[A.Node]:
        plain, parts = [], []
        for p in patterns:
            terms = []
            for t in (p.s, p.p, p.o):
                if isinstance(t, A.TripleTerm) and A.term_vars(t):
                    v = next(self.fresh)
                    parts.append((v, t))
                    t = f"?{v}"
                elif isinstance(t, A.TripleTerm):
                    t = self.ground(t)
                terms.append(t)
            if terms[1] is None:
                continue
            plain.append(A.Pattern(*terms))
        node: A.Node | None = A.BGP(tuple(plain)) if plain else None
        while parts:
            v, t = parts.pop(0)
            flat = []
            for x in (t.s, t.p, t.o):
                if isinstance(x, A.TripleTerm):
                    if A.term_vars(x):
                        w = next(self.fresh)
                        parts.append((w, x))
                        x = f"?{w}"
                    else:
                        x = self.ground(x)
                flat.append(x)
            if node is None:  # a triple term alone: any that occurs
                node = A.Union(A.BGP((A.Pattern(f"?{v}", f"?{next(self.fresh)}", f"?{next(self.fresh)}"),)), A.BGP((A.Pattern(f"?{next(self.fresh)}", f"?{next(self.fresh)}", f"?{v}"),)))
            node = A.Decompose(node, v, tuple(flat))
        return ([node] if node is not None else []) + paths

    def ground(self, t: Any) -> str:
        return triple_term(self.ground(t.s), self.ground(t.p), self.ground(t.o)) if isinstance(t, A.TripleTerm) else t

    def property_list(self, subject: Any, out: list[A.Pattern], paths: list[A.Node]) -> None:
        while True:
            if self.text in (".", "}", "]", ")", "|}") and self.kind in ("op", "star"):
                return
            path = None
            if self.kind == "var":
                predicate = self.term()
            else:
                path = self.path()
                predicate = path[1] if path[0] == "iri" else None
            while True:
                o = self.node(out, paths)
                if predicate is None:
                    if isinstance(subject, A.TripleTerm) or isinstance(o, A.TripleTerm):
                        subject, o = self.ground(subject), self.ground(o)
                    paths.append(A.PathPattern(subject, path, o))
                else:
                    out.append(A.Pattern(subject, predicate, o))
                while self.text == "{|":
                    self.next()
                    self.property_list(A.TripleTerm(subject, predicate, o), out, paths)
                    self.expect("|}")
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass

    def node(self, out: list[A.Pattern], paths: list[A.Node]) -> Any:
        """A term, a bracketed blank node or a list."""
        if self.accept("["):
            v = self.blank()
            self.property_list(v, out, paths)
            self.expect("]")
            return v
        if self.accept("("):
            items = []
            while not self.accept(")"):
                items.append(self.node(out, paths))
            head = iri(RDF + "nil")
            for item in reversed(items):
                v = self.blank()
                out += [A.Pattern(v, iri(RDF + "first"), item), A.Pattern(v, iri(RDF + "rest"), head)]
                head = v
            return head
        return self.term(out)

    def blank(self, label: str = "") -> str:
        if self.in_template:
            return f"_:{label or next(self.fresh)}"
        if not label:
            return f"?{next(self.fresh)}"
        return self.bnodes.setdefault(label, f"?{next(self.fresh)}")

    # -- terms

    def resolve(self, value: str) -> str:
        from urllib.parse import urljoin

        return urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", value) else value

    def term(self, out: list | None = None) -> Any:
        kind, text = self.kind, self.text
        if kind == "star" and text == "<<":
            self.next()
            bracket = self.accept("(")
            s, p, o = self.term(out), self.verb(), self.term(out)
            if bracket:
                self.expect(")")
            self.expect(">>")
            t = A.TripleTerm(s, p, o)
            return t if A.term_vars(t) else self.ground(t)
        if kind == "op" and text in "+-" and self.tokens[self.i + 1][0] == "num":
            self.next()
            return self.number(text + self.next())
        self.next()
        if kind == "var":
            return "?" + text[1:]
        if kind == "iri":
            return iri(self.resolve(text[1:-1]))
        if kind == "pname":
            return self.pname(text)
        if kind == "bnode":
            return self.blank(text[2:])
        if kind == "num":
            return self.number(text)
        if kind == "str":
            from ..terms import unescape

            body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
            value = unescape(body)
            if self.kind == "lang":
                return literal(value, lang=self.next()[1:])
            if self.accept("^^"):
                dt = self.term()
                return literal(value, dt[1:-1])
            return literal(value)
        if kind == "word" and text == "a":
            return RDF_TYPE
        if kind == "word" and text.lower() in ("true", "false"):
            return literal(text.lower(), XSD + "boolean")
        raise ParseError(f"expected a term, found {text or 'the end'!r}")

    def verb(self) -> Any:
        return self.term()

    def pname(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise ParseError(f"unknown prefix {prefix!r}")
        return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    @staticmethod
    def number(text: str) -> str:
        kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
        return literal(text, XSD + kind)

    # -- paths

    def path(self) -> tuple:
        out = self.path_sequence()
        while self.accept("|"):
            out = ("alt", out, self.path_sequence())
        return out

    def path_sequence(self) -> tuple:
        out = self.path_element()
        while self.accept("/"):
            out = ("seq", out, self.path_element())
        return out

    def path_element(self) -> tuple:
        inverse = bool(self.accept("^"))
        out = self.path_primary()
        while w := self.accept("*", "+", "?"):
            out = ({"*": "star", "+": "plus", "?": "opt"}[w], out)
        return ("inv", out) if inverse else out

    def path_primary(self) -> tuple:
        if self.accept("("):
            out = self.path()
            self.expect(")")
            return out
        if self.accept("!"):
            forward, inverse = [], []

            def one() -> None:
                (inverse if self.accept("^") else forward).append(self.term())

            if self.accept("("):
                while not self.accept(")"):
                    one()
                    self.accept("|")
            else:
                one()
            return ("nps", tuple(forward), tuple(inverse))
        return ("iri", self.term())

    # -- templates

    def template(self, graph: str | None = None) -> tuple:
        """Quads (s, p, o, graph or None) with variables."""
        self.in_template = True
        out: list[tuple] = []

        def block(g: str | None) -> None:
            while not self.accept("}"):
                if self.accept("."):
                    continue
                if self.word() == "GRAPH":
                    self.next()
                    inner = self.term()
                    self.expect("{")
                    block(inner)
                    continue
                found: list[A.Pattern] = []
                subject = self.node(found, [])
                if self.text not in (".", "}"):
                    self.property_list(subject, found, [])
                out.extend((p.s, p.p, p.o, g) for p in found)

        self.expect("{")
        block(graph)
        self.in_template = False
        return tuple(out)

    # -- expressions

    def expression(self) -> tuple:
        out = self.conjunction()
        while self.accept("||"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.relation()
        while self.accept("&&"):
            out = ("and", out, self.relation())
        return out

    def relation(self) -> tuple:
        out = self.sum()
        if self.kind == "op" and self.text in _COMPARE:
            return (_COMPARE[self.next()], out, self.sum())
        negated = self.word() == "NOT" and self.tokens[self.i + 1][1].upper() == "IN"
        if negated:
            self.next()
        if self.accept("IN"):
            if self.text == "(" and self.tokens[self.i + 1][1] == "{":
                self.next()
                sub = self.group()
                self.expect(")")
                return ("insub", negated, out, sub)
            return ("in", negated, out, tuple(self.arguments()))
        return out

    def sum(self) -> tuple:
        out = self.product()
        while True:
            if w := self.accept("+", "-"):
                out = ("add" if w == "+" else "sub", out, self.product())
            else:
                return out

    def product(self) -> tuple:
        out = self.unary()
        while w := self.accept("*", "/"):
            out = ("mul" if w == "*" else "div", out, self.unary())
        return out

    def unary(self) -> tuple:
        if self.accept("!"):
            return ("not", self.unary())
        if self.kind == "op" and self.text == "-" and self.tokens[self.i + 1][0] != "num":
            self.next()
            return ("neg", self.unary())
        if self.kind == "op" and self.text == "+" and self.tokens[self.i + 1][0] != "num":
            self.next()
            return self.unary()
        return self.primary()

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            self.accept(",")
        return out

    def primary(self) -> tuple:
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        w = self.word()
        if w in ("EXISTS", "NOT"):
            negated = w == "NOT"
            self.next()
            if negated:
                self.expect("EXISTS")
            return ("exists", negated, self.group())
        if w in _AGGREGATES:
            self.next()
            self.expect("(")
            distinct = bool(self.accept("DISTINCT"))
            arg = None if self.accept("*") else self.expression()
            sep = " "
            if self.accept(";"):
                self.expect("SEPARATOR")
                self.expect("=")
                from ..terms import parse_literal

                sep = parse_literal(self.term()).lexical
            self.expect(")")
            return ("agg", w.lower(), distinct, arg, sep)
        if w and w not in ("TRUE", "FALSE") and self.tokens[self.i + 1][1] == "(":
            self.next()
            return (w.lower(), *self.arguments())
        if self.kind in ("iri", "pname"):
            t = self.term()
            if self.text == "(":
                return ("call", t[1:-1], *self.arguments())
            return ("const", t)
        t = self.term()
        if isinstance(t, A.TripleTerm):
            as_expr = lambda x: ("var", x[1:]) if A.is_var(x) else ("triple", as_expr(x.s), as_expr(x.p), as_expr(x.o)) if isinstance(x, A.TripleTerm) else ("const", x)
            return as_expr(t)
        return ("var", t[1:]) if A.is_var(t) else ("const", t)


def parse_query(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, base, prefixes).query()


def parse_update(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> list[A.Update]:
    return Parser(text, base, prefixes).updates()
