"""Chat formatting through templates that are only ever called: turns are located by rendering one turn more at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


@dataclass(frozen=True)
class MarkedTemplate:
    """The default template: each turn in role marks, control strings inside texts and roles escaped reversibly.

    A backslash is doubled and one is put after the first character of every control string, so that a rendered text holds
    no control string and ``unescape`` gives back the text.
    """

    controls: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: str) -> str:
        marks = "|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)])
        return re.sub(marks, lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def turn(self, turn: Turn) -> str:
        role, text = turn
        return f"<|turn {self.escape(role)}|>\n{self.escape(text)}<|end|>\n"

    def render(self, turns: list[Turn]) -> str:
        return "".join(map(_rendered(self), turns))

    def parse(self, formatted: str) -> list[Turn]:
        """Turns read back from rendered text."""
        found = re.findall(r"<\|turn (.*?)\|>\n(.*?)<\|end\|>\n", formatted, flags=re.S)
        return [(self.unescape(role), self.unescape(text)) for role, text in found]


@lru_cache(maxsize=8)
def _rendered(template: MarkedTemplate):
    """The template's turns, remembered, as prefixes render them again and again."""
    return lru_cache(maxsize=4096)(template.turn)


@dataclass
class Layout:
    """Where a rendered conversation has its turns (spans), and in them the turns' texts (bodies), in code points."""

    formatted: str
    spans: list[tuple[int, int]]
    bodies: list[tuple[int, int]]
    rewrites: bool


def _prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def _body(render, before: list[Turn], start: int, turn: Turn, size: int) -> tuple[int, int]:
    """Where the turn's text lies in its span of ``size``: what differs between two one-letter texts stands where texts stand."""
    x, y = (render([*before, (turn[0], c)])[start:] for c in "xy")
    head = _prefix(x, y)
    tail = _prefix(x[::-1], y[::-1])
    return head, max(head, size - tail)


def layout(render, turns: list[Turn]) -> Layout:
    """Render every prefix of the turns and compare neighbours.

    An output that does not continue the one before rewrites history: the shared part ends early, ``rewrites`` is set, and
    spans are those by which the final output can be told apart. Nothing is known of a template, so all prefixes are rendered,
    however many: the work grows with the square of a conversation's turns.
    """
    spans, bodies, rewrites, last = [], [], False, ""
    for k, turn in enumerate(turns):
        now = render(turns[: k + 1])
        shared = len(last) if now.startswith(last) else _prefix(last, now)
        rewrites |= shared < len(last)
        if spans and shared < spans[-1][1]:
            spans = [(min(a, shared), min(b, shared)) for a, b in spans]
            bodies = [(min(a, shared), min(b, shared)) for a, b in bodies]
        spans.append((shared, len(now)))
        a, b = _body(render, turns[:k], shared, turn, len(now) - shared) if shared == len(last) else (0, len(now) - shared)
        bodies.append((shared + a, shared + b))
        last = now
    return Layout(last if turns else render(turns), spans, bodies, rewrites)


def format_chat(conversations: DataFrame, template=MarkedTemplate(), learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, loss (the assistant texts' ranges) and rewrites_history.

    Rows are put in order of (turn, role, text), nulls first, so ties are settled. A null text or role is empty; rows with a
    null conv_id form one conversation; repeated rows are turns of their own; an empty table gives none; further columns are
    ignored. A formatted conversation is one value, so its turns meet in one task, gathered by partial aggregation.
    """
    pair = "array<struct<start:int,stop:int>>"
    schema = f"conv_id long, formatted string, spans {pair}, loss {pair}, rewrites_history boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for turns in batch.column(1).to_pylist():
                    turns = [(t["role"] or "", t["text"] or "") for t in turns]
                    found = layout(template.render, turns)
                    out[0].append(found.formatted)
                    out[1].append([{"start": a, "stop": b} for a, b in found.spans])
                    out[2].append([{"start": a, "stop": b} for (role, _), (a, b) in zip(turns, found.bodies) if role == learn_role])
                    out[3].append(found.rewrites)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                kinds = [pa.string(), kind, kind, pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["conv_id", "formatted", "spans", "loss", "rewrites_history"]
                )

    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "struct(turn, role, text) turn")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).mapInArrow(run, schema)


def chat_digests(formatted: DataFrame, template=MarkedTemplate()) -> DataFrame:
    """Digests of what can be read back from ``format_chat``'s output alone: each located span is parsed as one turn.

    Where a template rewrites history, a span need not hold one turn; the turns are then those of the whole output.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import sha256

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = template.parse(r["formatted"]) if r["rewrites_history"] else [t for x in r["spans"] for t in template.parse(r["formatted"][x["start"] : x["stop"]])]
                learned = "".join(template.unescape(r["formatted"][x["start"] : x["stop"]]) for x in r["loss"])
                digest = sha256("".join(f"{role}\n{text}\n" for role, text in turns))
                rows.append((r["conv_id"], len(turns), digest, len(learned), sha256(learned), len(r["formatted"]), r["rewrites_history"]))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return formatted.select("conv_id", "formatted", "spans", "loss", "rewrites_history").mapInArrow(run, schema)
