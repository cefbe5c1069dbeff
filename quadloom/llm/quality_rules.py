"""Line-first quality rules: lines are judged one by one, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD

SYMBOL = re.compile(r"[#*$%&|<>]")
#: A word that only separates menu entries.
SEPARATOR = re.compile(r"[|>\xBB\xB7•]+")
#: A word with a run of two or more shouting or symbol marks at its end (after an optional sentence mark).
SHOUT = re.compile(r"[^\x20\x09-\x0D]*(?:!!|[#*$%&]{2})[.,]?")
#: Whole phrases, in lines of up to BOILERPLATE_WORDS words, of which they are a substantial part.
BOILERPLATE_WORDS = 30
BOILERPLATE = re.compile(
    r"(?:^|[^a-z])(?:licensed under|all rights reserved|copyright \(c\)|permission is hereby granted|terms of (?:use|service)|privacy policy"
    r"|accept (?:all )?cookies|without warranties or conditions|click here|sign in|log in to)(?:[^a-z]|$)"
)
BREAK = re.compile(r"\n")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_lines long, n_failed_lines long, lost_chars long"
)


def line_fails(line: str, found: list[str], max_marked: float = 0.3, max_separators: float = 0.2) -> bool:
    """Verdict on one line with words ``found``: marked punctuation, navigation or boilerplate. A line without words never fails."""
    n = len(found)
    if not n:
        return False
    if sum(1 for w in found if SEPARATOR.fullmatch(w)) > max_separators * n:
        return True
    if ("!!" in line or SYMBOL.search(line)) and sum(1 for w in found if SHOUT.fullmatch(w)) > max_marked * n:
        return True
    return n <= BOILERPLATE_WORDS and bool(BOILERPLATE.search(line.translate(_LOWER)))


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(text: str | None, min_words: int = 50, max_lost: float = 0.5) -> tuple[str | None, tuple]:
    """The cleaned text, and the values of SCHEMA after doc_id.

    A null text has no words, fails the base rules and stays null. ``lost`` counts the word characters of failing lines.
    """
    lines = BREAK.split(text) if text is not None else []
    kept, seen, all_words = [], set(), []
    dup = lost = failed = 0
    for line in lines:
        found = WORD.findall(line)
        if found:
            dup += line in seen
            seen.add(line)
            all_words += found
        if line_fails(line, found):
            failed += 1
            lost += sum(map(len, found))
        else:
            kept.append(line)
    n = len(all_words)
    chars = sum(map(len, all_words))
    first: dict[tuple, int] = {}
    covered = bytearray(n)
    for i, window in enumerate(zip(all_words, all_words[1:], all_words[2:])):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    repeat = covered.count(1)
    base_failed = n < min_words or 100 * repeat > 50 * n
    symbols = len(SYMBOL.findall(text)) if text else 0
    keep = not base_failed and lost <= max_lost * chars
    return (None if text is None else "\n".join(kept)), (n, chars, symbols, dup, repeat, base_failed, keep, len(lines), failed, lost)


def quality_rules(docs: DataFrame, min_words: int = 50, max_lost: float = 0.5) -> DataFrame:
    """doc_id, the base measures, verdicts and the cleaned ``text`` of every document; one narrow pass, no shuffle.

    Nulls: a null text counts as empty and is not kept; a null doc_id is returned as it is. Repeated rows give repeated
    results; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                results = [judge(t, min_words, max_lost) for t in batch.column(1).to_pylist()]
                columns = list(zip(*(r for _, r in results)))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array([t for t, _ in results], pa.string())],
                    names=[*(x.split()[0] for x in SCHEMA.split(", ")), "text"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", text string")


def keep_good(docs: DataFrame, min_words: int = 50, max_lost: float = 0.5) -> DataFrame:
    """The kept documents, with all their columns, their texts without failing lines; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at_text = whole.schema.get_field_index("text")
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                results = [judge(t, min_words, max_lost) for t in batch.column(at_text).to_pylist()]
                columns = [pa.array([t for t, _ in results], batch.schema.field(i).type) if i == at_text else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([bool(v[6]) for _, v in results], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
