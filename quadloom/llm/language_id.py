"""Language identification by cross-parsing: which language's text needs the fewest phrases to write a document with."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit: characters of one language's automaton, of all together, and of one document's part in them.
AUTOMATON_CHARS, ALL_CHARS, DOC_CHARS = 60_000, 240_000, 1000
#: Codes of characters: none learned, a blank for what is no letter, one for each of the OWN most frequent letters; others share the rest.
CODES, OWN, UNKNOWN, BLANK = 64, 46, 0, 1
#: Characters after which a phrase ends in any case, so that long texts are parsed side by side.
SEGMENT = 4096


class SuffixAutomaton:
    """All substrings of a text; ``phrases`` counts the longest matches that a string falls into."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(self.next[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(text)

    def phrases(self, text: str) -> int:
        """Greedy parse: each phrase is the longest match from where the last one ended, or one unknown character."""
        n, state = 0, 0
        nxt = self.next
        for c in text:
            to = nxt[state].get(c)
            if to is None:
                n += state != 0
                to = nxt[0].get(c)
                if to is None:
                    n += 1
                    state = 0
                    continue
            state = to
        return n + (state != 0)


class CrossParser:
    """One automaton per language over its sampled running text; whole documents are parsed across words.

    Texts are lower-cased and their characters coded, all that is no letter between letters being one blank. The automata are
    one array of moves by state and code, of a size bounded by ALL_CHARS, whatever the number of languages and letters. Many
    segments are parsed at once, one character a step. A language's phrases are normalised by the logarithm of its text's
    length, as the entropy estimate asks, and by the document's characters.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        counts = Counter("".join(texts.values()).lower())
        letters = sorted((c for c in counts if c.isalpha()), key=lambda c: (-counts[c], c))
        of = {c: k + 2 if k < OWN else 2 + OWN + ord(c) % (CODES - OWN - 2) for k, c in enumerate(letters)}
        self.codes = np.fromiter((UNKNOWN if chr(i).isalpha() else BLANK for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        for c, k in of.items():
            self.codes[ord(c)] = k
        coded = [self.code(texts[k]) for k in self.langs]
        automata = [SuffixAutomaton("".join(map(chr, x))) for x in coded]
        self.weights = np.array([math.log2(max(2, len(x))) for x in coded])
        starts = np.cumsum([0, *(len(a.next) for a in automata)])
        self.roots = starts[:-1].astype(np.int32) * CODES
        # moves are stored as places in the flat array
        self.moves = np.full(max(1, starts[-1]) * CODES, -1, np.int32)
        for first, a in zip(starts, automata):
            for state, to in enumerate(a.next):
                for c, t in to.items():
                    self.moves[(first + state) * CODES + ord(c)] = (first + t) * CODES

    def code(self, text: str) -> np.ndarray:
        """Codes of a text between blanks; runs of blanks are one."""
        x = self.codes[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        return x[np.concatenate([[True], (x[1:] != BLANK) | (x[:-1] != BLANK)])]

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language: greedy longest matches, or one unknown character; none crosses a segment's end."""
        parts = [(i, x[k : k + SEGMENT]) for i, x in enumerate(coded) for k in range(0, len(x), SEGMENT)]
        parts.sort(key=lambda p: -len(p[1]))
        sizes = np.array([len(x) for _, x in parts])
        grid = np.zeros((sizes.max(initial=0), len(parts)), np.uint8)
        for k, (_, x) in enumerate(parts):
            grid[: len(x), k] = x
        roots, moves = np.tile(self.roots[:, None], (1, len(parts))), self.moves
        state, found = roots.copy(), np.zeros(roots.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        for row, n in zip(grid, active):
            here, c = state[:, :n], row[:n]
            to = moves[here + c]
            if (to < 0).any():
                lost = np.nonzero(to < 0)
                first = roots[lost]
                found[lost] += here[lost] != first
                again = moves[first + c[lost[1]]]
                found[lost] += again < 0
                to[lost] = np.where(again < 0, first, again)
            state[:, :n] = to
        found += state != roots
        out = np.zeros((len(coded), len(self.langs)), np.int64)
        np.add.at(out, np.array([i for i, _ in parts], np.int64), found.T)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each; ``und`` with 0 for a null text, one without letters, or when nothing was learned."""
        out = [("und", 0.0)] * len(texts)
        coded = {i: x for i, t in enumerate(texts) if t and self.langs for x in [self.code(t)] if (x != BLANK).any()}
        if coded:
            rates = self.phrases([*coded.values()]) * self.weights / np.array([len(x) for x in coded.values()])[:, None]
            for i, r in zip(coded, rates):
                order = np.argsort(r, kind="stable")
                best = r[order[0]]
                rest = r[order[1]] if len(order) > 1 else 2 * best
                out[i] = self.langs[order[0]], float(rest / (best + rest))
        return out


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as 1, so that it is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(1))


def fit(docs: DataFrame, chars: int = AUTOMATON_CHARS, all_chars: int = ALL_CHARS) -> dict[str, str]:
    """Labelled running text per language from a bounded sample: the first DOC_CHARS characters of documents with the smallest
    hashes of their ids, each text once, up to ``chars`` characters, or fewer where there are so many languages that all
    would come to more than ``all_chars``. No language is left out.

    The bounds limit what is learned from, as a fit may; predictions use whole texts of all documents. The driver gets about
    four times ``all_chars`` characters at most, and a row for each language.
    """
    labelled = docs.where("lang is not null and text is not null").where(fold() != 1)
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    chars = max(1, min(chars, all_chars // len(n)))
    # a threshold on a hash of the id keeps about so many of each language without sorting any group
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, (4 * chars // DOC_CHARS + 8) / v))])
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = labelled.where(hashed < share[F.col("lang")] * (1 << 20)).select("lang", F.substring("text", 1, min(DOC_CHARS, chars)).alias("text"), hashed.alias("h"))
    texts: dict[str, dict[str, None]] = {k: {} for k in n}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], r["text"])):
        texts[r["lang"]][r["text"]] = None
    return {k: "\n".join(v)[:chars] for k, v in texts.items() if v}


@lru_cache(maxsize=1)
def _parser(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    """A worker builds the automata once."""
    return CrossParser(dict(texts))


def identify_language(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Learns from ``docs`` itself (text and non-null lang of rows whose crc32(doc_id) mod 3 is not 1) unless ``texts`` gives
    each language's text. ``und`` and 0 for a null text, a text without letters, or nothing learned. Equal phrases go to the
    first language by name. Repeated rows give repeated results; an empty table gives none; further columns are ignored.
    """
    texts = fit(docs) if texts is None else texts
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most ALL_CHARS in all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(tuple(sorted(shared.value.items())))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = parser.predict_batch(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
