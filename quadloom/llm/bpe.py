"""BPE over word-end vocabularies by prefix states, computed depth first over the trie of the distinct words.

For a vocabulary whose merges are applied in rank order, the encoding of a string is determined by its last token together
with the encoding of what precedes that token, and a token may follow another exactly if the two stay apart when their
concatenation is encoded. So one state (the last token) per prefix is enough, prefixes shared by many words are worked out
once, and the same states give the exact token count at every prefix.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sha256, utf8

END = "</w>"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters on which this module and the tokenizer's library surely agree about case, classes and composition.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ‐-‧€]*")
#: The same pieces for such texts, in ranges that the standard module matches faster.
_OF = {k: "".join(chr(c) for c in [*range(0x80, 0x180)] if unicodedata.category(chr(c))[0] == k) for k in "LN"}
PLAIN_PIECE = re.compile(rf"[a-z{_OF['L']}]+|'(?:s|t|re|ve|m|ll|d)|[0-9{_OF['N']}]|[^\sa-z0-9{_OF['L']}{_OF['N']}]+")
#: Distinct words whose results a worker keeps.
CACHE_WORDS = 600_000
NEVER = 1 << 60


# The parts of a tokenizer file that this module does itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> list[str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
TO_LETTERS = dict(enumerate(BYTE_LETTERS))


def letters(word: str) -> str:
    """The word's UTF-8 bytes as the vocabulary writes them."""
    if word.isascii() and word.isprintable():
        return word
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_LETTERS)


class WordBPE:
    """Encoder, decoder and prefix counter for a tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a BPE vocabulary with word ends: {path}")
        if (spec["normalizer"], spec["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER):
            raise ValueError(f"another normaliser or splitter than this module's: {path}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"special tokens with flags: {path}")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.mark = commonprefix([*self.added])
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {m: k for k, m in enumerate(merges)}
        inner = [t for t in self.vocab if not t.endswith(END)]
        final = [t for t in self.vocab if t.endswith(END)]
        self.starts = {t[:k] for t in (*inner, *(t[: -len(END)] for t in final)) for k in range(1, len(t) + 1)}
        self._nodes: dict[str, list] = {"": [{}, (), (), ""]}
        self._apart: dict[tuple[str, str], bool] = {}
        self._split: dict[str, tuple[str, str] | None] = {}
        self._edges: dict[tuple[str, bool], list[tuple[str, int, int]]] = {}
        self._library = None
        self._short: dict[int, list[int]] = {}
        #: By word, or by the id of a special token: its ids, and the number of tokens of each of its prefixes by letters.
        self.codes: dict[str | int, tuple[int, ...]] = {}
        self.prefixes: dict[str | int, list[int]] = {}

    def split_of(self, token: str) -> tuple[str, str] | None:
        """The last merge that makes ``token`` out of its own symbols; None if its encoding is more than one token."""
        known = self._split.get(token, 0)
        if known == 0:
            parts, made = self.symbols(token), ("", token)
            while len(parts) > 1:
                rank, i = min((self.ranks.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                made = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self._split[token] = made if len(parts) == 1 else None
        return known

    def edge(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The tokens that stand at one end of ``token`` while it is made: each with the ranks at which it forms and is used up."""
        key = (token, right)
        known = self._edges.get(key)
        if known is None:
            chain, until = [], NEVER
            while True:
                parts = self.split_of(token)
                formed = self.ranks[parts] if parts[0] else -1
                chain.append((token, formed, until))
                if not parts[0]:
                    break
                token, until = parts[right], formed
            known = self._edges[key] = chain[::-1]
        return known

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else [*token]

    def apart(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is these two tokens: no merge across the border comes before its parts are used up.

        Equal ranks are the same pair, and the leftmost is merged first.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            xs, ys, i, j, known = self.edge(left, True), self.edge(right, False), 0, 0, True
            while True:
                x, fx, px = xs[i]
                y, fy, py = ys[j]
                k = self.ranks.get((x, y), NEVER)
                if fx < k and fy < k and k < px and (k <= py < NEVER or k < py):
                    known = False
                    break
                if px == py == NEVER:
                    break
                if px <= py:
                    i += 1
                else:
                    j += 1
            self._apart[key] = known
        return known

    def whole(self, token: str) -> bool:
        """Whether the encoding of the token's own string is that token."""
        return self.split_of(token) is not None

    def _move(self, node: list, letter: str) -> list:
        """The node of the longest suffix of the node's string + letter that begins some token, as in a word-search automaton.

        A node is [moves by letter, the tokens that may end a prefix there, the same for word-final ones, its string]; tokens
        come longest first, with their lengths in letters.
        """
        state = node[3] + letter
        while state and state not in self.starts:
            state = state[1:]
        found = self._nodes.get(state)
        if found is None:
            tails = [(state[i:], len(state) - i) for i in range(len(state))]
            inner = tuple((t, n) for t, n in tails if t in self.vocab and self.whole(t))
            final = tuple((t + END, n) for t, n in tails if t + END in self.vocab and self.whole(t + END))
            found = self._nodes[state] = [{}, inner, final, state]
        node[0][letter] = found
        return found

    def learn(self, store: dict, found: Iterable[str | int]) -> None:
        """Fill ``store``, one of the two above, for the words of ``found`` that it lacks.

        Sorted order is the depth-first order of the words' trie; the stack holds the states of the path from the root.
        """
        found = set(found)
        if len(store) > CACHE_WORDS and not store.keys() >= found:
            store.clear()
        for i in self.added.values():
            store[i] = (i,) if store is self.codes else [1]
        deep = store is self.prefixes
        new = sorted([(letters(w), w) for w in found if w not in store])
        last, inner_count, ended, nodes = [""], [0], [0], [self._nodes[""]]
        path = ""
        known, apart, move, vocab = self._apart, self.apart, self._move, self.vocab

        def choose(found: tuple, n: int) -> tuple[str, int]:
            for pair in found:
                token, size = pair
                if size == n:
                    return pair
                ok = known.get((last[n - size], token))
                if ok or ok is None and apart(last[n - size], token):
                    return pair
            raise AssertionError("no token ends a prefix")

        for word, raw in new:
            shared, most = 0, min(len(path), len(word) if deep else len(word) - 1)
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], inner_count[shared + 1 :], ended[shared + 1 :], nodes[shared + 1 :]
            path = word if deep else word[:-1]
            node = nodes[-1]
            n = shared
            for letter in path[shared:]:
                n += 1
                node = node[0].get(letter) or move(node, letter)
                nodes.append(node)
                if deep:
                    ended.append(inner_count[n - choose(node[2], n)[1]] + 1)
                token, size = choose(node[1], n)
                last.append(token)
                if deep:
                    inner_count.append(inner_count[n - size] + 1)
            if deep:
                store[raw] = ended[1:]
            else:
                n, letter = len(word), word[-1]
                token, size = choose((node[0].get(letter) or move(node, letter))[2], n)
                code = [vocab[token]]
                n -= size
                while n:
                    token = last[n]
                    code.append(vocab[token])
                    n -= len(token)
                store[raw] = tuple(code[::-1])

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text in order; an int is the id of a special token's string, which the library takes as that token."""
        if self.special is not None and self.mark in text and self.special.search(text):
            out: list[str | int] = []
            for part in self.special.split(text):
                out += [self.added[part]] if part in self.added else self.pieces_of_plain(part)
            return out
        return self.pieces_of_plain(text)

    def pieces_of_plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):  # composed already, as all letters below U+0180 are
            return PLAIN_PIECE.findall(text.lower()) if "İ" not in text else PIECE.findall(text.lower())
        return self._pieces_by_library(text)

    def _pieces_by_library(self, text: str) -> list[str]:
        """Rare characters: the library's own normaliser and splitter, whose pieces are already letters of the vocabulary."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        t = self._library
        back = {c: b for b, c in enumerate(BYTE_LETTERS)}
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text.encode("utf-8", "replace").decode()))
        return [bytes(back[c] for c in p).decode("utf-8", "surrogatepass") for p, _ in found]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts; a null text is empty."""
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(self.codes, set().union(*split))
        code = self.codes.__getitem__
        return [[*chain.from_iterable(map(code, ps))] for ps in split]

    def decode(self, ids: list[int]) -> str:
        """As the library does where the file names no decoder: the tokens' strings, joined by spaces; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    def steps(self, piece: str | int) -> list[int]:
        """The token count at every prefix of a learned piece, in bytes, when a text is cut there."""
        if type(piece) is int:  # cut short, a special token's string is ordinary text
            if piece not in self._short:
                name = self.names[piece]
                table = PrefixTable(self, self.pieces_of_plain(name))
                self._short[piece] = [*map(table.count, range(1, len(utf8(name)))), 1]
            return self._short[piece]
        self.learn(self.prefixes, {piece})
        found = self.prefixes[piece]
        if piece in ("'re", "'ve", "'ll"):  # cut short, this piece is a mark and a letter
            self.learn(self.prefixes, {"'", piece[1]})
            return [found[0], self.prefixes["'"][-1] + self.prefixes[piece[1]][-1], found[-1]]
        return found

    def prefix_table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self, self.pieces(text) if text else [])

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts: the last entries of their pieces' prefix counts, added up."""
        return [n for n, _ in self.cut_batch(texts, None)]

    def cut_batch(self, texts: list[str | None], budget: int | None) -> list[tuple[int, int]]:
        """Of each whole text, its token count and its longest prefix within ``budget``, in bytes as PrefixTable counts them."""
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(self.prefixes, set().union(*split))
        of = self.prefixes
        totals = [sum([of[w][-1] for w in pieces]) for pieces in split]
        if budget is None:
            return [(n, 0) for n in totals]
        sizes = [sum([len(self.names[w] if type(w) is int else of[w]) for w in pieces]) for pieces in split]
        # after the others, as a table may learn again and forget what this batch learned
        return [(n, size if n <= budget else PrefixTable(self, pieces).cut(budget)) for n, size, pieces in zip(totals, sizes, split)]


class PrefixTable:
    """Exact token counts at every prefix of one text, in UTF-8 bytes of its normalised pieces.

    Positions count the pieces' bytes, white space left out. ``count(k)`` is the number of tokens of the first k bytes,
    ``cut(budget)`` the longest whole-character prefix within a budget; neither encodes again.
    """

    def __init__(self, bpe: WordBPE, pieces: list[str | int]):
        bpe.learn(bpe.prefixes, set(pieces))
        of = bpe.prefixes
        self.bpe, self.pieces = bpe, pieces
        self.tokens = [0, *accumulate([of[w][-1] for w in pieces])]
        self.bytes = [0, *accumulate([len(bpe.names[w] if type(w) is int else of[w]) for w in pieces])]

    def count(self, k: int) -> int:
        i = min(bisect_right(self.bytes, max(0, k)) - 1, len(self.bytes) - 1)
        inside = k - self.bytes[i]
        return self.tokens[i] + (self.bpe.steps(self.pieces[i])[inside - 1] if 0 < inside and i < len(self.pieces) else 0)

    def cut(self, budget: int) -> int:
        """The largest number of bytes, of whole characters, whose count is within ``budget``.

        Whole pieces' counts grow, so the cut lies in the first piece that does not fit; in it, a longer prefix may need fewer
        tokens than a shorter one, so its places are tried from the end.
        """
        i = bisect_right(self.tokens, max(0, budget)) - 1
        if i < len(self.pieces) and budget > self.tokens[i]:
            piece = self.pieces[i]
            raw, steps = utf8(self.bpe.names[piece] if type(piece) is int else piece), self.bpe.steps(piece)
            for k in range(len(raw) - 1, 0, -1):
                if steps[k - 1] <= budget - self.tokens[i] and raw[k] & 0xC0 != 0x80:
                    return self.bytes[i] + k
        return self.bytes[i]


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    gc.set_threshold(200_000, 50, 50)  # the tables grow by many small tuples, none of them in cycles
    return WordBPE(path)


def bpe_encode(docs: DataFrame, path: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids and decoded.

    One narrow pass. The vocabulary file is a parameter and must be at ``path`` on every machine. Nulls: a null text is
    empty; a null doc_id is returned. Repeated rows give repeated results; an empty table gives none.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                codes = bpe.encode_batch(batch.column(1).to_pylist())
                texts = [bpe.decode(x) for x in codes]
                columns = {
                    "doc_id": batch.column(0),
                    "n_tokens": pa.array(map(len, codes), pa.int64(), size=len(codes)),
                    "ids_sha256": pa.array([sha256(little(x)) for x in codes], pa.string()),
                    "decoded_sha256": pa.array([sha256(x) for x in texts], pa.string()),
                }
                if ids:
                    columns["ids"] = pa.array(codes, pa.list_(pa.int32()))
                if decoded:
                    columns["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_bytes of every whole text, by prefix counts; one narrow pass.

    ``cut_bytes`` is the longest prefix of at most ``limit`` tokens, in bytes of the normalised text without white space.
    Nulls: a null text is empty (0 bytes, 0 tokens); a null doc_id is returned. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                n, cuts = zip(*bpe.cut_batch(texts, limit)) if texts else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cuts, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
