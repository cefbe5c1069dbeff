"""Repeated passages: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged into maximal intervals.

Windows travel as packed, sorted columns: each map batch sends one row of bytes per bucket of the hash space, with one entry for
each hash and the smallest document that holds it there. So a window that is in a third of all documents costs one entry a
batch, and no group of equal windows is ever gathered as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, cut, lookup, sha256, utf8

#: Words of one map batch, about; a longer document is a batch by itself.
BATCH_WORDS = 1_500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 400_000
LAST = np.iinfo(np.int64).max


class WordHashes:
    """64-bit hashes of words, with a bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def windows(x: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of every run of ``width`` word hashes; mixed, so that high bits can choose buckets."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = x[:n].copy()
        for k in range(1, width):
            h *= BASE
            h += x[k : n + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, each packed by itself: sorted differences and small numbers have empty planes."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out = [len(values).to_bytes(4, "little")]
    for k in range(8):
        plane = np.ascontiguousarray(raw[:, k])
        if not plane.any():
            out.append((0).to_bytes(4, "little"))
            continue
        data = _CODEC.compress(plane.tobytes(), asbytes=True)
        if len(data) >= len(plane):
            data = plane.tobytes()
        out.append(len(data).to_bytes(4, "little") + data)
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    out = np.zeros((n, 8), np.uint8)
    for k in range(8):
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if size:
            part = data[at : at + size]
            out[:, k] = np.frombuffer(part if size == n else _CODEC.decompress(part, decompressed_size=n, asbytes=True), np.uint8)
            at += size
    return out.reshape(-1).view("<u8").astype(np.uint64) if n else np.zeros(0, np.uint64)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0)).astype(np.uint64)


PACKED = "bucket int, batch long, hashes binary, offsets binary, starts binary, ids binary, keys binary"


def _send(width: int, n_buckets: int):
    """Rows of PACKED: one per bucket with entries, and one, with ``keys``, of the batch's documents and what it decided itself."""

    def flush(batch: int, ids: list[int], keys: list[int], parts: list[np.ndarray]) -> Iterator[tuple]:
        counts = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        h = np.concatenate(parts)
        doc_ids = np.array(ids, np.int64)
        doc_of = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(h, kind="stable")
        h = h[order]
        d = doc_ids[doc_of[order]]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(h)))) if len(h) else d
        mine = d == least
        yield batch % n_buckets, batch, b"", pack(_deltas(np.sort(order[~mine]).astype(np.uint64))), pack(starts[:-1].astype(np.uint64)), doc_ids.tobytes(), np.array(keys, np.int64).tobytes()
        h, order, d = h[mine], order[mine], d[mine]
        bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            which, index = np.unique(d[part], return_inverse=True)
            yield int(b), batch, pack(_deltas(h[part])), pack(order[part].astype(np.uint64)), pack(index.astype(np.uint64)), pack(_deltas(which.view(np.uint64))), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, k = WordHashes(), TaskContext.get().partitionId(), 0
        ids: list[int] = []
        keys: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            rows = list(flush(task << 24 | k, ids, keys, parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PACKED.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if text:
                        h = windows(hashes(utf8(text).split()), width)
                        if len(h):
                            ids.append(LAST if doc_id is None else doc_id)
                            keys.append(key)
                            parts.append(h)
                            size += len(h)
                    if size >= BATCH_WORDS:
                        yield from out()
                        ids, keys, parts, size, k = [], [], [], 0, k + 1
        if ids:
            yield from out()

    return run


FOUND = "batch long, offsets binary, starts binary, ids binary, keys binary"


def _repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: each batch's offsets whose window also starts in a document with a smaller id. Batches' own rows pass."""
    own, batch, hashes, docs, offsets = [], [], [], [], []
    for part in table.to_batches():
        for r in part.to_pylist():
            if r["keys"]:
                own.append((r["batch"], r["offsets"], r["starts"], r["ids"], r["keys"]))
                continue
            hashes.append(np.cumsum(unpack(r["hashes"]), dtype=np.uint64))
            which = np.cumsum(unpack(r["ids"]), dtype=np.uint64).view(np.int64)
            docs.append(which[unpack(r["starts"]).astype(np.int64)])
            offsets.append(unpack(r["offsets"]).astype(np.int64))
            batch.append(np.full(len(offsets[-1]), r["batch"], np.int64))
    rows = own
    if batch:
        batch, h, d, offset = map(np.concatenate, (batch, hashes, docs, offsets))
        order = np.argsort(h, kind="stable")
        h, d, batch, offset = h[order], d[order], batch[order], offset[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        hit = d > np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(h))))
        batch, offset = batch[hit], offset[hit]
        order = np.lexsort((offset, batch))
        batch, offset = batch[order], offset[order]
        which, start = np.unique(batch, return_index=True)
        rows += [(int(b), pack(_deltas(x.astype(np.uint64))), b"", b"", b"") for b, x in zip(which, np.split(offset, start[1:]) if len(which) else [])]
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])


INTERVALS = "doc_id long, text_key long, starts array<int>, stops array<int>"


def _intervals(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one batch: maximal runs of words under repeated windows, by document."""
        starts = ids = keys = None
        offsets = []
        for row in table.to_batches():
            for r in row.to_pylist():
                offsets.append(np.cumsum(unpack(r["offsets"]), dtype=np.uint64).astype(np.int64))
                if r["ids"]:
                    starts = unpack(r["starts"]).astype(np.int64)
                    ids, keys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64)
        hit = np.sort(np.concatenate(offsets))
        doc = np.searchsorted(starts, hit, side="right") - 1
        pos = hit - starts[doc]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width)])) if len(hit) else np.zeros(0, np.int64)
        end = np.append(new[1:], len(hit)) - 1
        begin, stop, of = pos[new], pos[end] + width if len(hit) else pos, doc[new]
        which, first = np.unique(of, return_index=True)
        cuts = first[1:]
        return pa.table(
            {
                "doc_id": pa.array([None if i == LAST else int(i) for i in ids[which]] if len(which) else [], pa.int64()),
                "text_key": pa.array(keys[which] if len(which) else [], pa.int64()),
                "starts": pa.array([x.tolist() for x in np.split(begin, cuts)] if len(which) else [], pa.list_(pa.int32())),
                "stops": pa.array([x.tolist() for x in np.split(stop, cuts)] if len(which) else [], pa.list_(pa.int32())),
            }
        )

    return run


def repeated_intervals(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, text_key, starts, stops) of documents with words under a window that also starts in a document of smaller id.

    Hashes have 64 bits; at n windows a false repeat is expected n^2 / 2^65 times.
    """
    n = buckets(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    sent = rows.mapInArrow(_send(width, n), PACKED)
    found = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(_repeats, FOUND)
    return found.groupBy("batch").applyInArrow(_intervals(width), INTERVALS).dropDuplicates(["doc_id", "text_key"])


def substring_dedup(docs: DataFrame, width: int = 13, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with ``texts``: the kept words, removed starts and stops) of every document.

    A word goes if some window over it also starts in a document with a smaller doc_id, as the input stands. A null text has
    no words; a null doc_id is larger than all others and equal to itself; rows of one doc_id don't repeat each other, and
    each gets its own result. An empty table gives no rows; further columns are ignored.
    """
    found = cut(repeated_intervals(docs, width))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    right = found.select(F.col("doc_id").alias("id2"), F.col("text_key").alias("key2"), "starts", "stops")
    on = rows.doc_id.eqNullSafe(right.id2) & (rows.text_key == right.key2)
    joined = lookup(rows, right, on, "left", F.lit(64) + 8 * F.size("starts")).select("doc_id", "text", "starts", "stops")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, starts array<int>, stops array<int>" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for text, starts, stops in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    found = utf8(text).split() if text else []
                    kept, last = found, 0
                    if starts:
                        kept = []
                        for a, b in zip(starts, stops):
                            kept += found[last:a]
                            last = b
                        kept += found[last:]
                    joined = b" ".join(kept)
                    for column, value in zip(out, (len(found), len(found) - len(kept), sha256(joined), joined.decode("utf-8", "surrogatepass") if texts else None)):
                        column.append(value)
                columns = {"doc_id": batch.column(0), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": pa.array(out[2], pa.string())}
                if texts:
                    columns |= {"kept": pa.array(out[3], pa.string()), "starts": batch.column(2), "stops": batch.column(3)}
                yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, schema)
