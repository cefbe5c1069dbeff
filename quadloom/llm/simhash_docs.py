"""SimHash near-duplicate documents by exact comparison of tiles of fingerprints.

A tile holds the distinct fingerprints whose four 16-bit quarters have the same four population counts. Two fingerprints
within the radius differ by at most the radius in the sum of these counts' differences, so tile pairs further apart are
skipped; the others are compared whole, by exclusive-or and bit counts over numpy blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, lookup, utf8

#: Fingerprints of one block of a tile, on average at most.
BLOCK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is set if it is in over half of the hashes."""
    found = utf8(text).translate(_LOWER).split() if text else []
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < shingle:
        return digest(b" ".join(found), 42)
    rows = zip(*(found[k:] for k in range(shingle)))
    hashes = np.fromiter((digest(r, 42) for r in map(b" ".join, rows)), np.uint64, len(found) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tk, fp): the fingerprint, as a signed long, and a hash of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "tk", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) tk", "text").mapInArrow(run, "doc_id long, tk long, fp long")


def _offsets(radius: int) -> list[int]:
    """Differences of tile keys worth comparing, one of each pair of opposite ones; a key is four counts in base 64."""
    out = set()
    for d in itertools.product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.add(sum(x * 64 ** (3 - i) for i, x in enumerate(d)))
    return sorted(out)


def _tile(fp: str = "fp"):
    quarter = lambda k: F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return sum((quarter(k) * 64**k for k in range(4)), F.lit(0)).cast("long")


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what the pairs within the radius connect; no more than there are fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for at in range(0, len(a), 512):
        near = np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius
        for i, j in zip(*np.nonzero(near)):
            x, y = int(a[at + i]), int(b[j])
            if x != y and (not same or x < y):
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    edges.append((x, y))
    return edges


def links(distinct: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of the pairs of the distinct ``fp`` within ``radius`` differing bits; exact as to connection."""
    tiles = distinct.select("fp", _tile().alias("tile"))
    sizes = tiles.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = cut(sizes)  # at most 17^4 rows, whatever the corpus
    spread = tiles.join(F.broadcast(sizes), "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("part"), "fp")
    blocks = cut(spread.groupBy("tile", "part").agg(F.collect_list("fp").alias("fps")))
    other = sizes.select(F.col("tile").alias("tile2"), F.col("blocks").alias("blocks2"))
    near = sizes.select("tile", F.explode(F.array(*[F.col("tile") + F.lit(d) for d in _offsets(radius)])).alias("tile2"))
    near = cut(near.join(F.broadcast(other), "tile2"))  # at most 21 x 17^4 rows for radius 2
    pairs = blocks.select("tile", "part", F.col("fps").alias("a")).join(F.broadcast(near), "tile")
    pairs = pairs.select("tile", "part", "tile2", "a", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("part2"))
    pairs = pairs.where("tile <> tile2 or part <= part2")
    right = blocks.select(F.col("tile").alias("tile2"), F.col("part").alias("part2"), F.col("fps").alias("b"))
    compared = pairs.join(right.hint("merge"), ["tile2", "part2"]).select("a", "b", F.expr("tile = tile2 and part = part2").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                edges: list[tuple[int, int]] = []
                for i in range(batch.num_rows):
                    a, b = (np.asarray(batch.column(k)[i].values, dtype=np.int64) for k in (0, 1))
                    edges += _forest(a, b, batch.column(2)[i].as_py(), radius)
                x, y = zip(*edges) if edges else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return compared.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """(doc_id, tk, fp, component, component_id) of every row; a component is named by a fingerprint."""
    marked = cut(fingerprints(docs, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(distinct, radius))
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = cut(named.join(firsts, "component").select("fp", "component", "component_id"))
    return marked.join(of, "fp")


def simhash_near_dedup(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most ``radius`` bits.

    Copies share a fingerprint and are never compared: comparison and components work on distinct fingerprints, and the
    smallest doc_id of each is a partial minimum. A null text, or one without words, has fingerprint zero and is linked like
    any other; a null doc_id is linked but never names a component unless all its component's are null. Repeated rows give
    repeated results; an empty table gives none; further columns are ignored.
    """
    return _grouped(docs, radius, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each group, with all its columns: the smallest by doc_id (nulls last), then by text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    kept = _grouped(docs, radius, shingle).groupBy("component").agg(F.min(order).alias("r"))
    kept = cut(kept.select(F.col("r.doc_id").alias("_id"), F.col("r.tk").alias("_tk")))
    on = docs.doc_id.cast("long").eqNullSafe(kept._id) & (F.xxhash64(docs.text) == kept._tk)
    rows = lookup(docs, kept, on, "left_semi", 24)
    repeated = docs.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tk")).count().where("count > 1")
    if repeated.isEmpty():
        return rows
    # rows of equal doc_id and text: one stays
    (key,) = fresh(docs, "text_key")
    return rows.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
