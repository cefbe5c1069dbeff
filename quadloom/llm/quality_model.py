"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .language_id import fold

#: Words and marks; runs of one mark are one token, so that their length counts.
TOKEN = re.compile(r"\w+|!+|#+|\$+|%+|&+|\*+|\|+|\.+|,+|-+|[^\w\s]")
#: Bounds of the fit and of the model: sampled labelled documents, word slots (words share slots by hash), dimensions, context.
SAMPLE_DOCS, SLOTS, DIM, NONZERO, WINDOW, HIDDEN = 12_000, 1 << 14, 96, 6, 2, 32
CACHE_TOKENS = 500_000
#: Labelled rows below which, or with labels of one kind, no network is fitted and every score is the labels' smoothed rate.
LEAST_LABELS = 20


def _index_entries(slots: int = SLOTS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Each slot's sparse random vector: the dimensions of its few entries, and their signs."""
    rng = np.random.default_rng(20_240_501)
    at = rng.random((slots, dim)).argpartition(nonzero, axis=1)[:, :nonzero]
    return at.astype(np.int64), rng.choice(np.array([-1, 1], np.float64), (slots, nonzero))


def _index_vectors() -> np.ndarray:
    at, sign = _index_entries()
    out = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(out, at, sign.astype(np.float32), axis=1)
    return out


class Slots:
    """Tokens to word slots, with a bounded memory."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > CACHE_TOKENS:
            known.clear()
        found = TOKEN.findall(text)
        for w in set(found).difference(known):
            known[w] = zlib.crc32(_shape(w).encode("utf-8", "surrogatepass")) % SLOTS
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def _shape(token: str) -> str:
    """Upper-case words share a slot by length, as do numbers; other words stand for themselves."""
    if token.isdigit():
        return f"\x00{min(len(token), 8)}"
    if len(token) > 1 and token.isupper():
        return f"\x01{min(len(token), 8)}"
    return token


@dataclass
class QualityModel:
    """Everything a worker needs; its size doesn't depend on the corpus."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(((pooled - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled.astype(np.float64)) / self.temperature, -30, 30)))


def pool(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of a document, by slot counts; no words give zeros."""
    if not len(slots):
        return np.zeros(vectors.shape[1], np.float32)
    at, n = np.unique(slots, return_counts=True)
    return (n.astype(np.float32) / len(slots)) @ vectors[at]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield batch, batch.column(column).to_pylist()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the neighbours' index vectors for each slot, over one partition of the sample."""
    (at, sign), of = _index_entries(), Slots()
    total = np.zeros(SLOTS * DIM, np.float64)
    for _, texts in _texts(batches, 0):
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for t in texts:
            s = of(t)
            for k in range(1, WINDOW + 1):
                if len(s) > k:
                    pairs += [(s[k:], s[:-k]), (s[:-k], s[k:])]
        if not pairs:
            continue
        word, near = (np.concatenate(x) for x in zip(*pairs))
        for j in range(NONZERO):
            total += np.bincount(word * DIM + at[near, j], weights=sign[near, j], minlength=SLOTS * DIM)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["total"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Learn from about ``sample_docs`` labelled documents whose crc32(doc_id) mod 3 is not 1, chosen by a hash of the id.

    Only texts are inputs; several labels of a document are averaged. The sample bounds the fit, as documented; no cap applies
    to scoring. The driver gets the sample's pooled vectors and a few tables of SLOTS x DIM numbers, all of fixed bounds.
    """
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    marks = marks.where(fold("id") != 1)
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_docs / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # about sample_docs rows by the threshold above
    sample = texts.join(F.broadcast(marks), "id").select("text", "y", "id")
    # the coalesce bounds the tables sent to the driver, however many partitions a session gives to a keyed repartition
    sample = cut(sample.repartition(8, "id").coalesce(8))
    vectors = _index_vectors()
    for row in sample.select("text").mapInArrow(_contexts, "total binary").collect():  # one table for each of 8 partitions
        vectors = vectors + np.frombuffer(row["total"], np.float32).reshape(SLOTS, DIM)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)).astype(np.float32)
    # neighbours describe a word, its own random vector tells it apart
    vectors = np.hstack([vectors, _index_vectors()])
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Slots()
        for batch, found in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([pool(of(t), shared.value).tobytes() for t in found], pa.binary()), batch.column(1), batch.column(2)], names=["v", "y", "id"])

    rows = sorted(sample.mapInArrow(pooled, "v binary, y int, id long").collect(), key=lambda r: (r["id"], r["v"]))
    y = np.array([r["y"] for r in rows], np.float64)
    x = np.array([np.frombuffer(r["v"], np.float32) for r in rows], np.float64).reshape(len(rows), vectors.shape[1])
    return _train(vectors, x, y)


def _train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60) -> QualityModel:
    none = np.zeros((1, 1))
    if len(y) < LEAST_LABELS or len(set(y)) < 2:
        return QualityModel(vectors, none, none, none, none, none, 0.0, 1.0, constant=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-4
    z = (x - mean) / scale
    d = x.shape[1]
    params = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    share = y[used].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    weight = np.sqrt(weight)  # half-way between the classes' rates and equal classes
    best, best_loss = [p.copy() for p in params], np.inf
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            h = np.maximum(z[at] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - y[at]) * weight[at] / len(at)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[at].T @ back + 1e-3 * params[0], back.sum(0), h.T @ g + 1e-3 * params[2], np.array([g.sum()])]
            step += 1
            for i, q in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                params[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        out = np.maximum(z[held] @ params[0] + params[1], 0) @ params[2] + params[3]
        loss = np.mean(np.logaddexp(0, out) - y[held] * out)
        if loss < best_loss:
            best, best_loss = [p.copy() for p in params], loss
    w1, b1, w2, b2 = best
    out = np.maximum(z[held] @ w1 + b1, 0) @ w2 + b2
    grid = np.geomspace(0.25, 8, 81)
    losses = [np.mean(np.logaddexp(0, out / t) - y[held] * out / t) for t in grid]
    return QualityModel(vectors, mean, scale, w1, b1, w2, float(b2[0]), float(grid[int(np.argmin(losses))]))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, in one narrow pass.

    A null or empty text has the zero vector and its score; a null doc_id is returned and counts as held out. Without usable labels every score is the labels' smoothed rate. Repeated rows give
    repeated results; an empty table gives none; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = Slots(), shared.value
        for batch, texts in _texts(batches, 2):
            x = np.array([pool(of(t), model.vectors) for t in texts]).reshape(len(texts), -1)
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
