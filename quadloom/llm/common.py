"""Shared helpers: lineage cuts, size-checked joins, connected components, digests."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows and bytes up to which the right side of ``lookup`` may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 48 << 20
#: The tables that ``stored`` has written inside the innermost ``alone``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def words(text: str | None) -> list[str]:
    """Words of a whole text; a null text has none."""
    return WORD.findall(text) if text else []


def utf8(text: str) -> bytes:
    """UTF-8 of a text; ``split()`` of it gives the same words as ``words``, since bytes split at ASCII white space only."""
    return text.encode("utf-8", "surrogatepass")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local one is made only for a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``cut`` as a Parquet table of the shared folder: smaller, and read by columns. Column names must differ in more than case."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``stored(build())``; the tables that ``build`` has stored on its way are deleted, so nothing else may read them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        df = build()
    finally:
        _MADE.reset(token)
    out = stored(df)
    for name in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by the optimizer's statistics; it needs no job. Sources of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def buckets(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Shuffle groups for what ``df`` reads: at least the session's, more as the input grows."""
    return min(1_000_000, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each)))


def lookup(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int | Column = 64) -> DataFrame:
    """Join with a materialised ``right``: broadcast behind a check of its rows and bytes, else shuffled.

    ``row_bytes`` is a bound of a row's bytes, or a column of them where rows have no common bound.
    """
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)), F.lit(0)).alias("bytes")).first()
    fits = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if fits else right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b: long); returns (node, component), the smallest node reachable.

    Each round sends every node to its smallest neighbour, follows these pointers to their roots by doubling, and contracts the
    graph; rounds and doublings are logarithmic in practice. All steps are shuffles of partial minima: no group meets in one
    task and nothing but counts reaches the driver. No edges give no rows; loops and repeated edges are allowed.
    """
    rest = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    known: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")))
        while True:
            roots = step.select(F.col("node").alias("m"), F.col("m").alias("up"))
            jumped = cut(step.join(roots, "m", "left").select("node", F.coalesce("up", "m").alias("m"), (F.col("up") < F.col("m")).alias("moved")))
            step = jumped.select("node", "m")
            if jumped.where("moved").isEmpty():
                break
        up = step.select(F.col("node").alias("m"), F.col("m").alias("up"))
        known = step if known is None else cut(known.join(up, "m", "left").select("node", F.coalesce("up", "m").alias("m")))
        a = step.select(F.col("node").alias("a"), F.col("m").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("m").alias("y"))
        rest = cut(rest.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    if known is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known.select("node", F.col("m").alias("component"))
