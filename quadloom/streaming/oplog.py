"""The change log of a quad store and its fold to the current quads.

Rows are (op, s, p, o, c, tx_time, seq); op is add, del or clear. A clear names a graph in ``c``, or all graphs if ``c`` is NULL.
Later (tx_time, seq) wins; a quad is visible if its last operation is an add that no later clear covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "op string, s string, p string, o string, c string, tx_time long, seq long"


def fold(log: DataFrame) -> DataFrame:
    """(s, p, o, c, tx_time) of the visible quads: partial maxima by quad, and the few clears joined by graph."""
    at = F.struct("tx_time", "seq")
    last = log.where(F.col("op").isin("add", "del")).groupBy("s", "p", "o", "c").agg(F.max(F.struct("tx_time", "seq", "op")).alias("last"))
    clears = log.where("op = 'clear'").groupBy(F.col("c").alias("gc")).agg(F.max(at).alias("cleared"))
    everywhere = clears.where("gc is null").select(F.col("cleared").alias("cleared_all"))
    by_graph = clears.where("gc is not null")
    live = last.where("last.op = 'add'").join(by_graph, F.col("c") == F.col("gc"), "left").join(everywhere, F.lit(True), "left")
    mine = F.struct("last.tx_time", "last.seq")
    keep = (F.col("cleared").isNull() | (mine > F.col("cleared"))) & (F.col("cleared_all").isNull() | (mine > F.col("cleared_all")))
    return live.where(keep).select("s", "p", "o", "c", F.col("last.tx_time").alias("tx_time"))


def net(ops: DataFrame) -> DataFrame:
    """What of a transaction's operations has to be written: the last for each quad, clears kept, what they cover left out."""
    quads = ops.where("op <> 'clear'").groupBy("s", "p", "o", "c").agg(F.max(F.struct("tx_time", "seq", "op")).alias("x"))
    quads = quads.select(F.col("x.op").alias("op"), "s", "p", "o", "c", F.col("x.tx_time").alias("tx_time"), F.col("x.seq").alias("seq"))
    at = F.struct("tx_time", "seq")
    clears = ops.where("op = 'clear'").groupBy(F.col("c").alias("gc")).agg(F.max(at).alias("x"))
    by_graph = clears.where("gc is not null").select("gc", F.col("x").alias("here"))
    everywhere = clears.where("gc is null").select(F.col("x").alias("all"))  # one row at most
    rest = quads.join(by_graph, F.col("c") == F.col("gc"), "left").join(everywhere, F.lit(True), "left")
    rest = rest.where((F.col("here").isNull() | (at > F.col("here"))) & (F.col("all").isNull() | (at > F.col("all")))).select(*quads.columns)
    clears = clears.select("gc", F.col("x.tx_time").alias("ct"), F.col("x.seq").alias("cs"))
    none = F.lit(None).cast("string")
    again = clears.select(F.lit("clear").alias("op"), none.alias("s"), none.alias("p"), none.alias("o"), F.col("gc").alias("c"), F.col("ct").alias("tx_time"), F.col("cs").alias("seq"))
    return again.unionByName(rest)


def predicate_stats(quads: DataFrame) -> DataFrame:
    """(p, n, subjects, objects): counts and distinct subjects and objects by predicate."""
    return quads.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def global_stats(quads: DataFrame) -> DataFrame:
    return quads.agg(F.count("*").alias("triples"), F.countDistinct("p").alias("predicates"), F.countDistinct("s").alias("subjects"))


def refresh_stats(stats: DataFrame, quads: DataFrame, touched: DataFrame) -> DataFrame:
    """``stats`` with the predicates of a batch of operations counted anew; a predicate without quads drops out."""
    predicates = touched.select("p").where("p is not null").distinct()
    return stats.join(predicates, "p", "left_anti").unionByName(predicate_stats(quads.join(predicates, "p", "left_semi")))


def ingest(stream: DataFrame, store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of log rows to a store, a micro-batch at a time; replayed batches fold to the same quads."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.append(batch))
    return (writer.trigger(availableNow=True) if once else writer).start()
