"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, units after numbers, and capitalised words inside sentences become typed placeholders. Windows of five template words
are hash-joined with the benchmark's, and an alignment counts only if its slots agree: each benchmark value stands for one
document value and the other way round. So a copied question is found, and one with other numbers or names too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

WINDOW, SHARE, RUN_WORDS, LEAST_WORDS = 5, 0.8, 13, 2
UNITS = (
    "kg|mg|g|km|cm|mm|m|ml|l|mph|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|miles?|feet|inches|pounds?|meters?|metres?|liters?|litres?"
)
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def slots(text: Column) -> Column:
    """Lower-case tokens of a text, runs of letters and digits; names begin with U+0001, units with U+0002, numbers with a digit."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9])[.,]([0-9])", "$1$2")
    t = F.regexp_replace(t, rf"([0-9]) ?({UNITS})([^\p{{L}}\p{{N}}]|$)", "$1 \u0002$2$3")
    t = F.regexp_replace(t, r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)", "$1\u0001$2")
    return F.array_remove(F.split(F.lower(t), "[^\\p{L}\\p{N}\u0001\u0002]+"), "")


def template(tokens: Column) -> Column:
    """Placeholders in place of slots."""

    def word(x: Column) -> Column:
        c = F.substring(x, 1, 1)
        return F.when(c > F.lit("9"), F.when(x == "\u0001", F.lit("@")).otherwise(x)).when(c == "\u0001", F.lit("@")).when(c == "\u0002", F.lit("%")).when(c >= "0", F.lit("#")).otherwise(x)

    return F.transform(tokens, word)


def _hashes(words: Column, k: int) -> Column:
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kid"), F.xxhash64("text").alias("tk"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, share: float = SHARE, run_words: int = RUN_WORDS) -> DataFrame:
    """(kid, tk, n_items, item_id): the documents that hold benchmark items, by id and hash of their text."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), slots(F.col("text")).alias("btokens")).distinct()
    windows = items.select("item_id", "btokens", template(F.col("btokens")).alias("words"))
    windows = windows.select("item_id", "btokens", "words", F.posexplode(_hashes(F.col("words"), k)).alias("bpos", "h"))
    part = F.slice("words", F.col("bpos") + 1, k)
    literal = F.size(F.filter(part, lambda x: ~x.isin("#", "@", "%")))
    windows = cut(windows.select("item_id", "bpos", "h", (literal < k).alias("open"), literal.alias("literal")).where(F.col("literal") >= min(LEAST_WORDS, k)).drop("literal"))
    totals = windows.groupBy("item_id").agg(F.countDistinct("bpos").alias("windows"))
    mine = _keyed(docs).select("kid", "tk", template(slots(F.col("text"))).alias("words")).select("kid", "tk", F.posexplode(_hashes(F.col("words"), k)).alias("pos", "h"))
    hits = lookup(mine, windows, "h", "inner").select("kid", "tk", "item_id", (F.col("pos") - F.col("bpos")).alias("shift"), "bpos", "open")
    # an alignment has at most as many windows as its item
    found = cut(hits.groupBy("kid", "tk", "item_id", "shift").agg(F.sort_array(F.collect_set("bpos")).alias("at"), F.max("open").alias("open")))
    closed = found.where("not open").select("kid", "tk", "item_id", "at")
    open_ = found.where("open")
    keys = cut(open_.select("kid", "tk").distinct())
    texts = lookup(_keyed(docs), keys, ["kid", "tk"], "left_semi").dropDuplicates(["kid", "tk"]).select("kid", "tk", slots(F.col("text")).alias("dtokens"))
    pair = F.flatten(
        F.transform(
            "at",
            lambda b: F.transform(
                F.sequence(b, b + (k - 1)), lambda j: F.struct(F.get("btokens", j).alias("b"), F.get("dtokens", j + F.col("shift")).alias("d"))
            ),
        )
    )
    is_slot = lambda x: (F.substring(x, 1, 1) <= "9")
    paired = open_.join(texts, ["kid", "tk"]).join(items, "item_id").select("kid", "tk", "item_id", "at", F.array_distinct(F.filter(pair, lambda p: is_slot(p["b"]) & is_slot(p["d"]))).alias("p"))
    agree = (F.size(F.array_distinct(F.col("p.b"))) == F.size("p")) & (F.size(F.array_distinct(F.col("p.d"))) == F.size("p"))
    aligned = closed.unionByName(paired.where(agree).select("kid", "tk", "item_id", "at"))
    span = run_words - k
    run = F.exists(F.sequence(F.lit(0), F.greatest(F.size("at") - (span + 1), F.lit(0))), lambda i: F.coalesce(F.get("at", i + span) - F.get("at", i) == span, F.lit(False)))
    by_item = aligned.select("kid", "tk", "item_id", "at", run.alias("run")).groupBy("kid", "tk", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.max("run").alias("run")
    )
    by_item = by_item.join(totals, "item_id").where((F.col("n") >= F.lit(share) * F.col("windows")) | F.col("run"))
    return by_item.groupBy("kid", "tk").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, share: float = SHARE, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, contaminated, n_items and the smallest item_id of every document.

    A document holds an item if consistent alignments cover ``share`` of the item's windows, or ``run_words`` of its words in
    a row. Windows with fewer than two plain words are not looked up, so items that have none, items shorter than a window and
    null texts match nothing. Rows of equal doc_id and text share their result; a null doc_id is returned; either table may be
    empty; further columns are ignored. The benchmark's windows are broadcast only behind a check of their number.
    """
    found = cut(contaminated(docs, benchmark, k, share, run_words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kid"), F.xxhash64("text").alias("tk"))
    joined = lookup(rows, found, ["kid", "tk"], "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    found = cut(contaminated(docs, benchmark)).select(F.col("kid").alias("_kid"), F.col("tk").alias("_tk"))
    on = (F.coalesce(docs.doc_id.cast("long"), F.lit(NO_ID)) == found._kid) & (F.xxhash64(docs.text) == found._tk)
    return lookup(docs, found, on, "left_anti")
