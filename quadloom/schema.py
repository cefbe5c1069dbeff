"""The virtual graph over the star-schema tables: one class per table, a predicate per column, an edge per foreign key."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources.mapping import BASE, ROW_ID, MappedSource, Table

V = BASE + "v#"
#: table: (class, key, columns, {edge: (column, target)})
TABLES: dict[str, tuple] = {
    "region": ("Region", "r_regionkey", ["r_name"], {}),
    "nation": ("Nation", "n_nationkey", ["n_name"], {"n_region": ("n_regionkey", "region")}),
    "customer": ("Customer", "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], {"c_nation": ("c_nationkey", "nation")}),
    "supplier": ("Supplier", "s_suppkey", ["s_name", "s_acctbal"], {"s_nation": ("s_nationkey", "nation")}),
    "part": ("Part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {}),
    "orders": ("Order", "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_customer": ("o_custkey", "customer")}),
    "lineitem": (
        "Lineitem",
        ROW_ID,
        ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        {"l_order": ("l_orderkey", "orders"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")},
    ),
    "events": ("Event", "event_id", ["ts", "user_id", "event_type", "value", "props"], {}),
    "documents": ("Document", "doc_id", ["text", "lang", "source", "n_chars"], {}),
    "labels": ("Label", "doc_id", ["quality", "toxic"], {"labels_document": ("doc_id", "documents")}),
}


def tpch_source(spark: SparkSession, sf_dir: str) -> MappedSource:
    """Columns without a table prefix are named ``<table>_<column>``. Rows of lineitem, which has no key, are told apart by
    their place in the file; a scan that doesn't project the row leaves it out."""
    out = []
    for name, (cls, key, columns, links) in TABLES.items():
        def read(name=name):
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

        prefixed = {V + (c if c.startswith(("r_", "n_", "c_", "s_", "p_", "o_", "l_")) and name not in ("events", "documents") else f"{name}_{c}"): c for c in columns}
        graph = {"graph": BASE + "graph/", "graph_column": "event_type"} if name == "events" else {}
        out.append(Table(name, V + cls, read, key, prefixed, {V + k: x for k, x in links.items()}, **graph))
    return MappedSource(spark, out)
