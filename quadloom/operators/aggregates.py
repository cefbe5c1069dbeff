"""Aggregates: native partial and final aggregation on typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as T
from ..errors import UnsupportedError
from ..functions import values as V
from ..functions.values import DECIMAL, DOUBLE, INTEGER, STRING, TERM, Val


def aggregate(fn: str, distinct: bool, arg: Val | None, sep: str, everything: list[Column]) -> Val:
    """``everything`` are all columns of the solution, which COUNT(DISTINCT *) compares."""
    if fn == "count":
        if arg is None:
            return Val(INTEGER, F.countDistinct(F.struct(*everything)) if distinct and everything else F.count(F.lit(1)))
        return Val(INTEGER, F.countDistinct(arg.col) if distinct else F.count(arg.col))
    if fn in ("sum", "avg"):
        return _sum_or_avg(fn, distinct, arg)
    if fn in ("min", "max"):
        if arg.kind == TERM:
            return Val(TERM, _extreme(fn, arg.col))
        if arg.kind.tag == "iri":
            return Val(TERM, (F.min if fn == "min" else F.max)(V.term(arg)))
        return Val(arg.kind, (F.min if fn == "min" else F.max)(arg.col))
    if fn == "sample":
        return Val(arg.kind, F.min(arg.col))  # any value will do; the smallest is the same in every run
    if fn == "group_concat":
        text = V.text(arg)
        gathered = F.collect_set(text) if distinct else F.collect_list(text)
        return Val(STRING, F.array_join(F.sort_array(gathered), sep))
    raise UnsupportedError(f"aggregate {fn}")


def _extreme(fn: str, c: Column) -> Column:
    """By value among numbers, else by the terms' text; numbers come before other terms."""
    n = T.double_col(c)
    key = F.struct(n.isNull().alias("a"), n.alias("b"), c.alias("c"))
    return (F.min_by if fn == "min" else F.max_by)(c, F.when(c.isNotNull(), key))


def _sum_or_avg(fn: str, distinct: bool, arg: Val) -> Val:
    k = arg.kind
    total = (lambda c: F.sum_distinct(c)) if distinct else F.sum
    mean = (lambda c: F.try_divide(F.sum_distinct(c), F.countDistinct(c))) if distinct else F.avg
    if k.tag == "double":
        return Val(DOUBLE, F.coalesce(total(arg.col), F.lit(0.0)) if fn == "sum" else mean(arg.col))
    if k.tag == "integer":
        if fn == "sum":
            # exact in 38 digits; a sum beyond 64 bits is unbound, as columns of integers have no more
            exact = total(arg.col.cast("decimal(28,0)"))
            return Val(INTEGER, F.when(F.count(arg.col) == 0, F.lit(0).cast("bigint")).otherwise(exact.try_cast("bigint")))
        return Val(DECIMAL, mean(arg.col.cast("decimal(20,0)")).try_cast("decimal(38,18)"))
    if k.tag == "decimal":
        c = arg.col
        return Val(DECIMAL, F.coalesce(total(c).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")) if fn == "sum" else mean(c).try_cast("decimal(38,18)"))
    if k != TERM:
        return Val(INTEGER, F.max(F.when(F.lit(False), F.lit(0).cast("bigint")))) if fn == "avg" else Val(INTEGER, F.count(F.lit(None)))
    # generic terms: exact unless a double takes part; what is no number is passed over
    t = arg.col
    exact, double = T.exact_col(t), T.double_col(t)
    inexact = F.max(T.local_type(t).isin("double", "float") & double.isNotNull())
    integers = F.coalesce(F.min(T.integer_col(t).isNotNull() | double.isNull()), F.lit(True))
    n = F.count(exact)
    sums = total(exact)
    whole = (F.sum_distinct if distinct else F.try_sum)(T.integer_col(t))
    if fn == "sum":
        value = F.when(F.coalesce(inexact, F.lit(False)), V.typed(T.double_text(total(double)), "double")).when(
            integers, V.typed(F.when(F.count(T.integer_col(t)) == 0, F.lit("0")).otherwise(whole.cast("string")), "integer")
        )
        return Val(TERM, value.otherwise(V.typed(T.decimal_text(sums), "decimal")))
    average = F.try_divide(sums.try_cast("decimal(30,10)"), (F.countDistinct(exact) if distinct else n).try_cast("decimal(18,0)"))
    return Val(TERM, F.when(F.coalesce(inexact, F.lit(False)), V.typed(T.double_text(mean(double)), "double")).when(n > 0, V.typed(T.decimal_text(average), "decimal")))
