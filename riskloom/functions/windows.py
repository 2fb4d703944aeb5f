"""Word windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def build_windows(text: Column, budget: int = 128, long_text: int = 200, full_scan: bool = False, split: Column | None = None) -> Column:
    """Array of structs (name, text, pos): ``full``, or ``first`` and ``last``, with a full scan ``middle_i`` too.

    First and last may overlap; middles step by the budget while they start before the
    last.  ``split`` is a column that already holds ``words(text)``; with it the text
    is cut once and not for every window.
    """
    w = words(text) if split is None else split
    n = F.size(w)
    part = lambda start: F.array_join(F.slice(w, start, F.lit(budget)), " ")
    one = lambda name, t, pos: F.struct(F.lit(name).alias("name"), t.alias("text"), F.lit(pos).alias("pos"))
    long_ = F.array(one("first", part(F.lit(1)), 0), one("last", part(F.greatest(n - budget + 1, F.lit(1))), 1))
    if full_scan:
        starts = F.when(n - budget - 1 >= budget, F.sequence(F.lit(budget), F.greatest(n - budget - 1, F.lit(budget)), F.lit(budget))).otherwise(F.array().cast("array<int>"))
        middle = F.transform(starts, lambda s, i: F.struct(F.concat(F.lit("middle_"), i.cast("string")).alias("name"), part(s + 1).alias("text"), (i + 2).cast("int").alias("pos")))
        long_ = F.concat(long_, middle)
    return F.when(n <= long_text, F.array(one("full", text, 0))).otherwise(long_)


def with_windows(df: DataFrame, text: str, out: str = "windows", full_scan: bool = False, windowing: bool = True) -> DataFrame:
    """Add the windows of a text column; null text gives null."""
    if not windowing:
        return df.withColumn(out, F.when(F.col(text).isNotNull(), F.array(F.struct(F.lit("full").alias("name"), F.col(text).alias("text"), F.lit(0).alias("pos")))))
    d = df.withColumn("_split", words(F.col(text)))
    return d.withColumn(out, F.when(F.col(text).isNotNull(), build_windows(F.col(text), full_scan=full_scan, split=F.col("_split")))).drop("_split")
