"""Problem 3: mix sources to target shares with a cap on repeats.

Hash-threshold histograms.  Every row has a fixed hash; sizes are summed by
source and hash bucket, the budget of a source in a mix falls into one boundary
bucket, only that bucket is summed again by finer buckets, and only the rows of
the remaining cell are ordered.  The result is one threshold (hash, id) per mix
and source, and rows are kept by comparing with it: nothing is sorted or
gathered, and a larger budget always contains a smaller one.

A budget above the size of the source is filled with whole passes over it, at
most ``max_repeats``; the rest of the budget is taken by threshold.

Defined results: rows with null source or null/empty labels do not count; a
source without rows reaches 0; a size of null counts as 0; rows of equal hash are
ordered by id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import hash63
from ..plans.staging import stage
from .common import strip_all

BITS = 12


def source_name(col: str | Column = "source") -> Column:
    """Trimmed, lower-cased and cut before ``::``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(strip_all(c)), r"(?s)::.*$", "")


def _bucket(level: int) -> Column:
    return F.shiftright("_h", 63 - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1))


def _boundary(hist: DataFrame, budgets: DataFrame, on: list[str], bucket: str) -> DataFrame:
    """Of each budget, the bucket in which its running sum is reached, and what is left for it."""
    run = Window.partitionBy(*on).orderBy(bucket)
    sums = hist.withColumn("_cum", F.sum("_size").over(run))
    j = budgets.join(sums, on)
    return j.filter((F.col("_cum") >= F.col("_rest")) & (F.col("_cum") - F.col("_size") < F.col("_rest"))).withColumn("_rest", F.col("_rest") - (F.col("_cum") - F.col("_size"))).drop("_cum", "_size")


def mix(rows: DataFrame, targets: DataFrame, id_col: str = "rec_id", size: Column | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mix_id, source, id, times, size) of the rows in each mix, and one plan row per target.

    ``targets``: (mix_id, mix_pct, source, target_pct, max_repeats), a fixed small
    table; it and everything with one row per target is broadcast.  ``size`` is
    the size of a row (default 1: shares of rows).  The budget of a source is
    ceil(target_pct x floor(total size x mix_pct / 100) / 100).
    """
    weight = F.coalesce((size if size is not None else F.lit(1)).cast("long"), F.lit(0))
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_total"))
    t = (
        targets.filter("mix_id is not null and source is not null")
        .groupBy("mix_id", "source")
        .agg(F.max("mix_pct").cast("long").alias("mix_pct"), F.max("target_pct").cast("long").alias("target_pct"), F.max("max_repeats").cast("long").alias("max_repeats"))
        .crossJoin(F.broadcast(total))  # a single row
        .withColumn("wanted", F.expr("(target_pct * ((_total * mix_pct) div 100) + 99) div 100"))
    )
    usable = rows.filter(F.col("source").isNotNull() & F.col("labels").isNotNull() & (F.size("labels") > 0)).select(
        F.col(id_col), source_name().alias("source"), weight.alias("_w"), hash63(id_col, seed=seed).alias("_h")
    )
    usable = usable.join(F.broadcast(t.select("source").distinct()), "source", "left_semi")

    # tables of at most (sources of the targets x 2**BITS) rows, written so that each scan of the rows runs once
    hist = stage(usable.groupBy("source", _bucket(1).alias("_b1")).agg(F.sum("_w").alias("_size")), "p3-histogram")
    held = hist.groupBy("source").agg(F.sum("_size").alias("held"))
    p = t.join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    p = p.withColumn("_passes", F.when(F.col("held") > 0, F.least("max_repeats", F.expr("wanted div greatest(held, 1)"))).otherwise(0))
    p = p.withColumn("_rest", F.when((F.col("held") > 0) & (F.col("_passes") < F.col("max_repeats")), F.col("wanted") - F.col("_passes") * F.col("held")).otherwise(0))
    p = stage(p, "p3-budgets")

    b1 = _boundary(hist, p.filter("_rest > 0").select("mix_id", "source", "_rest"), ["source"], "_b1")
    cells1 = b1.select("source", "_b1").distinct()
    in1 = usable.withColumn("_b1", _bucket(1)).join(F.broadcast(cells1), ["source", "_b1"], "left_semi")
    hist2 = in1.groupBy("source", "_b1", _bucket(2).alias("_b2")).agg(F.sum("_w").alias("_size"))
    b2 = stage(_boundary(hist2, b1, ["source", "_b1"], "_b2"), "p3-boundary")
    cells2 = b2.select("source", "_b1", "_b2").distinct()
    in2 = in1.withColumn("_b2", _bucket(2)).join(F.broadcast(cells2), ["source", "_b1", "_b2"], "left_semi")
    run = Window.partitionBy("source", "_b1", "_b2").orderBy("_h", id_col)
    sums = in2.withColumn("_cum", F.sum("_w").over(run))
    last = (
        sums.join(F.broadcast(b2), ["source", "_b1", "_b2"])
        .filter((F.col("_cum") >= F.col("_rest")) & (F.col("_cum") - F.col("_w") < F.col("_rest")))
        .groupBy("mix_id", "source")
        .agg(F.min(F.struct(F.col("_h").alias("h"), F.col(id_col).alias("i"))).alias("_last"))
    )
    p = stage(p.join(last, ["mix_id", "source"], "left"), "p3-thresholds")

    at = F.struct(F.col("_h").alias("h"), F.col(id_col).alias("i"))
    extra = F.when(F.col("_last").isNotNull() & (at <= F.col("_last")), 1).otherwise(0)
    drawn = (
        usable.join(F.broadcast(p.select("mix_id", "source", "_passes", "_last")), "source")
        .withColumn("times", (F.col("_passes") + extra).cast("int"))
        .filter("times > 0")
        .select(F.col("mix_id").cast("int").alias("mix_id"), "source", id_col, "times", F.col("_w").alias("size"))
    )
    return drawn, p.select(F.col("mix_id").cast("int").alias("mix_id"), "source", "target_pct", "max_repeats", "held", "wanted")


def report(drawn: DataFrame, p: DataFrame) -> DataFrame:
    """Wanted and reached size of each target, summed from the mix itself."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("times") * F.col("size")).alias("reached"), F.max("times").alias("most_repeats"))
    j = p.join(F.broadcast(got), ["mix_id", "source"], "left")  # one row per target
    whole = Window.partitionBy("mix_id")
    return j.select(
        "mix_id", "source", F.col("target_pct").cast("int").alias("target_pct"), F.col("held").cast("long").alias("held"), F.col("wanted").cast("long").alias("wanted"),
        F.coalesce("reached", F.lit(0)).cast("long").alias("reached"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"),
    ).withColumn("mix_size", F.sum("reached").over(whole))
