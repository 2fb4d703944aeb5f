"""Problem 1: draw samples whose categories have requested shares.

Systematic unequal-probability sampling.  Rows are put in a random order within
the sorted categories; row k of category c has inclusion probability
pi_c = min(1, quota_c / available_c); prefix sums of the probabilities run over
all rows from one random start per request, and a row is taken where its prefix
sum crosses an integer.  A category's count is then its quota rounded down or
up; floors are repaired with the first rows not yet taken.

Because pi is constant within a category, the prefix sum of row k is
base_c + (k + 1) * pi_c, so that once rows have their rank in the category the
draw, the count of each category and the repair are arithmetic on (category, k):
one shuffle in all, whatever the number of requests.  Ranks across partitions
come from a two-level prefix: counts by (category, hash bucket) are summed up in
a table of at most categories x BUCKETS rows and rows are numbered only within a
bucket, so a category with a third of all rows is spread over BUCKETS windows.

Defined results: null/empty labels and entries without alias are ``unknown``;
an empty table gives an empty sample and reports every positive target as short;
ties of the hash are broken by the id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import hash63
from .common import strip_all

BUCKET_BITS = 10
UNKNOWN = "unknown"


def categories(rows: DataFrame, aliases: DataFrame, id_col: str = "rec_id", labels_col: str = "labels") -> DataFrame:
    """(id, label): the canonical form of the first entry of labels.

    ``aliases`` (alias, label) is a fixed vocabulary; it is broadcast.
    """
    names = aliases.filter("alias is not null").groupBy(F.col("alias").alias("_alias")).agg(F.min("label").alias("_label"))
    first = strip_all(F.lower(F.get(F.col(labels_col), F.lit(0))))
    return (
        rows.select(F.col(id_col).alias("_id"), first.alias("_alias"))
        .join(F.broadcast(names), "_alias", "left")
        .select(F.col("_id").alias(id_col), F.coalesce("_label", F.lit(UNKNOWN)).alias("label"))
    )


def ranked(rows: DataFrame, id_col: str, label_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``k`` = 0-based random rank in their label, and (label, available)."""
    h = hash63(id_col, seed=seed)
    base = rows.select(id_col, label_col, h.alias("_h")).withColumn("_b", F.shiftright("_h", 63 - BUCKET_BITS))
    cells = base.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(label_col, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(label_col, "_b").orderBy("_h", id_col)
    numbered = base.withColumn("_r", F.row_number().over(within))
    # at most (labels x 2**BUCKET_BITS) rows; labels come from a fixed vocabulary
    out = numbered.join(F.broadcast(starts), [label_col, "_b"]).select(id_col, label_col, (F.col("_start") + F.col("_r") - 1).alias("k"))
    return out, cells.groupBy(label_col).agg(F.sum("_n").alias("available"))


def plan(available: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """One row per request and label: wanted count, probability, start of the prefix sum, repair."""
    total = available.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("_n"))
    t = targets.filter("request_id is not null and label is not null").groupBy("request_id", "label").agg(
        F.max("sample_pct").cast("long").alias("sample_pct"), F.max("target_pct").cast("long").alias("target_pct"), F.max("min_rows").cast("long").alias("min_rows")
    )
    size = F.expr("(_n * sample_pct) div 100")
    p = (
        t.crossJoin(F.broadcast(total))  # a single row
        .join(available, "label", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("size", size)
        .withColumn("wanted", F.greatest(F.col("min_rows"), F.expr("(target_pct * size + 99) div 100")))
        .withColumn("quota", F.least(F.col("target_pct") * F.col("size") / 100.0, F.col("available").cast("double")))
        .withColumn("pi", F.when(F.col("available") > 0, F.col("quota") / F.col("available")).otherwise(0.0))
    )
    before = Window.partitionBy("request_id").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    start = hash63("request_id", seed=seed) / F.lit(float(2**63))
    p = p.withColumn("base", start + F.coalesce(F.sum("quota").over(before), F.lit(0.0)))
    crossings = F.when(F.col("pi") >= 1, F.col("available")).otherwise(F.floor(F.col("base") + F.col("available") * F.col("pi")) - F.floor("base"))
    return p.withColumn("repair", F.greatest(F.lit(0), F.least("wanted", "available") - crossings)).drop("_n")


def sample(rows: DataFrame, aliases: DataFrame, targets: DataFrame, id_col: str = "rec_id", labels_col: str = "labels", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(request_id, id, label, how) of every drawn row, and the plan it was drawn by."""
    cats = categories(rows, aliases, id_col, labels_col)
    with_rank, available = ranked(cats, id_col, "label", seed)
    p = plan(available, targets, seed)
    # one row per request and label of the fixed vocabulary
    j = with_rank.join(F.broadcast(p.select("request_id", "label", "pi", "base", "repair")), "label")
    lo, hi, zero = F.floor(F.col("base") + F.col("k") * F.col("pi")), F.floor(F.col("base") + (F.col("k") + 1) * F.col("pi")), F.floor("base")
    crossed = (F.col("pi") >= 1) | (hi > lo)
    unused_before = F.col("k") - (lo - zero)
    how = F.when(crossed, "systematic").when(unused_before < F.col("repair"), "repair")
    return j.select("request_id", id_col, "label", how.alias("how")).filter("how is not null"), p


def report(drawn: DataFrame, p: DataFrame) -> DataFrame:
    """Wanted and drawn counts of each request and label, counted from the sample itself, and the shares wanted and reached."""
    got = drawn.groupBy("request_id", "label").agg(F.count(F.lit(1)).alias("drawn"))
    # got has at most one row per request and label of the plan
    return p.join(F.broadcast(got), ["request_id", "label"], "left").select(
        F.col("request_id").cast("int").alias("request_id"),
        "label",
        F.col("available").cast("long").alias("available"),
        F.col("wanted").cast("long").alias("wanted"),
        F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"),
        (F.col("target_pct") / 100).alias("share_wanted"),
        (F.coalesce("drawn", F.lit(0)) / F.nullif(F.sum(F.coalesce("drawn", F.lit(0))).over(Window.partitionBy("request_id")), F.lit(0))).alias("share_reached"),  # a row a label
    ).withColumn("short", F.greatest(F.lit(0), F.col("wanted") - F.col("drawn")).cast("long"))
