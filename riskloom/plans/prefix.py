"""Running sums over any number of rows, without one task for a whole partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import stage


def with_running(df: DataFrame, by: list[str], order: str, values: dict[str, str], buckets: int | None = None) -> DataFrame:
    """Add for each ``values`` entry (column -> name) the sum of the column over earlier rows of the group.

    Two-level prefix.  Rows are dealt to ranges of (group, order) whose bounds Spark
    draws as quantiles, so that a skewed order or a group with most of the rows makes
    no hot range; the ranges are summed (one row each) and rows are summed within their
    range only.  Rows of equal (group, order) are in one range; their own order is open.
    """
    n = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = stage(df.repartitionByRange(n, *by, order).withColumn("_b", F.spark_partition_id()), "ranges")
    cells = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in values])
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``n`` rows a group
    cells = cells.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_b")], *[F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_a_{c}") for c in values])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, "_b")])
    j = d.join(cells, same).drop(*[f"_k_{c}" for c in (*by, "_b")])
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for c, name in values.items():
        j = j.withColumn(name, F.col(f"_a_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return j.drop("_b", *[f"_a_{c}" for c in values])
