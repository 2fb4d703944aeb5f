"""Exact duplicates, stable splits and leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import without_safe


def hash_bucket(text_hash: Column) -> Column:
    """0..99 from the first eight hex digits."""
    return F.conv(F.substring(text_hash, 1, 8), 16, 10).cast("long") % 100


def stable_split(text_hash: Column) -> Column:
    """train below 80, val below 90, else test."""
    b = hash_bucket(text_hash)
    return F.when(b < 80, "train").when(b < 90, "val").otherwise("test")


def named_split(split: Column, text_hash: Column, hashed_source: Column) -> Column:
    """Official split names as train / val / test; sources without any are split by hash."""
    official = F.when(F.lower(split).isin("validation", "val"), "val").when(F.lower(split) == "test", "test").otherwise("train")
    return F.when(hashed_source, stable_split(text_hash)).otherwise(official)


def union_duplicates(df: DataFrame, key: str = "hash", order: str = "ord", keep: list[str] | None = None, unions: list[str] | None = None, nulls: bool = True) -> DataFrame:
    """One row per key: the first row's columns ``keep``, the ordered unions of the lists ``unions``, and ``copies``.

    One pass over the input: a row gives one entry for itself and one for each element
    of its lists; entries are combined map-side by (key, list, element), which keeps
    the first row, the number of rows and the first place of each element.  A hot key
    therefore reaches the last step as its distinct elements.  Null keys are dropped;
    ``nulls=False`` says that there are none, and spares a filter on a computed key.
    """
    keep, unions = keep or ["text", "source"], unions or ["labels", "raw_labels", "sources"]
    first = F.struct(*[F.col(k) for k in keep])
    nothing = F.lit(None).cast(df.select(first.alias("f")).schema["f"].dataType)
    entry = lambda kind, e, pos, row: F.struct(F.lit(kind).alias("kind"), e.cast("string").alias("e"), pos.alias("pos"), row.alias("row"))
    own = F.array(entry(-1, F.lit(None), F.lit(0), first))

    def entries(k: int, u: str) -> Column:
        return F.transform(F.array_distinct(F.coalesce(F.col(u), F.array().cast("array<string>"))), lambda x, i: entry(k, x, i, nothing))

    lists = [entries(k, u) for k, u in enumerate(unions)]
    every = (df.filter(F.col(key).isNotNull()) if nulls else df).select(key, F.col(order).alias("_o"), F.explode(F.concat(own, *lists)).alias("_x"))
    once = every.groupBy(key, F.col("_x.kind").alias("_k"), F.col("_x.e").alias("_e")).agg(F.min(F.struct("_o", "_x.pos")).alias("_at"), F.count(F.lit(1)).alias("_n"), F.min_by("_x.row", "_o").alias("_row"))
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_at", "_e")))), lambda x: x["_e"])
    is_row = F.col("_k") == -1
    # one row a key and distinct element from here
    out = once.groupBy(key).agg(F.max(F.when(is_row, F.col("_at._o"))).alias(order), F.first(F.when(is_row, F.col("_row")), True).alias("_row"), F.max(F.when(is_row, F.col("_n"))).alias("copies"), *[of(k).alias(u) for k, u in enumerate(unions)])
    return out.select(key, order, *[F.col(f"_row.{k}").alias(k) for k in keep], *unions, F.col("copies").cast("long").alias("copies"))


def merged_labels(labels: Column) -> Column:
    """The union's labels without ``safe`` beside a risk label or ``unknown``."""
    return without_safe(labels)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (null keys form one key), by partial aggregation."""
    cols = [c for c in df.columns if c not in keys]
    row = F.struct(*cols) if cols else F.struct(F.lit(1).alias("_x"))
    got = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def assign_by_priority(df: DataFrame, key: str = "hash", split: str = "split", order: str = "ord", priority: tuple[str, ...] = ("test", "val", "train")) -> DataFrame:
    """Each key once, in the first split by priority that has it."""
    rank = F.when(F.lit(False), 0)
    for i, s in enumerate(priority):
        rank = rank.when(F.col(split) == s, i)
    return first_wins(df.withColumn("_rank", rank.otherwise(len(priority))), [key], ["_rank", order]).drop("_rank")


def leakage(df: DataFrame, key: str = "hash", split: str = "split") -> DataFrame:
    """(key, splits): keys found in more than one split."""
    seen = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))  # at most one entry a split
    return seen.filter(F.size("splits") > 1)


def drop_seen(df: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose key is not among ``seen``."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def in_split(df: DataFrame, split: str, key: str = "hash") -> DataFrame:
    """Rows whose hash falls into the split (held-out filter)."""
    return df.filter(stable_split(F.col(key)) == split)
