"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this fraction of all rows.  At most
#: ``1 / HOT_SHARE`` keys can be hot, which bounds what is broadcast.
HOT_SHARE = 0.001
#: A table is sent to every executor up to this size.
SENT_BYTES = 4 << 20


def join_heads(rows: DataFrame, heads: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join many ``rows`` to one ``heads`` row per key (``heads[count]`` = rows of that key).

    Heads of hot keys (more than ``HOT_SHARE`` of ``total`` rows, hence at most
    ``1 / HOT_SHARE`` of them) are broadcast, so rows of a hot key are never
    gathered; every other key goes through an ordinary shuffled join.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = heads.filter(F.col(count) > limit)
    cold = heads.filter(F.col(count) <= limit)
    hot_rows = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_rows.unionByName(rest.join(cold, keys, how), allowMissingColumns=how != "inner")


def pairs_within(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Every pair of members of a key once, with each other column c as ``c_a`` and ``c_b``.

    ``ident`` is unique within a key and ``ident_a < ident_b``.  Keys of at most
    ``block`` members are joined as they are, both sides from one exchange.  A
    larger key is cut into ceil(m / block) blocks of members, and every pair of its
    blocks is joined on its own, so no task meets more than ``block`` members of a
    key on either side.
    """
    rest = [c for c in members.columns if c != key]

    def sided(df: DataFrame, tag: str, keep: list[str]) -> DataFrame:
        return df.select(*keep, *[F.col(c).alias(f"{c}_{tag}") for c in rest])

    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > block)
    cold = members.join(sizes, key, "left_anti")
    small = sided(cold, "a", [key]).join(sided(cold, "b", [key]), key).filter(F.col(f"{ident}_a") < F.col(f"{ident}_b"))

    hot = members.join(sizes, key).withColumn("_nb", F.ceil(F.col("_m") / block).cast("int"))
    hot = hot.withColumn("_blk", F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    span = F.sequence(F.lit(0), F.col("_nb") - 1)
    first = hot.withColumn("_i", F.col("_blk")).withColumn("_j", F.explode(F.filter(span, lambda x: F.col("_blk") <= x)))
    second = hot.withColumn("_j", F.col("_blk")).withColumn("_i", F.explode(F.filter(span, lambda x: x <= F.col("_blk"))))
    on = [key, "_i", "_j"]
    met = sided(first, "a", on).join(sided(second, "b", on), on)
    met = met.filter((F.col("_i") < F.col("_j")) | (F.col(f"{ident}_a") < F.col(f"{ident}_b")))
    swap = F.col(f"{ident}_a") > F.col(f"{ident}_b")
    met = met.select(key, *[F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a") for c in rest], *[F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in rest])
    return small.unionByName(met)


def hash63(*cols: str | Column, seed: int = 42) -> Column:
    """A non-negative 63-bit hash of the columns; equal on every engine run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def fits(heads: DataFrame, most: int = SENT_BYTES) -> bool:
    """Whether a (staged) table may be broadcast: its rows are counted, its bytes measured.

    Fixed-width columns take 8 bytes and a row 16 more; the bytes of other columns are summed up.
    """
    wide = [c for c, kind in heads.dtypes if kind in ("string", "binary")]
    if any(kind.startswith(("array", "map", "struct")) for _, kind in heads.dtypes):
        return False
    size = F.lit(16 + 8 * len(heads.columns))
    for c in wide:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return (heads.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def semi_join_checked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys`` (distinct, staged); wide rows stay in place while the keys are few."""
    return rows.join(F.broadcast(keys) if fits(keys) else keys, on, "left_semi")


def _hot_total(heads: DataFrame, count: str) -> int:
    return heads.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]


def join_checked(rows: DataFrame, heads: DataFrame, keys: list[str], count: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """Join many ``rows`` to one staged head a key: broadcast while the heads are measured to be small, else ``join_heads``.

    ``total``: rows of all keys; if not given, those of the heads.
    """
    if fits(heads):
        return rows.join(F.broadcast(heads), keys, how)
    return join_heads(rows, heads, keys, count, _hot_total(heads, count) if total is None else total, how)


def anti_join_checked(rows: DataFrame, heads: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows whose key has no head; ``heads`` as in ``join_checked``.  Rows of hot keys go before anything is shuffled."""
    own = heads.select(*keys)
    if fits(own):
        return rows.join(F.broadcast(own), keys, "left_anti")
    hot = heads.filter(F.col(count) > max(1.0, _hot_total(heads, count) * HOT_SHARE)).select(*keys)
    return rows.join(F.broadcast(hot), keys, "left_anti").join(own, keys, "left_anti")
