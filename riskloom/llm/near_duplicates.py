"""Problem 4: group records whose texts share most of their words, exactly.

Not the method named.  Pivots drawn from the documents, with Voronoi regions and
triangle-inequality windows, cannot work on these texts: the distance to the nearest
pivot is almost as large as to any other, so that the window sends every document to
nearly every region (figures in the README).  Instead the word sets are joined by a
prefix filter whose regions are divided recursively by one more word (``setjoin``,
where the proof is); the survivors are verified on the words.  The result is exact.

Records with the same word set are one class and are joined once; their copies come
back at the end, large classes in blocks.

Defined results: null text and text without letter or digit match nothing; other
columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_checked, join_heads
from ..plans.staging import stage
from .common import WORD, word_list
from .setjoin import LEFT, REGION, RIGHT, Share, candidates, expanded, tokens_of, verified, with_rows

_HASHES = ["h1", "h2"]


def classes(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (id, h1, h2, tokens), classes (cid, role, tokens) and those with copies (h1, h2, cid, role, rows).

    ``cid`` is the least id of the class, ``rows`` the number of its records.
    """
    sets = rows.filter(F.col(text_col).rlike(WORD)).select(F.col(id_col).alias("id"), tokens_of(word_list(text_col)).alias("tokens"))
    recs = stage(sets.select("id", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), "tokens"), "p4-records")
    both = F.lit(LEFT | RIGHT).alias("role")
    copies = stage(recs.groupBy(*_HASHES).agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").withColumn("role", both), "p4-copies")
    heads = join_checked(recs, copies.drop("role"), _HASHES, "rows", how="left").filter("cid is null or cid = id")
    return recs, heads.select(F.col("id").alias("cid"), both, "tokens"), copies


def similar_classes(rows: DataFrame, heads: DataFrame, id_col: str, text_col: str, num: int = 7, den: int = 10, region: int = REGION) -> DataFrame:
    """(cid_l, cid_r, common, either), cid_l < cid_r: classes of word share >= num / den."""
    share = Share(num, den)
    met = stage(candidates(heads, share, region), "p4-met")
    texts = rows.select(F.col(id_col).alias("cid"), F.lit(LEFT | RIGHT).alias("role"), F.col(text_col).alias("text"))
    return stage(verified(met, texts, share, two=False), "p4-similar")


def pairs(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", num: int = 7, den: int = 10, region: int = REGION) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records of word share >= num / den.

    This is the expanded form, with the copies of a class as pairs; ``linked``
    has one row per record instead.
    """
    recs, heads, copies = classes(rows, id_col, text_col)
    sim = with_rows(similar_classes(rows, heads, id_col, text_col, num, den, region).select("cid_l", "cid_r"), copies, two=False)
    twin = copies.select(F.col("cid").alias("cid_l"), F.col("cid").alias("cid_r"), F.col("rows").alias("rows_l"), F.col("rows").alias("rows_r"))
    every = stage(sim.unionByName(twin), "p4-pairs")
    # records of classes with copies by their class, all others are their own class
    several = join_checked(recs.select("id", *_HASHES), copies.drop("role"), _HASHES, "rows").select("id", "cid", "rows")
    ends = F.explode(F.array(*[F.struct(F.col(f"cid_{t}").alias("id"), F.col(f"rows_{t}").alias("rows")) for t in "lr"]))
    lone = every.select(ends.alias("e")).select("e.*").filter("rows = 1").distinct()
    members = stage(several.unionByName(lone.select("id", F.col("id").alias("cid"), "rows")), "p4-members")
    l, r = (members.select(*[F.col(c).alias(f"{c}_{t}") for c in ("id", "cid", "rows")]) for t in "lr")
    j = expanded(every, l, r).filter((F.col("cid_l") != F.col("cid_r")) | (F.col("id_l") < F.col("id_r")))
    return j.select(F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b"))


def _spread_min(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, near): the least label among the neighbours; the label of a hub travels to its edges combined by block."""
    far = labels.select(F.col("cid").alias("cid_b"), "group")
    return both.join(far, "cid_b").groupBy(F.col("cid_a").alias("cid")).agg(F.min("group").alias("near"))


def components(nodes: DataFrame, edges: DataFrame, hub: int = 4096) -> DataFrame:
    """(cid, group): least cid that can be reached over the edges (cid_a, cid_b).

    Min-label propagation with a jump to the label's label in each round; rounds
    grow with the logarithm of the longest chain.  Only linked classes take part.
    A class with more than ``hub`` links stands as one copy for every ``hub`` of them,
    tied together by links of their own, so no join key has more.
    """
    both = edges.select("cid_a", "cid_b").unionByName(edges.select(F.col("cid_b").alias("cid_a"), F.col("cid_a").alias("cid_b")))
    degree = stage(both.groupBy("cid_a").agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") > hub), "p4-hubs")
    both = both.withColumn("part_a", F.lit(0)).withColumn("part_b", F.lit(0))
    if not degree.isEmpty():
        for side, other in (("a", "b"), ("b", "a")):
            d = degree.select(F.col("cid_a").alias(f"cid_{side}"), "links")
            part = F.coalesce(F.pmod(F.xxhash64(f"cid_{other}"), F.ceil(F.col("links") / hub)).cast("int"), F.lit(0))
            both = join_checked(both, d, [f"cid_{side}"], "links", how="left").withColumn(f"part_{side}", part).drop("links")
        ring = degree.select(F.col("cid_a"), F.col("cid_a").alias("cid_b"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("links") / hub).cast("int") - 1)).alias("part_a"))
        ring = ring.withColumn("part_b", F.floor(F.col("part_a") / 2).cast("int"))  # a tree over the copies
        both = both.unionByName(ring).unionByName(ring.select("cid_a", "cid_b", F.col("part_b").alias("part_a"), F.col("part_a").alias("part_b")))
    both = stage(both.select(F.struct("cid_a", "part_a").alias("cid_a"), F.struct(F.col("cid_b").alias("cid_a"), F.col("part_b").alias("part_a")).alias("cid_b")), "p4-edges")
    labels = stage(both.groupBy("cid_a").agg(F.least(F.min("cid_b"), F.first("cid_a")).alias("group")).withColumnRenamed("cid_a", "cid"), "p4-labels")
    while True:
        low = labels.join(_spread_min(both, labels), "cid").select("cid", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        jump = labels.select(F.col("cid").alias("group"), F.col("group").alias("further"))
        new = stage(low.join(jump, "group", "left").select("cid", "old", F.least("group", F.coalesce("further", "group")).alias("group")), "p4-labels")
        if new.filter("group <> old").isEmpty():
            break
        labels = new.select("cid", "group")
    found = new.filter("cid.part_a = 0").select("cid.cid_a", F.col("group.cid_a").alias("group")).withColumnRenamed("cid_a", "cid")
    return nodes.join(found, "cid", "left").withColumn("group", F.coalesce("group", "cid"))


def linked(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", num: int = 7, den: int = 10, region: int = REGION) -> DataFrame:
    """(id, class_id, group_id, links): one row per record with letters or digits.

    ``class_id`` is the least id with the same words, ``group_id`` the least id
    that is reached over links, ``links`` the number of other records of word
    share >= num / den.
    """
    recs, heads, copies = classes(rows, id_col, text_col)
    sim = stage(with_rows(similar_classes(rows, heads, id_col, text_col, num, den, region), copies, two=False), "p4-pairs")
    ends = sim.select(F.col("cid_l").alias("cid"), F.col("rows_r").alias("far")).unionByName(sim.select(F.col("cid_r").alias("cid"), F.col("rows_l").alias("far")))
    degree = ends.groupBy("cid").agg(F.sum("far").alias("far"))  # combined before the exchange
    info = components(degree, sim.select(F.col("cid_l").alias("cid_a"), F.col("cid_r").alias("cid_b")))
    info = stage(info.select("cid", "group", "far"), "p4-info")
    named = join_checked(recs.select("id", *_HASHES), copies.drop("role"), _HASHES, "rows", how="left").select("id", F.coalesce("cid", "id").alias("cid"), F.coalesce("rows", F.lit(1)).alias("rows"))
    sized = info.join(copies.select("cid", "rows"), "cid", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    out = join_heads(named.withColumnRenamed("rows", "own"), sized, ["cid"], "rows", max(1, recs.count()), how="left")
    links = F.col("own") - 1 + F.coalesce("far", F.lit(0))
    return out.select("id", F.col("cid").alias("class_id"), F.coalesce("group", "cid").alias("group_id"), links.cast("long").alias("links"))
