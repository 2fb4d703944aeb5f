"""Problem 8: fill containers of fixed capacity with documents.

Linear grouping.  Sizes are whole tokens, so the corpus is first a histogram of at
most ``capacity`` sizes, which is all the driver ever holds.  Sizes above
SMALL x capacity are large: in falling order they are divided into groups of equal
cardinality, and every size is rounded up to the largest of its group.  With so few
sizes, configurations (how many of each group share a container) are optimised:
again and again the configuration that fills a container best with what is still
to be placed is found by dynamic programming and used as often as it fits.  Actual
documents are then substituted: the i-th document of a group takes the i-th place
of that group in the list of configurations, a range lookup, so that documents are
numbered but never gathered.  Small documents are put by best fit into the room that
is left, in independent blocks of containers and documents.

A document larger than the capacity fills whole containers of its own and its rest
is placed like any document; no other document is divided.

Skew: the number within a size is a two-level prefix (counts by size and hash bucket,
then a window in the bucket, with more buckets for sizes of many documents), blocks
have at most about BLOCK documents.

Defined results: a document without tokens (null or empty text) is a small document
of size 0 and has a container too; documents of one size are ordered by hash and id;
an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import fits, hash63
from ..plans.staging import stage

#: Documents of at most this share of the capacity are small.
SMALL = 0.1
#: Groups of large sizes.
GROUPS = 24
#: Small documents in a block, about; the room of a block's containers is filled independently.
BLOCK = 20_000
#: Documents of one size that are numbered in one window, about.
IN_BUCKET = 50_000


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """[(times, how many of each size)] that place all ``counts`` of ``sizes``.

    Each round takes the fullest configuration under the remaining counts (bounded
    knapsack by dynamic programming; of equals the one with the larger items) and
    repeats it while the counts allow.
    """
    left = counts.astype(np.int64).copy()
    order = np.argsort(-sizes)
    out: list[tuple[int, np.ndarray]] = []
    while left.any():
        seed = next(i for i in order if left[i])  # the largest size still to be placed is in it
        room = capacity - int(sizes[seed])
        left[seed] -= 1
        reach = np.full(room + 1, -1, dtype=np.int64)  # the item that completes a sum, by largest item first
        reach[0] = len(sizes)
        for i in order:
            s = int(sizes[i])
            if not left[i] or s > room:
                continue
            open_ = reach >= 0
            used = np.zeros(room + 1, dtype=np.int64)
            fresh = np.zeros(room + 1, dtype=bool)
            for _ in range(int(min(left[i], room // s))):  # each pass adds one more item of this size
                grown = np.zeros(room + 1, dtype=bool)
                base = open_ if not fresh.any() else fresh
                grown[s:] = base[:-s] & ~open_[s:]
                if not grown.any():
                    break
                reach[grown] = i
                used[grown] += 1
                open_ |= grown
                fresh = grown
        best = int(np.flatnonzero(reach >= 0).max())
        pattern = np.zeros(len(sizes), dtype=np.int64)
        pattern[seed] = 1
        at = best
        while at > 0:
            i = int(reach[at])
            pattern[i] += 1
            at -= int(sizes[i])
        left[seed] += 1
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((times, pattern))
        left -= times * pattern
    return out


def plan(histogram: pd.DataFrame, capacity: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """Places of large documents.

    Returns (size -> group, start number in the group), the ranges of places
    (group, from, to, container of the first, places in a container), and the
    number of containers.  ``histogram``: size, n, for sizes up to the capacity.
    """
    h = histogram[histogram["size"] > SMALL * capacity].sort_values("size", ascending=False)
    total = int(h["n"].sum())
    none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("group", "lo", "hi", "container", "each")})
    if not total:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("size", "group", "start")}), none, 0
    per = max(1, -(-total // GROUPS))
    before = h["n"].cumsum() - h["n"]
    group = (before // per).astype("int64")
    group = group.rank(method="dense").astype("int64") - 1
    places = pd.DataFrame({"size": h["size"].astype("int64"), "group": group, "start": before - before.groupby(group).transform("min")})
    top = places.groupby("group")["size"].max()
    counts = h["n"].groupby(group).sum()
    rows, filled, containers = [], np.zeros(len(top), dtype=np.int64), 0
    for times, pattern in configurations(top.to_numpy(), counts.to_numpy(), capacity):
        for g in np.flatnonzero(pattern):
            rows.append((int(g), int(filled[g]), int(filled[g] + times * pattern[g]), containers, int(pattern[g])))
            filled[g] += times * pattern[g]
        containers += times
    return places, pd.DataFrame(rows, columns=["group", "lo", "hi", "container", "each"]), containers


def _numbered(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``k``: 0-based number of each document among those of its specification and size.

    ``counts`` (spec, size, n, ...; a row a size, broadcast) adds its columns.  The hash
    buckets of a size grow with its documents, so that no window holds many more than
    IN_BUCKET of them.
    """
    nb = F.greatest(F.lit(1), F.expr(f"n div {IN_BUCKET}"))
    d = docs.join(F.broadcast(counts), ["spec", "size"]).withColumn("_h", hash63("id", seed=11)).withColumn("_b", F.col("_h") % nb)
    cells = d.groupBy("spec", "size", "_b").agg(F.count(F.lit(1)).alias("_n"))  # a row for some IN_BUCKET documents
    before = Window.partitionBy("spec", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("spec", "size", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("spec", "size", "_b").orderBy("_h", "id")
    return d.withColumn("_r", F.row_number().over(within)).join(starts, ["spec", "size", "_b"]).withColumn("k", F.col("_start") + F.col("_r") - 1).drop("_h", "_b", "_r", "_start", "n")


def _best_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fill the room of a block's containers with its small documents, largest first."""
    from bisect import bisect_left, insort

    spec, block, capacity = (int(pdf[c].iloc[0]) for c in ("spec", "block", "capacity"))
    boxes = pdf[pdf["kind"] == 0].sort_values("container")
    docs = pdf[pdf["kind"] == 1].sort_values(["size", "id"], ascending=[False, True])
    rooms = sorted((capacity - int(s), int(c)) for c, s in zip(boxes["container"], boxes["size"]) if s < capacity)
    out, opened = [], 0
    for doc, size, part in zip(docs["id"], docs["size"], docs["part"]):
        at = bisect_left(rooms, (int(size), -(1 << 62)))
        if at < len(rooms):
            room, box = rooms.pop(at)
        else:
            opened += 1
            room, box = capacity, -(block * (1 << 24) + opened)  # named after all blocks are done
        out.append((spec, doc, box, size, part))
        if room > size:
            insort(rooms, (room - int(size), box))
        elif room == 0:
            rooms.insert(0, (0, box))
    return pd.DataFrame(out, columns=["spec", "id", "box", "size", "part"])


def _whole(d: DataFrame) -> DataFrame:
    """Containers that a document fills alone, numbered with a two-level prefix by hash bucket."""
    wholes = d.filter("full > 0").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(1024)))
    cells = wholes.groupBy("spec", "_b").agg(F.sum("full").alias("_n"))
    ahead = Window.partitionBy("spec").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows
    cells = cells.select("spec", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    run = Window.partitionBy("spec", "_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    wholes = wholes.withColumn("_before", F.coalesce(F.sum("full").over(run), F.lit(0))).join(F.broadcast(cells), ["spec", "_b"])
    split = wholes.select("spec", "capacity", (F.col("_start") + F.col("_before")).alias("_c"), "id", F.posexplode(F.sequence(F.lit(1), F.col("full"))))
    return split.select("spec", (F.col("_c") + F.col("pos")).alias("container"), "id", F.col("pos").cast("int").alias("part"), F.col("capacity").alias("size"))


def pack_specs(docs: DataFrame, specs: list[tuple[int, int]], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(spec, container, id, part, size): for each (spec, capacity) every document in one container, larger ones in several.

    All specifications go through the same few stages.  ``container`` counts from 0
    without gaps for whole and large documents; those opened for small documents
    follow with the number of their block.
    """
    spark = docs.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("whole")).withColumn("_s", each).select("id", "whole", "_s.*")
    d = d.withColumn("full", F.expr("whole div capacity")).withColumn("size", F.col("whole") % F.col("capacity"))
    d = stage(d.withColumn("large", F.col("size") > SMALL * F.col("capacity")), "p8-sizes")
    split = _whole(d)

    rest = d.filter("size > 0 or full = 0").select("spec", "capacity", "id", "size", F.col("full").cast("int").alias("part"), "large")
    histogram = rest.groupBy("spec", "size").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most the sum of the capacities
    base = {r["spec"]: int(r["f"]) for r in d.groupBy("spec").agg(F.sum("full").alias("f")).collect()}  # a row a specification
    places, ranges, info = [], [], []
    for spec, capacity in specs:
        h = histogram[histogram["spec"] == spec]
        p, r, boxes = plan(h[["size", "n"]], capacity)
        p = p.merge(h[["size", "n"]], on="size")
        places.append(p.assign(spec=spec))
        ranges.append(r.assign(spec=spec))
        small = int(h.loc[h["size"] <= SMALL * capacity, "n"].sum())
        info.append((spec, base.get(spec, 0), base.get(spec, 0) + boxes, max(1, -(-max(small, boxes // 4) // BLOCK))))
    group_of = spark.createDataFrame([tuple(map(int, x)) for p in places for x in p[["spec", "size", "group", "start", "n"]].itertuples(index=False)], "spec int, size long, group long, start long, n long")
    range_of = spark.createDataFrame([tuple(map(int, x)) for r in ranges for x in r[["spec", "group", "lo", "hi", "container", "each"]].itertuples(index=False)], "spec int, group long, lo long, hi long, container long, each long")
    spec_info = spark.createDataFrame(info, "spec int, base long, ahead long, blocks int")  # a row a specification

    # places have at most a row a size, ranges a few for each size
    n = _numbered(rest.filter("large").drop("large"), group_of).withColumn("i", F.col("start") + F.col("k"))
    hit = n.join(F.broadcast(range_of), ["spec", "group"]).filter("i >= lo and i < hi").join(F.broadcast(spec_info), "spec")
    placed = stage(hit.select("spec", "capacity", (F.col("container") + F.expr("(i - lo) div each") + F.col("base")).alias("container"), "id", "part", "size"), "p8-large")

    room = placed.groupBy("spec", "capacity", "container").agg(F.sum("size").alias("size"))
    block = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.col("blocks")).cast("int").alias("block")
    kind, none = docs.schema[id_col].dataType.simpleString(), F.lit(None)
    boxes = room.join(F.broadcast(spec_info), "spec").select("spec", "capacity", block("container"), F.lit(0).alias("kind"), "container", none.cast(kind).alias("id"), "size", none.cast("int").alias("part"))
    docs_ = rest.filter("not large").join(F.broadcast(spec_info), "spec").select("spec", "capacity", block("id"), F.lit(1).alias("kind"), none.cast("long").alias("container"), "id", "size", "part")
    fitted = stage(boxes.unionByName(docs_).groupBy("spec", "block").applyInPandas(_best_fit, f"spec int, id {kind}, box long, size long, part int"), "p8-small")
    # boxes opened in the blocks get the numbers after all others: at most one part-filled box a block
    new = fitted.filter("box < 0").select("spec", "box").distinct().withColumn("_blk", F.expr(f"(-box) div {1 << 24}"))
    per = new.groupBy("spec", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("spec").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    per = stage(per.select("spec", "_blk", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")), "p8-opened")
    fitted = fitted.withColumn("_blk", F.when(F.col("box") < 0, F.expr(f"(-box) div {1 << 24}"))).join(F.broadcast(per) if fits(per) else per, ["spec", "_blk"], "left").join(F.broadcast(spec_info), "spec")
    named = F.when(F.col("box") >= 0, F.col("box")).otherwise(F.col("ahead") + F.col("_start") + F.expr(f"(-box) % {1 << 24}") - 1)
    out = ["spec", "container", "id", "part", "size"]
    return split.unionByName(placed.select(*out)).unionByName(fitted.withColumn("container", named).select(*out))


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(container, id, part, size) for one capacity."""
    return pack_specs(docs, [(0, capacity)], id_col, size_col).drop("spec")


def pack_all(docs: DataFrame, specs: list[tuple[int, int]], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(spec_id, container_id, id, part, tokens) for each of the (few) specifications (spec_id, capacity)."""
    p = pack_specs(docs, specs, id_col, size_col)
    return p.select(F.col("spec").alias("spec_id"), F.col("container").cast("long").alias("container_id"), F.col("id").alias(id_col), "part", F.col("size").cast("int").alias("tokens"))


def faults(packed: DataFrame, docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(spec_id, documents, overfull, missing, wrong, split): what is wrong with a packing; all but documents should be 0.

    overfull: containers above the capacity; missing: documents without a container;
    wrong: documents whose parts do not add up; split: documents in several parts
    though they fit.
    """
    s = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    per = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(s), "spec_id")  # a row a specification
    over = per.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    parts = packed.groupBy("spec_id", id_col).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"), F.countDistinct("part").alias("q"))
    want = docs.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("w")).crossJoin(F.broadcast(s))
    j = want.join(parts, ["spec_id", id_col], "left")
    checked = j.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if((F.col("t") != F.col("w")) | (F.col("p") != F.col("q"))).alias("wrong"), F.count_if((F.col("p") > 1) & (F.col("w") <= F.col("capacity"))).alias("split"))
    return checked.join(F.broadcast(over), "spec_id")


def report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers used, the least number any packing needs, and the share of room left."""
    per = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("_t"))
    s = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("_t").cast("long").alias("tokens"), F.max("_t").cast("long").alias("fullest"))
    s = s.join(F.broadcast(specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens"))), "spec_id")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return s.withColumn("least", least).withColumn("room_left", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
