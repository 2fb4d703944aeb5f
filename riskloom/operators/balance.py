"""Caps, samples and augmentation.

Random choices use the order of ``sha2(seed:hash)`` and are repeatable on any
cluster.  Greedy caps are running sums by budget (a two-level prefix, see
``plans.prefix``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import taxonomy as T
from ..functions.labels import head_labels, literal_list, literal_map
from ..plans.prefix import with_running


#: Rows that a top-k may hold in one task.
TOP_K = 100_000


def resolve_cap(head: str, split: str, env: dict[str, str] | None = None) -> int:
    """Cap per label: by head, then overall, then the older name, then the default; 0 is no cap; an eighth outside train."""
    env = os.environ if env is None else env
    value = None
    for name in (f"SC_MAX_PER_LABEL_{head.upper()}", "SC_MAX_PER_LABEL", "SC_MAX_SAFE_PER_HEAD"):
        try:
            value = int(env[name])
            break
        except (KeyError, ValueError):
            continue
    value = T.HEAD_CAPS.get(head, 25_000) if value is None else value
    return 0 if value <= 0 else value if split == "train" else max(value // 8, 1)


def shuffled(hash_col: Column, seed: int = 13) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), hash_col), 256)


def head_projection(df: DataFrame) -> DataFrame:
    """A row for each record and head with labels there: columns of ``df``, head, head_labels."""
    sources = F.col("sources") if "sources" in df.columns else None
    each = F.array(*[F.struct(F.lit(h).alias("head"), head_labels(F.col("labels"), h, sources).alias("head_labels")) for h in T.HEADS])
    out = df.withColumn("_h", F.explode(each))
    return out.withColumn("head", F.col("_h.head")).withColumn("head_labels", F.col("_h.head_labels")).drop("_h").filter(F.size("head_labels") > 0)


def shared_budget_cap(projected: DataFrame, order: str, cap: Column, partition: list[str]) -> DataFrame:
    """Labels of each row that are under their cap, in ``order``: (partition, order, label).

    Labels with a shared budget (hate and toxicity) use it up together, a row with
    both takes two.  Within a budget a row's labels all see the rows before it, so
    the greedy rule is exactly: sum of the labels written before < cap.
    """
    one = projected.select(*partition, order, cap.alias("_cap"), F.explode("head_labels").alias("label"))
    budget = F.coalesce(F.try_element_at(literal_map(T.SHARED_BUDGET), F.col("label")), F.col("label"))
    one = one.withColumn("budget", budget)
    per_row = one.groupBy(*partition, "budget", order).agg(F.count(F.lit(1)).alias("_w"), F.first("_cap").alias("_cap"))
    kept = with_running(per_row, [*partition, "budget"], order, {"_w": "before"}).filter((F.col("_cap") <= 0) | (F.col("before") < F.col("_cap")))
    return one.join(kept.select(*partition, "budget", order), [*partition, "budget", order]).select(*partition, order, "label")


def any_label_cap(df: DataFrame, order: str, labels: str, names: list[str], cap: int, shared: dict[str, str] | None = None) -> DataFrame:
    """Rows kept while any of their labels is under its cap; a kept row counts for all its labels.

    As long as a budget is open every row that has it is kept, so what it has used
    before a row is the number of its labels in all earlier rows, whatever the other
    budgets do: a running sum for each budget, and no fold over the corpus.
    """
    shared = shared or {}
    budget = F.create_map(*[F.lit(x) for n in names for x in (n, shared.get(n, n))])
    mine = F.filter(F.array_distinct(F.col(labels)), lambda x: x.isin(names))
    one = df.select(F.col(order).alias("_o"), F.explode(F.transform(mine, lambda x: F.element_at(budget, x))).alias("_g"))
    per = one.groupBy("_g", "_o").agg(F.count(F.lit(1)).alias("_w"))
    kept = with_running(per, ["_g"], "_o", {"_w": "_before"}).filter(F.col("_before") < cap).select(F.col("_o").alias(order)).distinct()
    return df.join(kept, order, "left_semi")


def top_by(df: DataFrame, partition: list[str], order: list[Column], most: int | Column) -> DataFrame:
    """The first ``most`` rows of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def first_n(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows overall (a top-k, never a full sort)."""
    return df.orderBy(*order).limit(most)


def first_rows(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in ascending order, however many: a top-k while it fits one task, else by running counts over ranges."""
    if most <= TOP_K:
        return first_n(df, order, most)
    d = df.withColumn("_o", F.struct(*order)).withColumn("_one", F.lit(1))
    return with_running(d, [], "_o", {"_one": "_before"}).filter(F.col("_before") < most).select(*df.columns)


def safe_downsample(df: DataFrame, most: int, hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """All rows with a risk label and ``most`` of the others (0: all)."""
    risk = F.coalesce(F.arrays_overlap("labels", literal_list(T.RISK)), F.lit(False))
    safe = df.filter(~risk)
    return df.filter(risk).unionByName(first_rows(safe, [shuffled(F.col(hash_col), seed), F.col(hash_col)], most) if most else safe)


def hard_negatives(df: DataFrame, positive: Column, ratio: int = 6, hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """All positives and max(positives x ratio, 1) of the others."""
    n = df.agg(F.count_if(positive).alias("n")).first()["n"]
    return df.filter(positive).unionByName(first_rows(df.filter(~F.coalesce(positive, F.lit(False))), [shuffled(F.col(hash_col), seed)], max(n * ratio, 1)))


def ratio_cap(positives: int, safe: int, ratio: float, cap: int) -> int:
    return min(safe, cap, int(max(positives, 1) * ratio))


def stratified_sample(df: DataFrame, names: list[str], most: int, hash_col: str = "hash", parts: int | None = None, fill_order: Column | None = None) -> DataFrame:
    """Per label the first max(1, most // parts) rows by hash, then others up to ``most``.

    ``parts`` defaults to the number of labels + 1.  A row of several labels counts
    once.  Rows with equal hash are one row (the hash is the key).
    """
    each = max(1, most // (parts or len(names) + 1))
    one = df.select(hash_col, F.explode(F.array_intersect("labels", literal_list(names))).alias("_l"))
    picked = top_by(one, ["_l"], [F.col(hash_col)], each).select(hash_col).distinct()
    a = df.join(picked, hash_col, "left_semi")
    room = max(0, most - picked.count())  # at most labels x each rows
    rest = df.join(picked, hash_col, "left_anti")
    return a.unionByName(first_rows(rest, [fill_order if fill_order is not None else F.col(hash_col), F.col(hash_col)], room))


def cap_pairs(df: DataFrame, per_source: int, ratio: float = 2.5, label: str = "label", source: str = "source", hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """Positives and negatives with at most ``per_source`` rows of a source each (0: all), negatives first cut to positives x ratio.

    Both are in the order of a seeded hash; the ratio goes by the positives before their cap.
    """
    order = [shuffled(F.col(hash_col), seed), F.col(hash_col)]
    pos, neg = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    n = pos.agg(F.count(F.lit(1))).first()[0]
    neg = first_rows(neg, order, int(max(n, 1) * ratio))
    both = pos.unionByName(neg)
    return top_by(both, [label, source], order, per_source) if per_source else both


def cap_safe_rows(df: DataFrame, safe: Column, most: int, ratio: float, hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """All other rows and the first min(rows, most, others x ratio) safe ones in the order of a seeded hash."""
    c = df.agg(F.count_if(safe).alias("safe"), F.count_if(~F.coalesce(safe, F.lit(False))).alias("rest")).first()
    keep = ratio_cap(c["rest"], c["safe"], ratio, most)
    is_safe = F.coalesce(safe, F.lit(False))
    return df.filter(~is_safe).unionByName(first_rows(df.filter(is_safe), [shuffled(F.col(hash_col), seed), F.col(hash_col)], keep))


def blend(df: DataFrame, other: DataFrame | None, hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """Rows of both sets with ``place``, a key to order them by: a repeatable shuffle without a sort of its own."""
    both = df if other is None else df.unionByName(other, allowMissingColumns=True)
    return both.withColumn("place", shuffled(F.coalesce(hash_col, F.lit("")), seed))


def source_cap(df: DataFrame, most: int, source: str = "source", order: Column | None = None) -> DataFrame:
    return top_by(df, [source], [order if order is not None else F.col("ord")], most)


def balanced_sample(df: DataFrame, label: str, most: int, order: list[Column]) -> DataFrame:
    """most // 2 positives and the rest negatives."""
    half = most // 2
    return first_rows(df.filter(F.col(label) == 1), order, half).unionByName(first_rows(df.filter(F.col(label) == 0), order, most - half))


def oversample(df: DataFrame, names: list[str], target: int, room: int | None = None, hash_col: str = "hash", source: str = "source", seed: int = 13, tag: str = "low_label_oversample") -> DataFrame:
    """Copies for labels (in order) with fewer than ``target`` rows, going round their shuffled rows.

    A copy counts for all its labels, so the labels are worked through one by one;
    the driver holds one count a label, copies are made by replication.
    """
    def counts(d: DataFrame) -> dict[str, int]:
        r = d.agg(*[F.count_if(F.array_contains("labels", n)).alias(n) for n in names]).first().asDict()
        return {k: int(v or 0) for k, v in r.items()}

    left = (1 << 60) if room is None else room
    natural = counts(df)
    have = dict(natural)
    out = df
    for n in names:
        need = min(max(0, target - have[n]), left)
        if not natural[n] or need <= 0:
            continue
        mine = df.filter(F.array_contains("labels", n))
        full, rest = divmod(need, natural[n])
        first = first_rows(mine, [shuffled(F.col(hash_col), seed), F.col(hash_col)], rest).select(hash_col).withColumn("_more", F.lit(1)) if rest else None
        reps = mine.join(first, hash_col, "left") if first is not None else mine.withColumn("_more", F.lit(0))
        copies = reps.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(full) + F.coalesce("_more", F.lit(0))))).filter("_k > 0")
        copies = copies.withColumn(source, F.concat(F.coalesce(source, F.lit("")), F.lit(f"::{tag}"))).withColumn(hash_col, F.concat(hash_col, F.lit(f"::oversample::{n}::"), F.col("_k"))).drop("_k", "_more")
        for k, v in counts(copies).items():
            have[k] += v
        left -= need
        out = out.unionByName(copies)
    return out


def fold_into_train(df: DataFrame, names: list[str], target: int, split: str = "split", source: str = "source") -> DataFrame:
    """Move val and test rows of labels with few training rows into train; adds ``folded_from_split``."""
    r = df.filter(F.col(split) == "train").agg(*[F.count_if(F.array_contains("labels", n)).alias(n) for n in names]).first().asDict()
    low = [n for n in names if 0 < (r[n] or 0) < target]
    move = (F.col(split) != "train") & F.coalesce(F.arrays_overlap("labels", literal_list(low)), F.lit(False)) if low else F.lit(False)
    return (
        df.withColumn("folded_from_split", F.when(move, F.col(split)))
        .withColumn(source, F.when(move, F.concat(F.coalesce(source, F.lit("")), F.lit("::folded_from_"), F.col(split))).otherwise(F.col(source)))
        .withColumn(split, F.when(move, F.lit("train")).otherwise(F.col(split)))
    )


def route_balance(df: DataFrame, cap: int, train: bool, hash_col: str = "hash", seed: int = 13) -> DataFrame:
    """Balance attack, moderation and safe rows (column ``route_labels``); in train attack rows are repeated."""
    most = cap if train else max(cap // 8, 1)
    order = [shuffled(F.col(hash_col), seed), F.col(hash_col)]
    attack = df.filter(F.array_contains("route_labels", "attack"))
    rest = df.filter(~F.array_contains("route_labels", "attack"))
    mod = first_rows(rest.filter(F.array_contains("route_labels", "moderation")), order, most)
    safe = first_rows(rest.filter(F.array_contains("route_labels", T.SAFE)), order, most)
    if not train:
        return attack.unionByName(mod).unionByName(safe)
    n, kept = attack.count(), mod.count() + safe.count()
    target = min(most, max(n, kept // 3))
    if n:
        full, more = divmod(target, n)
        whole = attack.crossJoin(F.broadcast(attack.sparkSession.range(full).select())) if full != 1 else attack  # ``full`` empty rows
        attack = whole.unionByName(first_rows(attack, order, more)) if more else whole
    return attack.unionByName(mod).unionByName(safe)


# How positive texts are varied.
_ZERO_WIDTH = {"ignore": "ign\u200bore", "previous": "prev\u200bious", "instructions": "instr\u200buctions", "system": "sys\u200btem", "prompt": "pro\u200bmpt", "jailbreak": "jail\u200bbreak"}
_SPACED = {"ignore": "i g n o r e", "bypass": "b y p a s s", "jailbreak": "j a i l b r e a k"}


def augment(text: Column, most: int = 2) -> Column:
    """Up to ``most`` distinct variants, none equal to the text: masked, with zero-width characters, spaced.

    Masked: of texts of six words or more, words 2, 11, 20, ... of over three letters become [MASK].
    """
    w = F.filter(F.split(text, r"(?U)[\s\x{1C}-\x{1F}]+"), lambda x: x != "")
    mask = lambda x, i: F.when((i % 9 == 2) & (F.length(x) > 3) & x.rlike(r"^\p{L}+$"), F.lit("[MASK]")).otherwise(x)
    masked = F.when(F.size(w) >= 6, F.array_join(F.transform(w, mask), " ")).otherwise(text)
    variants = [masked]
    for table in (_ZERO_WIDTH, _SPACED):
        v = text
        for a, b in table.items():
            v = F.replace(F.replace(v, F.lit(a), F.lit(b)), F.lit(a.title()), F.lit(b))
        variants.append(v)
    fresh = F.filter(F.array_distinct(F.array(*variants)), lambda v: (v != text) & (v != ""))
    return F.slice(fresh, 1, most)


def class_weights(df: DataFrame, names: list[str], lo: float = 1.0, hi: float = 30.0) -> DataFrame:
    """(label, positives, negatives, weight): sqrt(negatives / positives) within [lo, hi]."""
    n = F.count(F.lit(1))
    got = df.agg(n.alias("_n"), *[F.count_if(F.array_contains("labels", x)).alias(x) for x in names])
    each = got.select("_n", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("positives")) for x in names])).alias("v")).select("_n", "v.*")
    ratio = F.sqrt(F.greatest(F.col("_n") - F.col("positives"), F.lit(1)) / F.greatest("positives", F.lit(1)))
    return each.select("label", "positives", (F.col("_n") - F.col("positives")).alias("negatives"), F.greatest(F.least(ratio, F.lit(hi)), F.lit(lo)).alias("weight"))
