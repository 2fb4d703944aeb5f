"""Metrics over scored records.

The input of most operators is long form: one row per record and label with
``gold`` (0/1) and ``score``.  A sweep over thresholds never joins scores with the
grid: a score is put into the bucket of the highest threshold it reaches, buckets
are counted, and counts are summed from the top, so the cost is one aggregate
whatever the size of the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import with_running


def grid(first: int, last: int, step: float) -> list[float]:
    """round(step x i, 2) for i = first..last."""
    return [round(step * i, 2) for i in range(first, last + 1)]


GRID_18, GRID_19, GRID_49, GRID_99 = grid(1, 18, 0.05), grid(1, 19, 0.05), grid(1, 49, 0.02), grid(1, 99, 0.01)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return df.withColumn("f1", f1)


def confusion(scores: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 at one threshold."""
    hit, gold = F.col("score") >= threshold, F.col("gold") == 1
    got = scores.groupBy(*(by or [])).agg(F.count_if(hit & gold).alias("tp"), F.count_if(hit & ~gold).alias("fp"), F.count_if(~hit & gold).alias("fn"), F.count_if(~hit & ~gold).alias("tn"))
    return _rates(got)


def reached(score: Column, thresholds: list[float]) -> Column:
    """The number of thresholds (rising) that a score reaches; null for a null score.

    The place on an even grid is arithmetic, put right by comparing with the
    thresholds themselves; other grids are counted through.
    """
    n, step = len(thresholds), (thresholds[-1] - thresholds[0]) / max(1, len(thresholds) - 1)
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    if n < 2 or any(abs(t - thresholds[0] - i * step) > step / 4 for i, t in enumerate(thresholds)):
        return sum(((score >= t).cast("int") for t in thresholds), F.lit(0))
    near = F.least(F.greatest(F.floor((score - thresholds[0]) / step).cast("int") + 1, F.lit(0)), F.lit(n))
    up = F.coalesce(F.get(steps, near) <= score, F.lit(False)).cast("int")
    down = F.coalesce(F.get(steps, near - 1) > score, F.lit(False)).cast("int")
    return F.when(score.isNotNull(), near + up - down)


def sweep(scores: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates at every threshold of the grid; NaN reaches all, rows without a score none."""
    by = by or []
    steps = F.array(*[F.lit(t) for t in thresholds])
    bucket = F.coalesce(F.when(F.isnan("score"), F.lit(len(thresholds))).otherwise(reached(F.col("score"), thresholds)), F.lit(0))
    counts = scores.groupBy(*by, bucket.alias("_b")).agg(F.count_if(F.col("gold") == 1).alias("_p"), F.count_if(F.col("gold") == 0).alias("_n"))
    # at most (labels x (thresholds + 1)) rows from here
    cells = counts.groupBy(*by).agg(F.collect_list(F.struct("_b", "_p", "_n")).alias("_cells"))
    at = cells.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    total = lambda cond, c: F.aggregate(F.filter("_cells", cond), F.lit(0).cast("long"), lambda a, x: a + x[c])
    hit, missed = (lambda x: x["_b"] >= F.col("_i")), (lambda x: x["_b"] < F.col("_i"))
    out = at.select(*by, F.element_at(steps, F.col("_i")).alias("threshold"), total(hit, "_p").alias("tp"), total(hit, "_n").alias("fp"), total(missed, "_p").alias("fn"), total(missed, "_n").alias("tn"))
    return _rates(out)


def best_f1(swept: DataFrame, by: list[str] | None = None, rounded: int | None = None, strict: float | None = None) -> DataFrame:
    """The lowest threshold of greatest F1 (``rounded`` to digits first, where asked).

    With ``strict`` a threshold must beat an F1 of 0, else ``strict`` is the threshold.
    """
    f1 = F.bround("f1", rounded) if rounded is not None else F.col("f1")
    out = swept.groupBy(*(by or [])).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall", "tp", "fp", "fn"), F.struct(f1, -F.col("threshold"))).alias("_b")).select(*(by or []), "_b.*")
    return out if strict is None else out.withColumn("threshold", F.when(F.col("f1") > 0, F.col("threshold")).otherwise(strict))


def recall_threshold(swept: DataFrame, by: list[str] | None = None, target: float = 0.90, mode: str = "highest") -> DataFrame:
    """The highest (or lowest) threshold whose recall reaches the target, else that of the best F1."""
    by = by or []
    pick = F.max if mode == "highest" else F.min
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return swept.groupBy(*by).agg(F.coalesce(pick(F.when(F.col("recall") >= target, F.col("threshold"))), best).alias("threshold"))


def precision_threshold(swept: DataFrame, by: list[str] | None = None, target: float = 0.90) -> DataFrame:
    """The highest threshold whose precision reaches the target, else that of the best F1."""
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return swept.groupBy(*(by or [])).agg(F.coalesce(F.max(F.when(F.col("precision") >= target, F.col("threshold"))), best).alias("threshold"))


def at_threshold(swept: DataFrame, threshold: float) -> DataFrame:
    """The rows of one threshold (route floor)."""
    return swept.filter(F.col("threshold") == threshold)


def review_block(swept: DataFrame, by: list[str]) -> DataFrame:
    """review = best F1 (default 0.5), block = max(review, lowest threshold of precision >= 0.95, default 0.8).

    A qualifying threshold of exactly 0.8 is replaced by the next qualifying one, as
    the search takes 0.8 for "none yet".
    """
    review = best_f1(swept, by, strict=0.5).select(*by, F.col("threshold").alias("review"))
    ok = F.array_sort(F.collect_list(F.when(F.col("precision") >= 0.95, F.col("threshold"))))  # at most one entry a threshold
    low = swept.groupBy(*by).agg(ok.alias("_ok"))
    first = F.try_element_at("_ok", F.lit(1))
    after = F.try_element_at("_ok", F.lit(2))
    start = F.when(first == 0.8, F.coalesce(after, F.lit(0.8))).otherwise(F.coalesce(first, F.lit(0.8)))
    # from its second value on the search only goes down, and thresholds only go up
    j = review.join(low, by)
    return j.select(*by, F.lit(0.20).alias("route"), "review", F.greatest("review", start).alias("block"))


def average_precision(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores, from the top, of (gain in recall) x precision; null unless both classes occur."""
    by = by or []
    at = scores.groupBy(*by, (-F.col("score")).alias("_down")).agg(F.sum("gold").alias("_p"), F.count(F.lit(1)).alias("_n"))
    r = with_running(at, by, "_down", {"_p": "_tp", "_n": "_all"})
    # the sum over positives p x precision, divided by their number at the end
    part = F.col("_p") * (F.col("_tp") + F.col("_p")) / (F.col("_all") + F.col("_n"))
    pos, tot = F.sum("_p"), F.sum("_n")
    return r.groupBy(*by).agg(F.when((pos > 0) & (pos < tot), F.sum(part) / pos).alias("pr_auc"))


def roc_auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank statistic with ties averaged; null unless both classes occur."""
    by = by or []
    at = scores.groupBy(*by, "score").agg(F.sum("gold").alias("_p"), F.sum(1 - F.col("gold")).alias("_q"))
    r = with_running(at, by, "score", {"_q": "_below"})
    won = F.sum(F.col("_p") * (2 * F.col("_below") + F.col("_q")))  # twice the pairs won, exact
    return r.groupBy(*by).agg((won / (2 * F.nullif(F.sum("_p"), F.lit(0)) * F.nullif(F.sum("_q"), F.lit(0)))).alias("roc_auc"))


def macro(metrics: DataFrame, columns: list[str], support: str = "support") -> DataFrame:
    """Means over the labels with support, nulls left out."""
    return metrics.agg(*[F.avg(F.when(F.col(support) > 0, F.col(c))).alias(f"macro_{c}") for c in columns], F.count_if(F.col(support) > 0).alias("labels"))


def micro_macro(scores: DataFrame, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """Micro and macro F1 at a threshold over all labels."""
    per = confusion(scores, threshold, [label])
    micro = _rates(per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))).select(F.col("f1").alias("micro_f1"))
    return micro.crossJoin(F.broadcast(per.agg(F.avg("f1").alias("macro_f1"))))  # single rows


def head_predictions(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``predicted`` and ``top1`` to records (id, gold array, scores array<struct<label, score>>).

    Labels at or above the threshold, or the top label if there is none; ties go to
    the label first by name.
    """
    best = F.array_max(F.transform("scores", lambda s: s["score"]))
    top = F.array_min(F.transform(F.filter("scores", lambda s: s["score"] == best), lambda s: s["label"]))
    hits = F.transform(F.filter("scores", lambda s: s["score"] >= threshold), lambda s: s["label"])
    return records.withColumn("top1", top).withColumn("predicted", F.when(F.size(hits) > 0, hits).otherwise(F.array_compact(F.array(top))))


def head_report(predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-label precision / recall / F1 / support, and the confusion (gold joined with ``|``, top1, n).

    Gold and predicted labels are compared in the row; only counts by label are shuffled.
    """
    each = F.explode(F.transform(F.array_union("gold", "predicted"), lambda x: F.struct(x.alias("label"), F.array_contains("gold", x).alias("g"), F.array_contains("predicted", x).alias("p"))))
    one = predicted.select(each.alias("e")).select("e.*").filter("label is not null")
    per = _rates(one.groupBy("label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g")).alias("fp"), F.count_if(~F.col("p")).alias("fn")))
    per = per.withColumn("support", F.col("tp") + F.col("fn"))
    table = predicted.groupBy(F.array_join(F.array_sort("gold"), "|").alias("gold"), "top1").agg(F.count(F.lit(1)).alias("n"))
    return per, table


def head_summary(predicted: DataFrame) -> DataFrame:
    """Top-1-in-gold accuracy, macro F1 and support-weighted F1."""
    per, _ = head_report(predicted)
    s = per.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"))
    a = predicted.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.array_contains("gold", F.col("top1"))).alias("top1_right"))
    return a.crossJoin(F.broadcast(s))  # single rows


def gate_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Gate metrics over rows (gate double, unsafe boolean): routed if gate >= threshold."""
    s = sweep(scored.select(F.col("gate").alias("score"), F.col("unsafe").cast("int").alias("gold")), thresholds)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    unsafe, safe, passed = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"), F.col("fn") + F.col("tn")
    return s.select(
        "threshold", total.alias("total"), safe.alias("safe_total"), unsafe.alias("unsafe_total"), passed.alias("passed"), (F.col("tp") + F.col("fp")).alias("routed"), ratio(passed, total).alias("pass_pct"),
        ratio(F.col("tp") + F.col("fp"), total).alias("call_pct"), F.col("fn").alias("false_pass"), F.col("tn").alias("true_pass"), ratio(F.col("fn"), unsafe).alias("unsafe_miss_rate"),
        ratio(F.col("fn"), total).alias("false_pass_rate_all"), ratio(F.col("tn"), safe).alias("safe_pass_rate"), F.col("precision").alias("route_precision"), F.col("recall").alias("route_recall"), F.col("f1").alias("route_f1"),
    )


def gate_choice(gates: DataFrame, target: float = 0.005) -> DataFrame:
    """Among thresholds that miss at most ``target``: most passed (4 digits), then the highest; else the lowest threshold."""
    ok = F.bround("unsafe_miss_rate", 4) <= target
    best = F.max_by("threshold", F.when(ok, F.struct(F.bround("pass_pct", 4), "threshold")))
    return gates.agg(F.coalesce(best, F.min("threshold")).alias("threshold"))


def fast_allow(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rows (attack, moderation doubles; is_attack, is_moderation booleans) skipped when both scores are below."""
    top = F.greatest("attack", "moderation")
    cells = scored.groupBy(F.coalesce(reached(top, thresholds), F.lit(0)).alias("_b"), "is_attack", "is_moderation").agg(F.count(F.lit(1)).alias("_n"))
    g = cells.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(thresholds)], "_i int, threshold double")
    j = cells.crossJoin(F.broadcast(g))  # cells: at most 4 x (thresholds + 1) rows
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    skip, a, m = F.col("_b") < F.col("_i"), F.col("is_attack"), F.col("is_moderation")
    out = j.groupBy("threshold").agg(n(F.lit(True)).alias("total"), n(skip).alias("skipped"), n(skip & (a | m)).alias("false_pass"), n(skip & a).alias("missed_attack"), n(skip & m).alias("missed_moderation"), n(a | m).alias("unsafe"), n(a).alias("attacks"), n(m).alias("moderations"))
    return out.select("threshold", "skipped", "false_pass", "missed_attack", "missed_moderation", ratio(F.col("skipped"), F.col("total")).alias("skip_pct"), ratio(F.col("false_pass"), F.col("unsafe")).alias("unsafe_miss_rate"), ratio(F.col("missed_attack"), F.col("attacks")).alias("missed_attack_rate"), ratio(F.col("missed_moderation"), F.col("moderations")).alias("missed_moderation_rate"))


def route_thresholds(swept: DataFrame, by: list[str], target: float = 0.97, step: float = 0.02) -> DataFrame:
    """One step below the first threshold whose recall falls under the target, at least one step."""
    first = F.coalesce(F.min(F.when(F.col("recall") < target, F.col("threshold"))), F.lit(step))
    return swept.groupBy(*by).agg(F.greatest(F.lit(step), first - step).alias("threshold"))


def score_drift(a: DataFrame, b: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """Largest and mean absolute difference of two score tables, and how often both are on one side of 0.5."""
    j = a.select(*key, F.col(score).alias("_a")).join(b.select(*key, F.col(score).alias("_b")), key)
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"), F.avg(((F.col("_a") >= 0.5) == (F.col("_b") >= 0.5)).cast("double")).alias("agreement"))


def smallest_within(candidates: DataFrame, f1_drop: float = 0.002, auc_drop: float = 0.002, otherwise: str = "fp32") -> DataFrame:
    """The smallest candidate (name, size_bytes, best_f1_drop, pr_auc_drop) within both tolerances, else ``otherwise``."""
    ok = (F.col("best_f1_drop") <= f1_drop) & (F.col("pr_auc_drop") <= auc_drop)
    return candidates.agg(F.coalesce(F.min_by("name", F.when(ok, F.struct("size_bytes", "name"))), F.lit(otherwise)).alias("name"))


def metric_diff(a: DataFrame, b: DataFrame, key: str, metrics: list[str], warn: str = "macro_f1", drop: float = 0.03) -> DataFrame:
    """b - a of each metric, and WARN where ``warn`` falls by more than ``drop``."""
    j = a.alias("a").join(b.alias("b"), key)
    out = j.select(key, *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_delta") for m in metrics])
    return out.withColumn("status", F.when(F.col(f"{warn}_delta") < -drop, "WARN").otherwise("PASS"))
