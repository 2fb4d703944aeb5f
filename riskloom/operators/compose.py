"""Evaluations composed of the metrics: models, heads, router, trainer, benchmarks, candidates.

Inputs are long scores (``gold`` 0/1, ``score``) with their grouping columns.  Scores
are counted by threshold bucket once for all thresholds; only tables of one row a
label (and threshold) are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import fits
from ..plans.staging import stage
from . import evaluate as E
from . import reports as R


def label_metrics(scores: DataFrame, by: list[str], thresholds: list[float] = E.GRID_18) -> DataFrame:
    """Per label with positives: support, rates at 0.5, best F1, high-recall threshold, PR-AUC and ROC-AUC (null with one class)."""
    swept = stage(E.sweep(scores, thresholds, by), "sweep")
    half = E.confusion(scores, 0.5, by).select(*by, (F.col("tp") + F.col("fn")).alias("support"), "precision", "recall", "f1")
    best = E.best_f1(swept, by).select(*by, F.col("threshold").alias("best_f1_threshold"), F.col("f1").alias("best_f1"))
    high = E.recall_threshold(swept, by).withColumnRenamed("threshold", "high_recall_threshold")
    out = half.join(best, by).join(high, by).join(E.average_precision(scores, by), by, "left").join(E.roc_auc(scores, by), by, "left")
    return out.filter("support > 0")


def model_baseline(scores: DataFrame, model: str = "model", label: str = "label", least: float = 0.5) -> DataFrame:
    """One row a model: labels evaluated, macro F1, macro best F1, macro PR-AUC; WARN where the macro best F1 is under ``least``."""
    m = label_metrics(scores, [model, label])
    out = m.groupBy(model).agg(F.count(F.lit(1)).alias("labels"), F.avg("f1").alias("macro_f1"), F.avg("best_f1").alias("macro_best_f1"), F.avg("pr_auc").alias("macro_pr_auc"))
    return out.withColumn("status", F.when(F.col("macro_best_f1") < least, "WARN").otherwise("PASS"))


def overall(models: DataFrame, expected: int) -> DataFrame:
    """FAIL if no model was evaluated, WARN if some are missing or weak, else PASS."""
    n = F.count(F.lit(1))
    return models.agg(F.when(n == 0, "FAIL").when((n < expected) | (F.count_if(F.col("status") != "PASS") > 0), "WARN").otherwise("PASS").alias("status"))


def trainer_metrics(scores: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Best F1 of each label, and one row: micro and macro F1 at 0.5, macro best F1, macro PR-AUC; six digits."""
    six = lambda c: F.round(c, 6)
    best = E.sweep(scores, E.GRID_19, [label]).groupBy(label).agg(six(F.max("f1")).alias("best_f1"))
    mean = best.agg(six(F.avg("best_f1")).alias("macro_best_f1"))
    auc = E.average_precision(scores, [label]).agg(six(F.coalesce(F.avg("pr_auc"), F.lit(0.0))).alias("macro_pr_auc"))
    half = E.micro_macro(scores, 0.5, label).select(six(F.col("micro_f1")).alias("micro_f1"), six(F.col("macro_f1")).alias("macro_f1"))
    return best, half.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(auc))  # single rows


def calibrate_heads(scores: DataFrame, by: list[str], safe: str = "safe") -> tuple[DataFrame, DataFrame]:
    """Thresholds of each head and label (best F1, lowest of high recall, highest of high precision), and the whole sweep.

    ``recommended`` is the route to be written; ``safe`` has none.
    """
    swept = stage(E.sweep(scores, E.GRID_18, by), "sweep")
    best = E.best_f1(swept, by).select(*by, F.col("threshold").alias("best_f1_threshold"), F.col("f1").alias("best_f1"))
    low = E.recall_threshold(swept, by, mode="lowest").withColumnRenamed("threshold", "high_recall_threshold")
    high = E.precision_threshold(swept, by).withColumnRenamed("threshold", "high_precision_threshold")
    out = best.join(low, by).join(high, by)
    return out.withColumn("recommended", F.when(F.col(by[-1]) != safe, F.col("high_recall_threshold"))), swept


def router_report(scored: DataFrame, target: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, sweep, recommendation) of a coarse router.

    ``scored``: attack and moderation scores, is_attack and is_moderation.  Routes: best
    F1 and the high-recall threshold with its rates; sweep: what 99 skip thresholds
    miss; recommended: of those that miss at most ``target``, the one that skips most,
    then the highest; else the lowest threshold.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("route"), F.col(f"is_{r}").cast("int").alias("gold"), F.col(r).alias("score")) for r in ("attack", "moderation")]))
    long = scored.select(each.alias("e")).select("e.*")
    swept = stage(E.sweep(long, E.GRID_49, ["route"]), "sweep")
    best = E.best_f1(swept, ["route"], strict=0.0).select("route", F.col("threshold").alias("best_f1_threshold"), F.col("f1").alias("best_f1"))
    chosen = E.route_thresholds(swept, ["route"]).select("route", F.round("threshold", 2).alias("threshold"))
    rates = swept.select("route", F.round("threshold", 2).alias("threshold"), (F.col("tp") + F.col("fn")).alias("support"), "precision", "recall", "f1")
    routes = best.join(chosen.join(rates, ["route", "threshold"]), "route")
    skips = stage(E.fast_allow(scored, E.GRID_99), "skips")
    ok = F.col("unsafe_miss_rate") <= target
    pick = F.coalesce(F.max_by("threshold", F.when(ok, F.struct("skip_pct", "threshold"))), F.min("threshold"))
    recommended = skips.join(F.broadcast(skips.agg(pick.alias("threshold"))), "threshold")  # one row
    return routes, skips, recommended


def external_benchmark(scored: DataFrame, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """One row of a binary benchmark (ranking, rates at 0.05, 0.5 and the best threshold, verdict by PR-AUC), and samples of its misses.

    ``scored``: id, text, gold, score.  Samples are the first by id of either kind.
    """
    swept = stage(E.sweep(scored, E.GRID_19), "sweep")
    best = E.best_f1(swept).select(F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"))
    out = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("gold").alias("positives"))
    for one in (E.average_precision(scored), E.roc_auc(scored), best):
        out = out.crossJoin(F.broadcast(one))  # single rows
    for t, name in ((0.05, "route"), (0.5, "default")):
        out = out.crossJoin(F.broadcast(E.at_threshold(swept, t).select(*[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")])))
    out = stage(out.withColumn("verdict", R.benchmark_verdict(F.col("pr_auc"))), "benchmark")
    t = F.col("best_threshold")
    kind = F.when((F.col("gold") == 1) & (F.col("score") < t), "false_negative").when((F.col("gold") == 0) & (F.col("score") >= t), "false_positive")
    missed = scored.crossJoin(F.broadcast(out.select("best_threshold"))).withColumn("kind", kind).filter("kind is not null")  # a single row
    return out, R.top_by(missed, ["kind"], [F.col("id")], samples).select("kind", "id", F.substring("text", 1, 90).alias("text"))


def pipeline_eval(classified: DataFrame, gold: DataFrame, targets: list[str], stages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per-label metrics, triggered models, decisions and (with ``stages``: stage, ms) latencies of a classified test set.

    ``classified``: id, decision, triggered and a struct ``scores`` with the targets; ``gold``: id, labels.
    """
    held = gold.select("id", "labels")
    j = classified.join(F.broadcast(held) if fits(held) else held, "id")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("int").alias("gold"), F.col(f"scores.{x}").alias("score")) for x in targets]))
    out = {
        "labels": label_metrics(j.select(each.alias("e")).select("e.*"), ["label"]),
        "triggered": classified.select(F.explode("triggered").alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n")),
        "decisions": classified.groupBy("decision").agg(F.count(F.lit(1)).alias("n")),
    }
    return out | ({"latency": R.stage_latency(stages)} if stages is not None else {})


def compare_scores(candidate: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """Drops of PR-AUC, best F1 and F1 at 0.5 from the reference to the candidate, and the differences of their scores; six digits.

    Both: ``key``, gold, score.
    """
    six = lambda c: F.round(c, 6)

    def one(df: DataFrame, tag: str) -> DataFrame:
        best = E.best_f1(E.sweep(df, E.GRID_19)).select(F.col("f1").alias(f"best_{tag}"))
        half = E.confusion(df, 0.5).select(F.col("f1").alias(f"half_{tag}"))
        return E.average_precision(df).withColumnRenamed("pr_auc", f"auc_{tag}").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(half))  # single rows

    m = one(candidate, "c").crossJoin(F.broadcast(one(reference, "r"))).crossJoin(F.broadcast(E.score_drift(candidate, reference, key)))
    return m.select(
        six(F.col("auc_r") - F.col("auc_c")).alias("pr_auc_drop"), six(F.col("best_r") - F.col("best_c")).alias("best_f1_drop"), six(F.col("half_r") - F.col("half_c")).alias("f1_at_0_5_drop"),
        six(F.col("max_abs_diff")).alias("max_abs_prob_diff"), six(F.col("mean_abs_diff")).alias("avg_abs_prob_diff"),
    )
