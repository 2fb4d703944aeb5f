"""Text to decision: the batch and streaming classification plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions.labels import literal_list
from ..functions.rules import with_gate
from ..functions.text import is_blank, normalize
from ..functions.windows import with_windows
from ..operators import scoring as S
from ..operators.heads import Head, score_heads

def classify(df: DataFrame, heads: S.Scorer | None, models: dict[str, S.Scorer], text: str = "text", **options) -> DataFrame:
    """Normalize the text and classify it; columns and options of ``classify_normalized``."""
    own = [c for c in df.columns if c != "labels"]
    return classify_normalized(normalize(df.select(*own), text), heads, models, text, **options)


def classify_with_heads(df: DataFrame, heads: list[Head], models: dict[str, S.Scorer], text: str = "text", **options) -> DataFrame:
    """``classify`` with trained n-gram heads."""
    own = [c for c in df.columns if c != "labels"]
    d = score_heads(normalize(df.select(*own), text), heads, "detection_text", "_trained")
    return classify_normalized(d, "_trained", models, text, **options).drop("_trained")


def candidate_stages(df: DataFrame, heads: S.Scorer, models: dict[str, S.Scorer], text: str = "text") -> dict[str, Callable[[], DataFrame]]:
    """The candidate pipeline cut after each stage, each plan holding the one before (for ``latency.by_stage``)."""
    normal = lambda: normalize(df, text)
    gated = lambda: with_gate(normal(), "detection_text", text, "flags")
    scored = lambda: gated().withColumn("_heads", S.score_text(heads, F.col("detection_text")))
    whole = lambda: classify(df, heads, models, text, merge_heads=False, windowing=False)
    return {"validation": lambda: df.withColumn("_ok", ~is_blank(F.col(text))), "normalization": normal, "deterministic_rules": gated, "heads": scored, "models_and_decision": whole}


def classify_normalized(df: DataFrame, heads: S.Scorer | str | None, models: dict[str, S.Scorer], text: str = "text", thresholds: dict | None = None, full_scan: bool = False,
                        toxic_fallback: bool = False, fast_block: float | None = None, merge_heads: bool = True, windowing: bool = True) -> DataFrame:
    """Of normalized rows (text, model_text, detection_text, flags): score with the heads, route, confirm, merge and decide.

    Adds ``gate``, ``decision``, ``risk_level``, ``labels``, ``reasons``, ``scores``,
    ``internal_scores``, ``triggered`` and ``skipped``.  Null and blank texts are
    rejected: they have null in all of these.  ``heads`` is a scorer, or the name of a
    column that has the head scores already.  ``merge_heads=False, windowing=False``
    is the candidate pipeline: heads only route and models see whole texts.
    """
    own = [c for c in df.columns if c != "labels"]
    d = df.withColumn("_given", F.col("model_text").isNotNull() & F.col("detection_text").isNotNull())
    d = with_gate(d, "detection_text", text, "flags")
    d = d.withColumn("_heads", (F.when(F.col("_given"), F.col(heads)) if isinstance(heads, str) else S.score_text(heads, F.col("detection_text"))) if heads else F.array().cast(S.SCORES))
    d, h = S.with_scores(d, "_h_", "_heads")
    available = [m for m in models if m != "toxic" or toxic_fallback or full_scan]
    route = S.select_models(h, F.col("detection_text"), available, thresholds, full_scan, toxic_fallback, fast_block)
    d = d.withColumn("_models", route["models"]).withColumn("_why", route["reasons"]).withColumn("_fall", F.lit(False))
    d = with_windows(d, "model_text", "_windows", full_scan, windowing)
    for m in S.MODELS:
        if m not in models:
            d = d.withColumn(f"_m_{m}", F.array().cast(S.WINDOWED))
            continue
        runs = F.array_contains("_models", m)
        if m == "toxic" and not full_scan:
            d, far = S.with_scores(d, "_far_", *(["_heads"] if merge_heads else []), *[f"_m_{x}" for x in S.MODELS if x != "toxic"])
            d = d.withColumn("_fall", F.lit(toxic_fallback) & S.needs_toxic_fallback(far, h, F.col("_models")))
            runs = F.col("_fall")
        d = S.run_model(d, "_windows", models[m], f"_m_{m}", runs & F.col("_given"))
    sources = (["_heads"] if merge_heads else []) + [f"_m_{m}" for m in S.MODELS]
    d, merged = S.with_scores(d, "_to_", *sources)
    made = S.decide(merged, thresholds, h if heads else None)
    ran = F.concat("_models", F.when(F.col("_fall"), literal_list(["toxic"])).otherwise(literal_list([])))
    said = F.concat("_why", *[S.window_reasons(F.col(f"_m_{m}"), thresholds) for m in S.MODELS if m in models and (m != "toxic" or full_scan)], F.when(F.col("_fall"), literal_list([S.TOXIC_FALLBACK])).otherwise(literal_list([])), made["reasons"])
    public, internal = S.respond(merged)
    made = F.struct(
        made["decision"].alias("decision"), made["risk_level"].alias("risk_level"), made["labels"].alias("labels"), said.alias("reasons"), public.alias("scores"), internal.alias("internal_scores"),
        F.concat(literal_list(["heads"] if heads else []), ran).alias("triggered"), F.array_except(literal_list(list(models)), ran).alias("skipped"),
    )
    # A filter on the results must not be copied down through every step as one huge
    # expression; Catalyst stops at a generator, here one of a single row.
    d = d.select(*own, "gate", F.explode(F.array(F.when(F.col("_given"), made))).alias("_made"))
    return d.select(*own, "gate", "_made.*")


def stand_ins(toxic: bool = False) -> tuple[S.Scorer, dict[str, S.Scorer]]:
    """Deterministic scorers for heads and models (no weights are shipped)."""
    return S.hash_scorer(T.SCORED, "heads:"), {m: S.hash_scorer(names, f"{m}:") for m, names in S.MODELS.items() if toxic or m != "toxic"}
