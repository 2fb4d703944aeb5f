"""Scoring, routing, merging and decisions.

A scorer turns an array of texts (the windows of a record) into an array of scores
for each, in the order of its labels.  Windows and scores of a record stay in its
row, so the path from text to decision has no shuffle and no join, on tables as on
streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions.labels import literal_list
from ..functions.rules import attack_phrase

SCORES = "array<struct<label:string,score:double>>"
WINDOWED = "array<struct<label:string,score:double,window:string>>"
#: Models in the order they run, and the labels each scores.
MODELS = {"prompt_injection": ["prompt_injection"], "jailbreak": ["jailbreak"], "moderation": T.MODERATED, "toxic": ["toxicity", "hate"]}


def hash_score(key: Column, label: str) -> Column:
    """A deterministic stand-in for a model, in [0, 1): equal in every engine, without meaning."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f":{label}")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


@dataclass(frozen=True)
class Scorer:
    """A model: ``scores`` maps an array of texts to an array<array<double>>, one score a label."""

    labels: tuple[str, ...]
    scores: Callable[[Column], Column]


def hash_scorer(labels: list[str], salt: str = "") -> Scorer:
    """A scorer that hashes the text; stands in for a model in tests and benchmarks."""
    one = lambda t: F.array(*[hash_score(F.concat(F.lit(salt), F.coalesce(t, F.lit(""))), x) for x in labels])
    return Scorer(tuple(labels), lambda texts: F.transform(texts, one))


def batch_scorer(labels: list[str], make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Scorer:
    """A scorer of a Python model: ``make`` loads it once a worker, it then scores lists of texts.

    All windows of an Arrow batch are scored in one call.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make()
        for lists in batches:
            flat = [t for ts in lists if ts is not None for t in ts]
            got = iter(predict(flat)) if flat else iter(())
            yield pd.Series([None if ts is None else [list(map(float, next(got))) for _ in ts] for ts in lists])

    udf = F.pandas_udf(run, "array<array<double>>")
    return Scorer(tuple(labels), lambda texts: udf(texts))


def score_of(scores: Column, label: str) -> Column:
    """The greatest score of a label in an array of scores, 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(F.filter(scores, lambda s: s["label"] == label), lambda s: s["score"])), F.lit(0.0))


#: Scores by label: a struct column, or a dict of flat columns (kept flat, Catalyst never repeats their expressions).
Scores = Column | dict[str, Column]


def merge_scores(*sources: Column | str) -> dict[str, Column]:
    """The greatest score of every scored label over arrays of scores, 0 where there is none; sources are columns or their names."""
    if all(isinstance(s, str) for s in sources):  # one parsed expression a label: plans of many labels are built faster
        one = "coalesce(array_max(transform(filter(`{}`, s -> s.label = '{}'), s -> s.score)), 0D)"
        return {x: F.expr(f"greatest(0D, {', '.join(['0D', *[one.format(s, x) for s in sources]])})") for x in T.SCORED}
    return {x: F.greatest(F.lit(0.0), *[score_of(F.col(s) if isinstance(s, str) else s, x) for s in sources]) for x in T.SCORED}


def with_scores(df: DataFrame, prefix: str, *sources: Column | str) -> tuple[DataFrame, dict[str, Column]]:
    """Add the merged scores as flat columns; the DataFrame and the columns by label."""
    return df.withColumns({prefix + x: c for x, c in merge_scores(*sources).items()}), {x: F.col(prefix + x) for x in T.SCORED}


def map_categories(raw: Column, table: dict[str, list[str]], safe: list[str], variants: bool = True) -> Column:
    """Scores by label from a map of raw categories; safe categories and unknown ones count for nothing."""
    name = lambda k: F.replace(F.lower(F.trim(k)), F.lit(" "), F.lit("_"))
    if not variants:
        plain = name
        name = lambda k: F.replace(plain(k), F.lit("-"), F.lit("_"))
    is_safe = lambda k: name(k).rlike("|".join(safe))

    def labels(k: Column) -> Column:
        keys = [name(k)] + ([F.replace(name(k), F.lit("_"), F.lit("/")), F.replace(name(k), F.lit("/"), F.lit("_"))] if variants else [])
        lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), literal_list(v))])
        return F.coalesce(*[F.try_element_at(lookup, x) for x in keys])

    each = F.filter(F.map_entries(raw), lambda e: ~is_safe(e["key"]) & labels(e["key"]).isNotNull())
    flat = F.flatten(F.transform(each, lambda e: F.transform(labels(e["key"]), lambda x: F.struct(x.alias("label"), e["value"].alias("score")))))
    names = F.array_distinct(F.transform(flat, lambda s: s["label"]))
    return F.transform(names, lambda n: F.struct(n.alias("label"), F.array_max(F.transform(F.filter(flat, lambda s: s["label"] == n), lambda s: s["score"])).alias("score")))


def moderation_scores(raw: Column) -> Column:
    return map_categories(raw, T.MODERATION_CATEGORIES, T.MODERATION_SAFE)


def toxic_scores(raw: Column) -> Column:
    return map_categories(raw, T.TOXIC_CATEGORIES, T.TOXIC_SAFE, variants=False)


def token_score(raw: Column, tokens: list[str]) -> Column:
    """The greatest value whose key has one of the tokens, else 0 (binary detectors)."""
    return F.coalesce(F.array_max(F.map_values(F.map_filter(raw, lambda k, v: F.lower(k).rlike("|".join(tokens))))), F.lit(0.0))


def injection_scores(raw: Column) -> Column:
    """Prompt-injection detectors; generic LABEL_0 / LABEL_1 are safe / injection."""
    generic = F.forall(F.map_keys(raw), lambda k: F.startswith(k, F.lit("LABEL_"))) & (F.size(raw) == 2)
    return F.when(generic, F.coalesce(F.try_element_at(raw, F.lit("LABEL_1")), F.lit(0.0))).otherwise(token_score(raw, T.INJECTION_TOKENS))


def jailbreak_scores(raw: Column) -> Column:
    return token_score(raw, T.JAILBREAK_TOKENS)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))


def digits(score: Column, places: int) -> Column:
    """A score of 0 to 1 as text with fixed places, rounded on its exact binary value, half to even.

    The formatter rounds the shortest decimal of a double, half up.  That differs only
    where this decimal is a midpoint itself; there the sign of the exact difference
    decides, which two products of few bits (the float part and the rest) give.
    """
    scale = 10**places
    tenth = F.round(score * (10 * scale))
    k = F.floor(tenth / 10)
    near = score.cast("float").cast("double")
    over = (near * (2 * scale) - (2 * k + 1)) + (score - near) * (2 * scale)
    exact = F.when(over > 0, k + 1).when(over < 0, k).otherwise(k + k % 2)
    midpoint = (tenth % 10 == 5) & (tenth / (10 * scale) == score)
    return F.format_string(f"%.{places}f", F.when(midpoint, exact / scale).otherwise(score))


# Reason texts.
FULL_SCAN = "full_scan enabled -> running %s"
HEADS_TO = {"prompt_injection": "FastText attack head routed to prompt injection detector", "jailbreak": "FastText attack head routed to jailbreak detector"}
PHRASE_TO = {"prompt_injection": "Attack heuristic routed to prompt injection detector", "jailbreak": "Attack heuristic routed to jailbreak detector"}
TOXIC_FALLBACK = "Toxic fallback invoked on medium-confidence abuse result"


def suggested_models(heads: Scores, thresholds: dict[str, tuple[float, float, float]] | None = None) -> Column:
    """Models whose labels reach their route threshold, in model order (information only)."""
    t = thresholds or T.THRESHOLDS
    hit = lambda labels: F.greatest(*[(heads[x] >= t[x][0]).cast("int") for x in labels], F.lit(0)) == 1
    return F.array_compact(F.array(*[F.when(hit(MODELS[m]), F.lit(m)) for m in ("prompt_injection", "jailbreak", "moderation")]))


def select_models(heads: Scores, detection: Column, available: list[str], thresholds: dict | None = None, full_scan: bool = False, toxic_fallback: bool = False, fast_block: float | None = None) -> Column:
    """Struct (models, reasons) in the order the models are routed to."""
    t = thresholds or T.THRESHOLDS
    pi, jb = heads["prompt_injection"], heads["jailbreak"]
    phrase = attack_phrase(detection)
    first = F.coalesce(*[F.when(heads[x] >= t[x][0], F.lit(x)) for x in T.MODERATED])
    if full_scan:
        order = ["prompt_injection", "jailbreak", "moderation"] + (["toxic"] if toxic_fallback else [])
        steps = [(m, F.lit(True), F.lit(FULL_SCAN % ("toxic fallback" if m == "toxic" else m))) for m in order]
    else:
        steps = [
            ("prompt_injection", pi >= t["prompt_injection"][0], F.lit(HEADS_TO["prompt_injection"])), ("prompt_injection", phrase, F.lit(PHRASE_TO["prompt_injection"])),
            ("jailbreak", phrase, F.lit(PHRASE_TO["jailbreak"])), ("jailbreak", jb >= t["jailbreak"][0], F.lit(HEADS_TO["jailbreak"])),
            ("moderation", first.isNotNull(), F.concat(F.lit("FastText routed "), first, F.lit(" to moderation model"))),
        ]
    seen: dict[str, Column] = {}
    out = []
    for model, cond, reason in steps:
        if model in available:
            out.append(F.when(cond & ~seen.get(model, F.lit(False)), F.struct(F.lit(model).alias("model"), reason.alias("reason"))))
            seen[model] = seen.get(model, F.lit(False)) | cond
    chosen = F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<model:string,reason:string>>")
    models, reasons = F.transform(chosen, lambda c: c["model"]), F.transform(chosen, lambda c: c["reason"])
    if fast_block is not None and not full_scan:
        skip = (pi >= fast_block) | (jb >= fast_block)
        models = F.when(skip, literal_list([])).otherwise(models)
        said = F.concat(F.lit("FastText attack score "), digits(F.greatest(pi, jb), 3), F.lit(f" >= fast_block_threshold {fast_block} -> skipping transformer"))
        reasons = F.when(skip, F.array(said)).otherwise(reasons)
    return F.struct(models.alias("models"), reasons.alias("reasons"))


def needs_toxic_fallback(merged: Scores, heads: Scores, models: Column, band: tuple[float, float] = (0.30, 0.70)) -> Column:
    """After moderation: toxicity or hate in the medium band, or high in the heads and low when merged."""
    lo, hi = band
    tox, hate = merged["toxicity"], merged["hate"]
    medium = tox.between(lo, hi) | hate.between(lo, hi)
    doubtful = (F.greatest(heads["toxicity"], heads["hate"]) >= 0.60) & (F.greatest(tox, hate) < lo)
    return F.array_contains(models, "moderation") & (medium | doubtful)


def merge_windows(scored: DataFrame, ident: str) -> DataFrame:
    """(ident, label, score, window) from rows (ident, name, pos, scores): the greatest score, the earliest window of equals."""
    one = scored.select(ident, "name", "pos", F.explode("scores").alias("s"))
    best = one.groupBy(ident, F.col("s.label").alias("label")).agg(F.max(F.struct(F.col("s.score").alias("score"), (-F.col("pos")).alias("p"), F.col("name").alias("window"))).alias("b"))
    return best.select(ident, "label", F.col("b.score").alias("score"), F.col("b.window").alias("window"))


def score_text(scorer: Scorer, text: Column) -> Column:
    """Array of (label, score) of one text; null gives null."""
    got = F.get(scorer.scores(F.when(text.isNotNull(), F.array(text))), F.lit(0))
    return F.transform(got, lambda v, i: F.struct(F.element_at(F.array(*[F.lit(x) for x in scorer.labels]), i + 1).alias("label"), v.alias("score")))


def run_model(df: DataFrame, windows: str, scorer: Scorer, out: str, when: Column | None = None) -> DataFrame:
    """Add ``out``: scores (label, score, window) of a model over the windows of each record it runs on.

    ``windows`` is a column of ``with_windows``.  The greatest score of a label
    counts, of equals that of the earliest window.  Records the model does not run on
    never reach it.
    """
    runs = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    d = df.withColumn("_w", F.when(runs, F.col(windows)))
    d = d.withColumn("_s", scorer.scores(F.transform("_w", lambda w: w["text"])))

    def of_label(k: int) -> Column:
        return F.array_max(F.transform("_s", lambda s, i: F.struct(s[k].alias("score"), (-i).alias("p"), F.element_at(F.col("_w"), i + 1)["name"].alias("window"))))

    best = [of_label(k) for k in range(len(scorer.labels))]
    one = [F.struct(F.lit(x).alias("label"), b["score"].alias("score"), b["window"].alias("window")) for x, b in zip(scorer.labels, best)]
    return d.withColumn(out, F.when(F.col("_w").isNotNull(), F.array(*one)).otherwise(F.array().cast(WINDOWED))).drop("_w", "_s")


def window_reasons(scores: Column, thresholds: dict | None = None) -> Column:
    t = thresholds or T.THRESHOLDS
    route = F.create_map(*[F.lit(x) for k, v in t.items() for x in (k, v[0])])
    hot = F.filter(scores, lambda s: (s["window"] != "full") & (s["score"] >= F.coalesce(F.try_element_at(route, s["label"]), F.lit(T.DEFAULT_THRESHOLDS[0]))))
    return F.transform(hot, lambda s: F.concat(s["window"], F.lit("_window triggered "), s["label"], F.lit(" score")))


def decide(merged: Scores, thresholds: dict | None = None, heads: Scores | None = None) -> Column:
    """Struct (decision, risk_level, labels, reasons) of merged scores; ties of score go by label order."""
    t = {x: (thresholds or T.THRESHOLDS).get(x, T.DEFAULT_THRESHOLDS) for x in T.SCORED}
    level = {x: F.when(merged[x] >= t[x][2], 3).when(merged[x] >= t[x][1], 2).when(merged[x] >= t[x][0], 1).otherwise(0) for x in T.SCORED}
    worst, blocked = F.greatest(*level.values()), sum((level[x] == 3).cast("int") for x in T.SCORED)
    top = F.greatest(*[merged[x] for x in T.SCORED])
    decision = F.when(worst == 3, "block").when(worst == 2, "review").otherwise("allow")
    risk = F.when((merged["self_harm"] >= 0.85) | (merged["violence"] >= 0.90) | (blocked >= 2), "critical").when(worst == 3, "high").when(worst == 2, "medium").when(top >= 0.20, "low").otherwise("none")

    def ranked(least: int) -> Column:
        one = [F.when(level[x] >= least, F.struct((-merged[x]).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("x"))) for i, x in enumerate(T.SCORED)]
        return F.transform(F.array_sort(F.array_compact(F.array(*one))), lambda e: e["x"])

    final, routed = ranked(2), ranked(1)
    labels = F.when(F.size(final) > 0, final).when((top >= 0.20) & (F.size(routed) > 0), F.slice(routed, 1, 1)).otherwise(literal_list([T.SAFE]))
    def crossed(x: str) -> Column:
        said = F.when(level[x] == 3, F.lit(f" crossed block threshold {t[x][2]:.2f}")).when(level[x] == 2, F.lit(f" crossed review threshold {t[x][1]:.2f}"))
        return F.struct(F.lit(f"{x} score ").alias("a"), merged[x].alias("s"), said.alias("z"))

    # one formatting step for all labels, over those that have something to say
    told = F.filter(F.array(*[crossed(x) for x in T.SCORED]), lambda e: e["z"].isNotNull())
    said = F.transform(told, lambda e: F.concat(e["a"], digits(e["s"], 2), e["z"]))
    if heads is not None:
        both = F.array(*[F.struct(F.lit(f"FastText and transformer agree on {x} (ft=").alias("a"), heads[x].alias("h"), merged[x].alias("s")) for x in T.SCORED])
        agree = F.transform(F.filter(both, lambda e: (e["h"] >= 0.30) & (e["s"] >= 0.30)), lambda e: F.concat(e["a"], digits(e["h"], 2), F.lit(", model="), digits(e["s"], 2), F.lit(") — elevated confidence")))
        said = F.concat(said, agree)
    return F.struct(decision.alias("decision"), risk.alias("risk_level"), labels.alias("labels"), said.alias("reasons"))


def respond(merged: Scores) -> tuple[Column, Column]:
    """Public and internal scores, rounded to four digits for display only."""
    show = lambda names: F.struct(*[F.bround(merged[x], 4).alias(x) for x in names])
    return show(T.PUBLIC), show(T.INTERNAL)


def named_scores(raw: Column, names: list[str], prefix: str = "__label__") -> Column:
    """Struct with the score of each of ``names`` from a map label -> score, 0 where there is none; other labels are left out.

    The coarse router has attack, moderation and safe, the merged head harmful_content, sexual and safe.
    """
    plain = F.transform_keys(raw, lambda k, v: F.when(F.startswith(k, F.lit(prefix)), F.substring(k, len(prefix) + 1, 1 << 20)).otherwise(k))
    return F.struct(*[F.coalesce(F.try_element_at(plain, F.lit(n)), F.lit(0.0)).alias(n) for n in names])


ROUTER_LABELS, MERGED_LABELS = ["attack", "moderation", "safe"], ["harmful_content", "sexual", "safe"]


def router_scores(raw: Column) -> Column:
    return named_scores(raw, ROUTER_LABELS)


def merged_head_scores(raw: Column) -> Column:
    return named_scores(raw, MERGED_LABELS)
