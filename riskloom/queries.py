"""The engine's registered queries: each maps (spark, sf_dir) to a DataFrame over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import taxonomy as T
from .functions import labels as L
from .functions import rules, windows
from .functions import text as X
from .cases import ADAPTER_ROWS, BINARY_LABELS, DETECTOR_OUTPUTS, NORMALIZE_TEXTS
from .operators import balance as B
from .operators import compose as C
from .operators import dedup as D
from .operators import evaluate as E
from .operators import heads
from .operators import quality as Q
from .operators import reports as R
from .operators import scoring as S
from .plans.classify import classify, classify_normalized, stand_ins
from .plans.parallel import spread
from .plans.prepare import availability, load_all, process
from .plans.staging import shared_dir, stage
from .sources import adapters as A
from .sources import scan, sinks
from .sources.config import Thresholds
from .streaming.stream import tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """The processed records of the three splits, with ``split`` and ``ord`` (the id)."""
    parts = [table(spark, d, f"all_{s}").drop("detection_text", "seen_at").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, parts).withColumn("ord", F.col("rec_id"))


def long_scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, gold, score): a hashed score for every record and scored label."""
    r = records(spark, d).select(F.col("rec_id").alias("id"), "labels", "source", "text")
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("int").alias("gold"), S.hash_score(F.col("id"), x).alias("score")) for x in T.SCORED])
    return r.select("id", "source", F.explode(each).alias("e")).select("id", "source", "e.*")


def wide_scores(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select(F.col("rec_id").alias("id"), "labels", "source", "text")
    return r.withColumn("h", F.struct(*[S.hash_score(F.col("id"), x).alias(x) for x in T.SCORED]))


# text -----------------------------------------------------------------------


@query
def normalize_core(spark, d):
    t = X.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.sha2(t, 256).alias("text_hash"))


@query
def normalize_text(spark, d):
    n = X.normalize(spread(table(spark, d, "documents").select("doc_id", "text")))
    return n.select("doc_id", "model_text", "detection_text", "text_hash", "flags")


@query
def normalize_again(spark, d):
    """The stored originals normalized anew, beside what an older run had stored."""
    n = X.normalize(table(spark, d, "normalized_text").select("norm_id", "original_text", F.col("detection_text").alias("stored")), "original_text")
    return n.select("norm_id", "detection_text", "text_hash", F.coalesce(F.col("stored") == F.col("detection_text"), F.lit(False)).alias("as_stored"), "flags")


@query
def normalize_cases(spark, d):
    """Every step of normalization on literal texts."""
    n = X.normalize(spark.createDataFrame(NORMALIZE_TEXTS, "id int, text string"))
    return n.select("id", "model_text", "detection_text", "flags.*")


@query
def snippets(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(X.snippet(F.col("text"))).alias("snippet_hash"))


@query
def base64_spans(spark, d):
    n = F.regexp_count("original_text", F.lit(X.BASE64_SPAN))
    return table(spark, d, "normalized_text").filter("original_text is not null").select("norm_id", n.cast("long").alias("spans")).filter("spans > 0")


@query
def separators(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").rlike(X.SEPARATORS).alias("excessive"))


# quality and labels ---------------------------------------------------------


@query
def quality_records(spark, d):
    return Q.reason_counts(table(spark, d, "documents"), Q.check_record(F.col("text"), F.col("labels")))


@query
def quality_finetuning(spark, d):
    return Q.reason_counts(records(spark, d), Q.quality_reason(F.col("text"), F.col("labels")))


def _trusted(df: DataFrame) -> DataFrame:
    """Sources renamed so that the trusted hints occur in them."""
    low = F.lower("source")
    return df.withColumn("source", F.when(low.rlike("forum|chat|mix"), F.concat(F.lit("text_moderation_"), "source")).when(low.rlike("prompts|posts"), F.concat(F.lit("aegis_"), "source")).otherwise(F.col("source")))


@query
def clean_records(spark, d):
    return Q.clean_records(_trusted(records(spark, d)), T.MODERATED).groupBy("split", F.coalesce("reason", F.lit("kept")).alias("reason"), F.coalesce(F.array_join("clean_labels", ","), F.lit("-")).alias("clean_labels")).agg(F.count(F.lit(1)).alias("n"))


@query
def clean_merged(spark, d):
    return Q.clean_records(_trusted(records(spark, d)), T.MODERATED, merged=True).groupBy("split", F.coalesce("reason", F.lit("kept")).alias("reason"), F.coalesce(F.array_join("clean_labels", ","), F.lit("-")).alias("clean_labels")).agg(F.count(F.lit(1)).alias("n"))


@query
def label_map(spark, d):
    m = L.map_labels(F.col("raw_labels"), F.col("text"))
    return records(spark, d).select("rec_id", F.array_join(m, ",").alias("mapped"))


@query
def coarse_and_route_labels(spark, d):
    r = records(spark, d).filter("labels is not null").withColumn("labels", F.array_compact("labels"))
    return r.select("rec_id", F.array_join(L.coarse_labels(F.col("labels")), ",").alias("coarse"), F.array_join(L.route_labels(F.col("labels")), ",").alias("routes"))


def _projected(spark, d) -> DataFrame:
    r = records(spark, d).filter("labels is not null").withColumn("labels", F.array_distinct(F.array_compact("labels")))
    return B.head_projection(r.select("rec_id", "split", "labels", "sources", "text"))


@query
def head_projection(spark, d):
    return _projected(spark, d).select("head", "split", F.explode("head_labels").alias("label")).groupBy("head", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def shared_cap(spark, d):
    return B.shared_budget_cap(_projected(spark, d), "rec_id", F.lit(40), ["head", "split"])


@query
def multi_hot(spark, d):
    hot = F.array_join(F.transform(L.multi_hot(F.col("labels"), T.SCORED), lambda x: x.cast("int").cast("string")), "")
    return records(spark, d).select("rec_id", hot.alias("hot"))


# duplicates and splits ------------------------------------------------------


@query
def dedup_union(spark, d):
    u = D.union_duplicates(records(spark, d), keep=["rec_id"], unions=["labels", "sources"])
    u = u.withColumn("labels", D.merged_labels(F.filter("labels", lambda x: x.isNotNull())))
    return u.select("hash", "rec_id", F.array_join("labels", ",").alias("labels"), F.array_join("sources", ",").alias("sources"), "copies")


@query
def stable_split(spark, d):
    h = F.sha2(X.collapse(F.col("text")), 256)
    one = table(spark, d, "documents").filter(~X.is_blank(F.col("text"))).select(h.alias("hash")).distinct()
    return one.groupBy(D.stable_split(F.col("hash")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query
def named_split(spark, d):
    s = D.named_split(F.initcap("split"), F.sha2("text", 256), F.coalesce(F.startswith("source", F.lit("o")), F.lit(False)))
    return records(spark, d).filter("text is not null").groupBy("split", s.alias("named")).agg(F.count(F.lit(1)).alias("n"))


@query
def held_out(spark, d):
    t = table(spark, d, "test").filter("text is not null").withColumn("h", F.sha2("text", 256))
    return D.in_split(t, "test", "h").select("row_id", "h")


@query
def first_wins(spark, d):
    return D.first_wins(records(spark, d).select(F.coalesce("hash", "text").alias("key"), "rec_id", "split").filter("key is not null"), ["key"], ["rec_id"]).select("rec_id", "split")


@query
def priority_dedup(spark, d):
    return D.assign_by_priority(records(spark, d).select("hash", "split", "ord").filter("hash is not null")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ids"))


@query
def leakage(spark, d):
    return D.leakage(records(spark, d)).select("hash", F.array_join("splits", ",").alias("splits"))


@query
def unseen(spark, d):
    return D.drop_seen(table(spark, d, "all_test").filter("hash is not null").select("rec_id", "hash"), table(spark, d, "all_train").filter("hash is not null")).select("rec_id")


@query
def split_sources(spark, d):
    return R.split_source_totals(records(spark, d))


@query
def prepared_corpus(spark, d):
    """Raw documents to the processed, deduplicated, split corpus."""
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", "labels", "source")
    return process(raw)[0].select("hash", "ord", "text", "detection_text", "labels", "raw_labels", "source", "sources", "copies", "split")


# balance --------------------------------------------------------------------


@query
def stratified_sample(spark, d):
    r = D.first_wins(records(spark, d).filter("hash is not null").select("hash", "rec_id", "labels"), ["hash"], ["rec_id"])
    return B.stratified_sample(r, T.SCORED, 200).select("hash")


@query
def stratified_eval_cap(spark, d):
    r = D.first_wins(records(spark, d).filter("hash is not null").select("hash", "rec_id", "labels"), ["hash"], ["rec_id"])
    return B.stratified_sample(r, T.MODERATED, 150, parts=len(T.MODERATED) + 2, fill_order=B.shuffled(F.col("hash"))).select("hash")


@query
def source_cap(spark, d):
    return B.source_cap(records(spark, d), 25).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("rec_id").alias("last"))


@query
def safe_downsample(spark, d):
    r = records(spark, d).filter("hash is not null").select(F.concat("hash", F.lit("#"), "rec_id").alias("hash"), "labels")
    return B.safe_downsample(r, 100).select("hash")


@query
def hard_negatives(spark, d):
    r = table(spark, d, "test").select("row_id", "label", F.sha2(F.col("row_id").cast("string"), 256).alias("hash"))
    return B.hard_negatives(r, F.col("label") == 1, 1).select("row_id")


@query
def balanced_sample(spark, d):
    return B.balanced_sample(table(spark, d, "test").select("row_id", "label"), "label", 101, [F.sha2(F.col("row_id").cast("string"), 256)])


@query
def random_sample(spark, d):
    return B.first_n(table(spark, d, "documents").select("doc_id"), [B.shuffled(F.col("doc_id").cast("string"))], 50)


@query
def any_label_cap(spark, d):
    r = records(spark, d).select("rec_id", "labels")
    return B.any_label_cap(r, "rec_id", "labels", T.RISK, 30, T.SHARED_BUDGET).select("rec_id")


@query
def fold_eval_rows(spark, d):
    return B.fold_into_train(records(spark, d).select("rec_id", "split", "labels", "source"), T.SCORED, 60).filter("folded_from_split is not null").select("rec_id", "split", "folded_from_split", "source")


@query
def oversample(spark, d):
    r = records(spark, d).filter("split = 'train'").select(F.concat(F.coalesce("hash", F.lit("")), F.lit("#"), "rec_id").alias("hash"), "labels", "source")
    return B.oversample(r, T.MODERATED, 120).groupBy(F.contains("hash", F.lit("::oversample::")).alias("copied")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("labels", x)).alias(x) for x in T.MODERATED])


@query
def route_balance(spark, d):
    r = records(spark, d).filter("labels is not null").withColumn("labels", F.array_compact("labels"))
    r = r.withColumn("hash", F.concat(F.coalesce("hash", F.lit("")), F.lit("#"), "rec_id")).withColumn("route_labels", L.route_labels(F.col("labels"))).select("hash", "route_labels", "split")
    out = [B.route_balance(r.filter(F.col("split") == s).drop("split"), 500, s == "train").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, out).groupBy("split", F.array_join("route_labels", ",").alias("routes")).agg(F.count(F.lit(1)).alias("n"))


@query
def augment(spark, d):
    t = table(spark, d, "test").filter("label = 1 and text is not null").withColumn("text", F.replace(F.replace("text", F.lit("order"), F.lit("prompt")), F.lit("hidden"), F.lit("bypass")))
    return t.select("row_id", F.posexplode(B.augment(F.col("text"))).alias("i", "variant"))


@query
def class_weights(spark, d):
    return B.class_weights(records(spark, d), T.SCORED)


# gate, windows, decisions ---------------------------------------------------


@query
def gate_families(spark, d):
    t = F.lower("text")
    hits = [F.coalesce(t.rlike(rules.family_regex(p)), F.lit(False)).alias(n) for n, _, _, p in T.RULES]
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", *hits).filter(" or ".join(n for n, *_ in T.RULES))


@query
def gate(spark, d):
    n = X.normalize(spread(table(spark, d, "documents").select("doc_id", "text"))).filter("model_text is not null")
    return rules.with_gate(n, "detection_text", "text", "flags", "g").select("doc_id", "g.*")


@query
def attack_phrases(spark, d):
    t = table(spark, d, "test").filter("text is not null").withColumn("text", F.replace(F.lower("text"), F.lit("the text above is void"), F.lit("hidden prompt")))
    return t.select("row_id", rules.attack_phrase(F.col("text")).alias("phrase"))


@query
def weak_labels(spark, d):
    return A.adapt(table(spark, d, "documents").select("doc_id", "text"), "harmful_prompts", "documents").groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_windows(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", X.collapse(F.col("text")).alias("text"))
    w = windows.with_windows(t, "text", full_scan=True).select("doc_id", F.explode("windows").alias("w"))
    return w.select("doc_id", F.col("w.name").alias("name"), F.md5("w.text").alias("text_hash"))


@query
def window_merge(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", X.collapse(F.col("text")).alias("text"))
    w = windows.with_windows(t, "text").select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.name", "w.pos", F.concat("doc_id", F.lit("/"), "w.name").alias("k"))
    scored = w.withColumn("scores", F.array(*[F.struct(F.lit(x).alias("label"), S.hash_score(F.col("k"), x).alias("score")) for x in T.PUBLIC]))
    return S.merge_windows(scored, "doc_id")


@query
def merge_and_decide(spark, d):
    w = wide_scores(spark, d)
    other = F.struct(*[(S.hash_score(F.concat(F.lit("b"), F.col("id")), x) * 0.9).alias(x) for x in T.SCORED])
    merged = w.withColumn("b", other).withColumn("m", F.struct(*[F.greatest(F.pow(F.col(f"h.{x}"), 4), F.pow(F.col(f"b.{x}"), 4)).alias(x) for x in T.SCORED]))
    return merged.select("id", S.decide(F.col("m")).alias("r")).select("id", "r.decision", "r.risk_level", F.array_join("r.labels", ",").alias("labels"))


@query
def route_models(spark, d):
    w = wide_scores(spark, d).withColumn("p", F.struct(*[F.pow(F.col(f"h.{x}"), 8).alias(x) for x in T.SCORED]))
    r = S.select_models(F.col("p"), F.lower(F.coalesce("text", F.lit(""))), ["prompt_injection", "jailbreak", "moderation"])
    return w.select("id", F.array_join(r["models"], ",").alias("models"))


@query
def suggest_models(spark, d):
    w = wide_scores(spark, d).withColumn("p", F.struct(*[F.pow(F.col(f"h.{x}"), 8).alias(x) for x in T.SCORED]))
    return w.select("id", F.array_join(S.suggested_models(F.col("p")), ",").alias("models"))


@query
def category_scores(spark, d):
    """Raw external labels as categories of a moderation model."""
    r = records(spark, d).filter("raw_labels is not null").select("rec_id", F.array_distinct(F.array_compact("raw_labels")).alias("raw"))
    m = F.map_from_arrays("raw", F.transform("raw", lambda x: F.length(x) / 100.0))
    return r.select("rec_id", F.explode(S.moderation_scores(m)).alias("s")).select("rec_id", "s.label", "s.score")


@query
def detector_scores(spark, d):
    """Raw outputs of detectors, literal, as scores of our labels."""
    r = spark.createDataFrame(DETECTOR_OUTPUTS, "id int, kind string, raw map<string,double>")
    one = lambda label, c: F.array(F.struct(F.lit(label).alias("label"), c.alias("score")))
    scores = F.when(F.col("kind") == "injection", one("prompt_injection", S.injection_scores(F.col("raw")))).when(F.col("kind") == "jailbreak", one("jailbreak", S.jailbreak_scores(F.col("raw"))))
    scores = scores.when(F.col("kind") == "moderation", S.moderation_scores(F.col("raw"))).otherwise(S.toxic_scores(F.col("raw")))
    return r.select("id", "kind", F.explode(scores).alias("s")).select("id", "kind", "s.label", "s.score")


@query
def activations(spark, d):
    """Softmax and sigmoid of literal logits."""
    r = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 3.0]), (3, [1000.0, 0.0])], "id int, logits array<double>")
    return r.select("id", F.round(F.get(S.softmax(F.col("logits")), F.lit(0)), 9).alias("softmax"), F.round(F.get(S.sigmoid(F.col("logits")), F.lit(1)), 9).alias("sigmoid"))


@query
def threshold_table(spark, d):
    """The three thresholds of every label, a calibrated route and the default of other labels."""
    t = Thresholds().calibrated({"hate": 0.15})
    return spark.createDataFrame([(x, *t.of(x)) for x in (*T.SCORED, "other")], "label string, route double, review double, block double")


@query
def final_status(spark, d):
    """The overall status of components, and sizes for display."""
    cases = {"good": {"a": "PASS", "b": "PASS"}, "partial": {"a": "PASS", "b": None}, "bad": {"a": "FAIL", "b": "WARN"}, "nothing": {}}
    rows = [(n, R.final_report(c)[0], ",".join(x for _, x in R.final_report(c)[1])) for n, c in cases.items()]
    sizes = [(sinks.human_size(n), "size", str(n)) for n in (None, 0, 1023, 2048, 5 * 1024**2, 3 * 1024**4)]
    return spark.createDataFrame(rows + sizes, "name string, status string, detail string")


@query
def classify_documents(spark, d):
    heads, models = stand_ins(toxic=True)
    c = classify(spread(table(spark, d, "documents").select("doc_id", "text")), heads, models, toxic_fallback=True)
    return c.select("doc_id", "decision", "risk_level", "labels", "reasons", "scores", "internal_scores", "triggered", "skipped", F.col("gate.reasons").alias("gate_reasons"))


@query
def classify_candidate(spark, d):
    heads, models = stand_ins(toxic=True)
    c = classify(spread(table(spark, d, "documents").select("doc_id", "text")), heads, models, merge_heads=False, windowing=False)
    return c.select("doc_id", "decision", "risk_level", "labels", "triggered")


def _stored(spark, d) -> DataFrame:
    """Rows as an earlier run normalized them."""
    return spread(table(spark, d, "normalized_text").withColumnRenamed("original_text", "text").filter("detection_text is not null and model_text is not null"))


@query
def classify_stored(spark, d):
    """Text to decision from stored normalized texts: every step but normalization."""
    heads, models = stand_ins(toxic=True)
    c = classify_normalized(_stored(spark, d), heads, models, toxic_fallback=True)
    return c.select("norm_id", "decision", "risk_level", F.array_join("labels", ",").alias("labels"), F.array_join("triggered", ",").alias("triggered"), F.array_join("skipped", ",").alias("skipped"), F.md5(F.array_join("reasons", "|")).alias("reasons_hash"), "scores.*", "internal_scores.*")


@query
def classify_full_scan(spark, d):
    """All models over all windows."""
    heads, models = stand_ins(toxic=True)
    c = classify_normalized(_stored(spark, d), heads, models, full_scan=True, toxic_fallback=True)
    return c.select("norm_id", "decision", "risk_level", F.array_join("labels", ",").alias("labels"), F.array_join("triggered", ",").alias("triggered"), F.md5(F.array_join("reasons", "|")).alias("reasons_hash"))


@query
def classify_fast_block(spark, d):
    """A high attack score of the heads alone decides; no model runs for it."""
    heads, models = stand_ins()
    c = classify_normalized(_stored(spark, d), heads, models, fast_block=0.9)
    return c.select("norm_id", "decision", F.array_join("triggered", ",").alias("triggered"), F.md5(F.array_join("reasons", "|")).alias("reasons_hash"))


@query
def stored_decisions(spark, d):
    return R.decision_distribution(classify_normalized(_stored(spark, d), *stand_ins(toxic=True), toxic_fallback=True))


@query
def stored_routing(spark, d):
    return R.routing_distribution(classify_normalized(_stored(spark, d), *stand_ins(toxic=True), toxic_fallback=True))


@query
def gate_stored(spark, d):
    """The gate over stored texts and flags."""
    g = rules.with_gate(_stored(spark, d), "detection_text", "text", "flags", "g")
    return g.select("norm_id", F.array_join("g.force_route", ",").alias("routes"), F.array_join("g.reasons", ",").alias("reasons"), "g.block", "g.allow_fast_skip", "g.matched")


@query
def decision_distribution(spark, d):
    return R.decision_distribution(classify_documents(spark, d).filter("decision is not null"))


@query
def routing_distribution(spark, d):
    return R.routing_distribution(classify_documents(spark, d).filter("decision is not null"))


# evaluation -----------------------------------------------------------------


@query
def confusion(spark, d):
    return E.confusion(long_scores(spark, d), 0.5, ["label"])


@query
def sweep(spark, d):
    return E.sweep(long_scores(spark, d), E.GRID_18, ["label"])


@query
def thresholds(spark, d):
    s = E.sweep(long_scores(spark, d), E.GRID_19, ["label"])
    b = E.best_f1(s, ["label"]).select("label", F.col("threshold").alias("best"))
    for name, t in (("recall_high", E.recall_threshold(s, ["label"])), ("recall_low", E.recall_threshold(s, ["label"], mode="lowest")), ("precise", E.precision_threshold(s, ["label"]))):
        b = b.join(t.withColumnRenamed("threshold", name), "label")
    return b


@query
def route_floor(spark, d):
    s = E.at_threshold(E.sweep(long_scores(spark, d), E.GRID_18, ["label"]), 0.05)
    return s.select("label", "precision", "recall", (F.col("tp") + F.col("fp")).alias("predicted"))


@query
def review_block(spark, d):
    return E.review_block(E.sweep(long_scores(spark, d), E.GRID_19, ["label"]), ["label"])


@query
def fine_thresholds(spark, d):
    return E.best_f1(E.sweep(long_scores(spark, d), E.GRID_49, ["label"]), ["label"]).select("label", "threshold", "tp", "fp", "fn")


@query
def pr_auc(spark, d):
    return E.average_precision(long_scores(spark, d), ["label"]).select("label", F.round(F.col("pr_auc") * 1e6).cast("long").alias("pr_auc_millionths"))


@query
def roc_auc(spark, d):
    return E.roc_auc(long_scores(spark, d), ["label"])


@query
def macro_metrics(spark, d):
    c = E.confusion(long_scores(spark, d), 0.5, ["label"]).withColumn("support", F.col("tp") + F.col("fn"))
    return E.macro(c, ["precision", "recall"]).select("labels", F.round(F.col("macro_precision") * 1e9).cast("long").alias("p9"), F.round(F.col("macro_recall") * 1e9).cast("long").alias("r9"))


@query
def micro_macro(spark, d):
    return E.micro_macro(long_scores(spark, d)).select("micro_f1", F.round(F.col("macro_f1") * 1e9).cast("long").alias("macro9"))


def _heads(spark, d) -> DataFrame:
    r = records(spark, d).filter("size(labels) > 0").select(F.col("rec_id").alias("id"), F.array_distinct(F.array_compact("labels")).alias("gold"))
    s = F.array(*[F.struct(F.lit(x).alias("label"), S.hash_score(F.col("id"), x).alias("score")) for x in T.HEADS["abuse"]])
    return E.head_predictions(r.withColumn("scores", s), 0.7)


@query
def head_report(spark, d):
    return E.head_report(_heads(spark, d))[0].select("label", "tp", "fp", "fn", "support", "f1")


@query
def head_confusion(spark, d):
    return E.head_report(_heads(spark, d))[1]


@query
def head_summary(spark, d):
    return E.head_summary(_heads(spark, d)).select("records", "top1_right")


def _gated(spark, d) -> DataFrame:
    r = records(spark, d).select(F.col("rec_id").alias("id"), "text", F.coalesce(F.arrays_overlap("labels", L.literal_list([*T.HARMFUL, "sexual"])), F.lit(False)).alias("unsafe"))
    return r.withColumn("gate", F.greatest(S.hash_score(F.col("id"), "harmful"), S.hash_score(F.col("id"), "sexual")))


@query
def gate_metrics(spark, d):
    return E.gate_sweep(_gated(spark, d), E.GRID_99)


@query
def gate_choice(spark, d):
    return E.gate_choice(E.gate_sweep(_gated(spark, d), E.GRID_99), 0.02)


@query
def false_pass_samples(spark, d):
    return R.false_pass_samples(_gated(spark, d).filter("text is not null"), 0.3).select("id", F.md5("text").alias("text_hash"))


@query
def fast_allow(spark, d):
    has = lambda xs: F.coalesce(F.arrays_overlap("labels", L.literal_list(xs)), F.lit(False))
    r = records(spark, d).select(S.hash_score(F.col("rec_id"), "attack").alias("attack"), S.hash_score(F.col("rec_id"), "moderation").alias("moderation"), has(["prompt_injection", "jailbreak"]).alias("is_attack"), has([x for x in T.RISK if x not in T.HEADS["attack"]]).alias("is_moderation"))
    return E.fast_allow(r, E.GRID_49)


@query
def route_thresholds(spark, d):
    return E.route_thresholds(E.sweep(long_scores(spark, d), E.GRID_49, ["label"]), ["label"]).select("label", F.round(F.col("threshold") * 100).cast("long").alias("percent"))


@query
def score_drift(spark, d):
    a = long_scores(spark, d)
    b = a.withColumn("score", F.round(F.col("score") * 127) / 127)
    g = E.score_drift(a, b, ["id", "label"])
    return g.select("n", "max_abs_diff", F.round(F.col("mean_abs_diff") * 1e9).cast("long").alias("mean9"), F.round(F.col("agreement") * 1e9).cast("long").alias("agree9"))


def _models(spark, d) -> DataFrame:
    """Scores of three stand-in models over their labels."""
    targets = {"injection": ["prompt_injection"], "jailbreak": ["jailbreak"], "moderation": T.MODERATED}
    r = table(spark, d, "all_test").select(F.col("rec_id").alias("id"), "labels")
    each = [F.struct(F.lit(m).alias("model"), F.lit(x).alias("label"), F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("int").alias("gold"), S.hash_score(F.concat(F.lit(m), "id"), x).alias("score")) for m, xs in targets.items() for x in xs]
    return r.select("id", F.explode(F.array(*each)).alias("e")).select("id", "e.*")


_nine = lambda *cs: [F.round(F.col(c) * 1e9).cast("long").alias(c) for c in cs]


@query
def model_baseline(spark, d):
    m = C.model_baseline(_models(spark, d))
    return m.select("model", "labels", "status", *_nine("macro_f1", "macro_best_f1", "macro_pr_auc"))


@query
def model_status(spark, d):
    return C.overall(C.model_baseline(_models(spark, d)), 4)


@query
def label_metrics(spark, d):
    m = C.label_metrics(long_scores(spark, d), ["label"])
    return m.select("label", "support", "precision", "recall", "f1", "best_f1_threshold", "best_f1", "high_recall_threshold", *_nine("pr_auc", "roc_auc"))


@query
def trainer_metrics(spark, d):
    best, one = C.trainer_metrics(long_scores(spark, d))
    names = ["micro_f1", "macro_f1", "macro_best_f1", "macro_pr_auc"]
    both = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("e")).select("e.*")
    return both.unionByName(best.select(F.concat(F.lit("best_f1_"), "label").alias("name"), F.col("best_f1").alias("value")))


@query
def head_calibration(spark, d):
    """Calibrated thresholds of every head and label."""
    r = table(spark, d, "all_val").select(F.col("rec_id").alias("id"), "labels")
    each = [F.struct(F.lit(h).alias("head"), F.lit(x).alias("label"), F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("int").alias("gold"), S.hash_score(F.col("id"), x).alias("score")) for h, xs in T.HEADS.items() for x in xs]
    return C.calibrate_heads(r.select(F.explode(F.array(*each)).alias("e")).select("e.*"), ["head", "label"])[0]


def _router(spark, d) -> DataFrame:
    has = lambda xs: F.coalesce(F.arrays_overlap("labels", L.literal_list(xs)), F.lit(False))
    raw = F.create_map(F.lit("__label__attack"), S.hash_score(F.col("rec_id"), "attack"), F.lit("moderation"), S.hash_score(F.col("rec_id"), "moderation"), F.lit("other"), F.lit(1.0))
    r = records(spark, d).select(S.router_scores(raw).alias("s"), has(["prompt_injection", "jailbreak"]).alias("is_attack"), has([x for x in T.RISK if x not in T.HEADS["attack"]]).alias("is_moderation"))
    return r.select("s.attack", "s.moderation", "is_attack", "is_moderation")


@query
def router_routes(spark, d):
    return C.router_report(_router(spark, d))[0]


@query
def router_recommendation(spark, d):
    return C.router_report(_router(spark, d), 0.05)[2]


@query
def merged_head(spark, d):
    """Scores of the merged head from labels with and without prefix; other labels are left out."""
    raw = F.create_map(F.lit("__label__harmful_content"), S.hash_score(F.col("doc_id"), "h"), F.lit("sexual"), S.hash_score(F.col("doc_id"), "s"), F.lit("__label__odd"), F.lit(0.5))
    return table(spark, d, "documents").select("doc_id", S.merged_head_scores(raw).alias("m")).select("doc_id", "m.*")


def _benchmark(spark, d) -> DataFrame:
    return table(spark, d, "test").filter("label is not null").select(F.col("row_id").alias("id"), "text", F.col("label").alias("gold"), S.hash_score(F.col("row_id"), "bench").alias("score"))


@query
def external_benchmark(spark, d):
    b = C.external_benchmark(_benchmark(spark, d))[0]
    return b.select("rows", "positives", "best_threshold", "best_f1", "route_precision", "route_recall", "route_f1", "default_precision", "default_recall", "default_f1", "verdict", *_nine("pr_auc", "roc_auc"))


@query
def benchmark_misses(spark, d):
    return C.external_benchmark(_benchmark(spark, d))[1].select("kind", "id", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))


@query
def score_comparison(spark, d):
    a = _benchmark(spark, d).select("id", "gold", "score")
    return C.compare_scores(a.withColumn("score", F.round(F.col("score") * 7) / 7), a, ["id"])


@query
def candidate_choice(spark, d):
    """The smallest candidate within the tolerances, and what is taken if none is."""
    some = spark.createDataFrame([("int8", 100, 0.001, 0.0019), ("fp16", 200, 0.0, 0.0), ("int4", 50, 0.01, 0.0)], "name string, size_bytes long, best_f1_drop double, pr_auc_drop double")
    return E.smallest_within(some).withColumn("kind", F.lit("some")).unionByName(E.smallest_within(some.filter("name = 'int4'")).withColumn("kind", F.lit("none")))


@query
def metric_deltas(spark, d):
    a = spark.createDataFrame([("x", 0.5, 0.8), ("y", 0.5, 0.8), ("z", 0.5, 0.8)], "name string, macro_f1 double, recall double")
    b = spark.createDataFrame([("x", 0.46, 0.9), ("y", 0.48, 0.8), ("w", 0.1, 0.1)], "name string, macro_f1 double, recall double")
    out = E.metric_diff(a, b, "name", ["macro_f1", "recall"])
    return out.select("name", F.round("macro_f1_delta", 9).alias("macro_f1_delta"), F.round("recall_delta", 9).alias("recall_delta"), "status")


@query
def component_status(spark, d):
    """The worst status of components, and the verdict of benchmarks."""
    c = spark.createDataFrame([("a", "PASS", 0.9), ("a", "WARN", 0.7), ("b", "PASS", 0.69), ("c", "FAIL", 0.85), ("c", "PASS", 0.1)], "part string, status string, f1 double")
    return c.groupBy("part").agg(R.worst_status(F.col("status")).alias("status"), F.array_join(F.array_sort(F.collect_list(R.benchmark_verdict(F.col("f1")))), ",").alias("verdicts"))


def _trained(spark, d) -> tuple[DataFrame, DataFrame]:
    """Heads trained on all_train, their scores of all_val and all_test, with gold labels of each head; a record is scored once for all heads."""
    clean = lambda n: spread(table(spark, d, n)).filter("text is not null and labels is not null").select("rec_id", "text", "sources", F.array_distinct(F.array_compact("labels")).alias("labels"))
    own = {h: L.head_labels(F.col("labels"), h, F.col("sources")) for h in T.HEADS}
    any_head = lambda n: clean(n).withColumns(own).filter(" or ".join(f"size({h}) > 0" for h in T.HEADS)).drop(*T.HEADS)
    made = heads.train_heads(clean("all_train").withColumns(own), "text", {h: h for h in T.HEADS}, heads.HeadParams(buckets=1 << 16, iterations=10))
    return [B.head_projection(stage(heads.score_heads(any_head(n).withColumnRenamed("text", "detection_text"), made), "head-scores")) for n in ("all_val", "all_test")]


@query
def trained_heads(spark, d):
    """Trained n-gram heads on the test split: rates of every head and label at 0.5, with the routes calibrated on the validation split."""
    val, test = _trained(spark, d)
    long = lambda df: df.select("head", F.explode(F.transform("head_scores", lambda s: F.struct(s["label"].alias("label"), F.array_contains("head_labels", s["label"]).cast("int").alias("gold"), s["score"].alias("score")))).alias("e")).select("head", "e.*")
    wanted = spark.createDataFrame([(h, x) for h, xs in T.HEADS.items() for x in xs if x != T.SAFE], "head string, label string")
    own = lambda df: long(df).join(F.broadcast(wanted), ["head", "label"], "left_semi")  # noqa: E731  # a fixed list of labels
    routes = C.calibrate_heads(own(val), ["head", "label"])[0].select("head", "label", "recommended")
    return C.label_metrics(own(test), ["head", "label"]).join(routes, ["head", "label"], "left")


# reports --------------------------------------------------------------------


@query
def label_distribution(spark, d):
    return R.label_distribution(records(spark, d))


@query
def top_sources(spark, d):
    return R.top_sources(records(spark, d))


@query
def record_checks(spark, d):
    return R.record_checks(records(spark, d))


@query
def length_stats(spark, d):
    return R.length_stats(records(spark, d), by=["split"])


@query
def imbalance(spark, d):
    return R.imbalance(R.labels_of(records(spark, d), "split").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")), by=["split"])


@query
def event_percentiles(spark, d):
    return R.percentiles(table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), "cents", ["event_type"]).select("event_type", "n", "min", "max", "p50", "p95", "p99")


@query
def error_buckets(spark, d):
    return R.error_buckets(long_scores(spark, d), 0.6, ["label"])


@query
def error_sources(spark, d):
    return R.error_sources(long_scores(spark, d), 0.6, 5, ["label"])


@query
def worst_false_positives(spark, d):
    return R.worst_false_positives(long_scores(spark, d), 0.6, by=["label"]).select("label", "id", "score")


@query
def weakest_positives(spark, d):
    return R.weakest_positives(long_scores(spark, d), by=["label"]).select("label", "id", "score")


@query
def build_summary(spark, d):
    return R.build_summary(records(spark, d), T.MODERATED)


def _lines(spark, d) -> DataFrame:
    return _projected(spark, d).filter("text is not null").select("head", sinks.head_line(F.col("head_labels"), F.col("text")).alias("value"), "split")


@query
def head_file_checks(spark, d):
    return R.head_file_checks(_lines(spark, d))


@query
def head_file_labels(spark, d):
    return scan.count_labels(_lines(spark, d))


@query
def head_file_scan(spark, d):
    return scan.parse_head_lines(_lines(spark, d)).select(F.md5("text").alias("text_hash"), F.array_join("labels", ",").alias("labels"))


@query
def merged_head_lines(spark, d):
    r = records(spark, d).filter("text is not null and labels is not null").withColumn("labels", F.array_compact("labels"))
    return r.select("rec_id", F.md5(sinks.merged_head_line(F.col("labels"), F.col("text"))).alias("line_hash"))


# sources and streams --------------------------------------------------------


@query
def adapt_generic(spark, d):
    a = A.adapt(table(spark, d, "documents").select("doc_id", "text", F.array_join("labels", " , ").alias("labels")), "generic", "documents")
    return a.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query
def adapt_binary(spark, d):
    words = F.concat_ws(" ", F.array_compact("raw_labels"))
    return records(spark, d).select("rec_id", A.to_binary(F.when(F.col("raw_labels").isNotNull(), words)).alias("binary"))


@query
def adapt_columns(spark, d):
    """Jigsaw-like columns made of the records' labels."""
    has = lambda x: F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("double")
    r = records(spark, d).select(F.col("text").alias("comment_text"), has("toxicity").alias("toxic"), (has("violence") * 0.7).alias("threat"), (has("hate") * 0.4).alias("identity_hate"), has("harassment").alias("insult"))
    return A.adapt(r, "jigsaw", "records").groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query
def adapt_civil(spark, d):
    has = lambda x: F.coalesce(F.array_contains("labels", x), F.lit(False)).cast("double")
    r = records(spark, d).select("text", has("toxicity").alias("toxicity"), has("hate").alias("identity_attack"), has("violence").alias("threat"), has("sexual").alias("sexual_explicit"), (has("harassment") * 0.5).alias("insult"))
    a = A.adapt(r, "civil_labels", "civil").groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("labels"))
    return a.unionByName(A.adapt(r, "civil_route", "civil").groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("route")))


def _adapter(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        schema, rows = ADAPTER_ROWS[kind]
        return A.adapt(spark.createDataFrame(rows, schema), kind, f"{kind}_rows").select("text", F.array_join("labels", ",").alias("labels"), "source")

    run.__name__ = f"adapter_{kind}"
    run.__doc__ = f"The {kind} adapter over literal rows of its external shape."
    return run


for _kind in ADAPTER_ROWS:
    query(_adapter(_kind))


@query
def binary_labels(spark, d):
    """Both variants of the binary label over literal spellings."""
    v = F.col("v")
    return spark.createDataFrame([(x,) for x in BINARY_LABELS], "v string").select(F.coalesce(v, F.lit("(null)")).alias("value"), A.to_binary(v).alias("build"), A.to_binary(v, build=False).alias("evaluate"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query
def jsonl_round_trip(spark, d):
    """Documents with text written as JSON lines and scanned again."""
    path = _folder(spark, "jsonl")
    docs = table(spark, d, "documents").select("text", "labels", "source")
    written, skipped = sinks.write_jsonl(docs, path)
    back = scan.read_jsonl(spark, path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.coalesce(F.size("labels"), F.lit(0))).alias("labels")).withColumn("written", F.lit(written).cast("long")).withColumn("skipped", F.lit(skipped).cast("long"))


@query
def split_round_trip(spark, d):
    """The processed records written by split and read again."""
    path = _folder(spark, "splits")
    sinks.write_splits(records(spark, d).select("rec_id", "text", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


@query
def head_file_round_trip(spark, d):
    """Head lines written as text files, scanned and counted again."""
    path = _folder(spark, "heads")
    sinks.write_head_lines(_lines(spark, d), path)
    back = scan.read_head_lines(spark, path)
    n = scan.count_labels(back)
    return n.withColumn("lines", F.lit(back.count()))


@query
def detected_columns(spark, d):
    """Detected text and label columns of every table that has a text."""
    names = ["all_test", "documents", "test", "normalized_text"]
    rows = []
    for n in names:
        cols = table(spark, d, n).columns
        got = scan.detect_columns(cols)
        rows.append((n, got["text"], got["label"], scan.detect_key([c.upper() for c in cols], scan.LABEL_KEYS)))
    return spark.createDataFrame(rows, "name string, text_column string, label_column string, key string")


def _loaded(spark, d: str) -> tuple[list, str, str]:
    out = _folder(spark, "sources")
    sources = {
        "documents": ("generic", lambda: table(spark, d, "documents").select("text", F.array_join("labels", ",").alias("labels"))),
        "binary": ("prompt_injection", lambda: table(spark, d, "test").select("text", F.col("label").cast("string").alias("label"))),
        "nothing": ("generic", lambda: table(spark, d, "documents").select("text").limit(0)),
        "missing": ("generic", lambda: spark.read.parquet(f"{d}/no_such_table")),
    }
    return *load_all(spark, sources, out), out


@query
def source_availability(spark, d):
    """Load, adapt and write four sources, one empty and one that fails; what became of each."""
    results, status, out = _loaded(spark, d)
    report = sinks.load_report(spark, out, "availability")
    a = availability(spark, results).drop("error").withColumn("overall", F.lit(status)).withColumn("reported", F.lit(report["status"]))
    return a.withColumn("label_column", F.coalesce("label_column", F.lit("-"))).withColumn("text_column", F.coalesce("text_column", F.lit("-"))).withColumn("license", F.coalesce("license", F.lit("-")))


@query
def custom_files(spark, d):
    """Local CSV and JSONL files found by a pattern, read as sources."""
    path = _folder(spark, "custom")
    sinks.write_text(spark, f"{path}/one.csv", 'text,label\n"a ""quoted""\nline",1\nplain,0\n')
    sinks.write_text(spark, f"{path}/two.jsonl", '{"text": "first", "label": "1"}\n{"text": "second", "label": null}\n')
    sinks.write_text(spark, f"{path}/skipped.txt", "not a source")
    good, _ = scan.read_custom(spark, scan.custom_paths(spark, f"{path}/*"))
    return reduce(DataFrame.unionByName, [df.select("text", F.col("label").cast("string").alias("label"), F.lit(n).alias("source")) for n, df in good.items()])


@query
def length_filter(spark, d):
    return Q.length_between(table(spark, d, "documents")).select("doc_id")


@query
def capped_pairs(spark, d):
    """Binary rows with a cap a source, negatives cut to twice and a half the positives."""
    t = table(spark, d, "test").withColumn("hash", F.sha2(F.col("row_id").cast("string"), 256)).filter("label = 0 or row_id % 4 = 0")
    return B.cap_pairs(t, 15).select("row_id", "label")


@query
def capped_safe(spark, d):
    r = records(spark, d).withColumn("hash", F.concat(F.coalesce("hash", F.lit("")), F.lit("#"), "rec_id"))
    return B.cap_safe_rows(r, F.coalesce(F.col("labels") == F.array(F.lit("safe")), F.lit(False)), 300, 0.05).select("rec_id")


@query
def blended(spark, d):
    a, b = (table(spark, d, n).select("rec_id", F.sha2(F.col("rec_id").cast("string"), 256).alias("hash")) for n in ("all_val", "all_test"))
    return B.blend(a, b.withColumn("extra", F.lit(1)))


@query
def cap_by_environment(spark, d):
    """Caps by head and split under settings of the environment."""
    envs = {"default": {}, "one head": {"SC_MAX_PER_LABEL_ABUSE": "80"}, "all": {"SC_MAX_PER_LABEL": "100"}, "older": {"SC_MAX_SAFE_PER_HEAD": "40"}, "none": {"SC_MAX_PER_LABEL": "0"}, "broken": {"SC_MAX_PER_LABEL": "x"}}
    rows = [(n, h, s, B.resolve_cap(h, s, e)) for n, e in envs.items() for h in T.HEADS for s in ("train", "val")]
    return spark.createDataFrame(rows, "setting string, head string, split string, cap int")


@query
def quota_scan(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return scan.quota_scan(t, "text", F.coalesce("kind", F.lit("-")), 20, F.col("doc_id")).select("doc_id", "kind")


@query
def tumbling_events(spark, d):
    return tumbling_counts(table(spark, d, "events"), streaming=False)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
