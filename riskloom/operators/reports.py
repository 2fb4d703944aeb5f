"""Distribution, length, error and build reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .. import taxonomy as T
from ..functions.text import strip
from ..plans.prefix import with_running
from ..plans.skew import fits
from ..plans.staging import stage
from .balance import first_n, top_by

# Error-report buckets (from, name), highest first.
SCORE_BUCKETS = [(0.9, "0.90-1.00"), (0.75, "0.75-0.90"), (0.5, "0.50-0.75"), (0.25, "0.25-0.50"), (0.1, "0.10-0.25")]
LOWEST_BUCKET = "0.00-0.10"
STATUSES = ["PASS", "WARN", "FAIL"]


def labels_of(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each record and label entry (nulls left out)."""
    return df.select(*keep, F.explode("labels").alias("label")).filter("label is not null")


def label_distribution(df: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(label, n, share, one count for each split): entries of each label against all records."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    per = labels_of(df, "split").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in splits])
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.nullif("_all", F.lit(0))).drop("_all")  # a single row


def top_sources(df: DataFrame, most: int = 5) -> DataFrame:
    """(label, source, n, place): the most frequent sources of each label; ties by name."""
    per = labels_of(df, F.coalesce("source", F.lit("unknown")).alias("source")).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "source")
    return per.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def record_checks(df: DataFrame) -> DataFrame:
    """Records, empty texts, missing labels and entries of ``unknown``."""
    unknown = F.coalesce(F.size(F.filter("labels", lambda x: x == T.UNKNOWN)), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce(strip(F.col("text")), F.lit("")) == "").alias("empty_text"),
        F.count_if(F.col("labels").isNull() | (F.size("labels") == 0)).alias("missing_labels"), F.sum(F.when(unknown > 0, unknown).otherwise(0)).alias("unknown_entries"),
    )


def percentiles(df: DataFrame, value: str, by: list[str] | None = None, ps: dict[str, float] | None = None) -> DataFrame:
    """count, avg, min, max and the values at index floor(p (n - 1)) of the sorted column.

    Values are counted first, then the distinct values get running counts (a two-level
    prefix, so a group of many distinct values is no single task); nulls are left out.
    An empty table gives n = 0 and nulls.
    """
    by, ps = by or [], ps or {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = with_running(counts, by, value, {"_n": "_before"})
    totals = stage(run.groupBy(*[F.col(c).alias(f"_k_{c}") for c in by]).agg(F.sum("_n").alias("_all")), "totals")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.lit(True))
    j = run.join(F.broadcast(totals) if fits(totals) else totals, same, "left")
    at = [F.min(F.when(F.col("_before") + F.col("_n") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col(value))).alias(name) for name, p in ps.items()]
    return j.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), *at)


def length_stats(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    return percentiles(df.withColumn("_len", F.length(F.coalesce(text, F.lit("")))), "_len", by, {"p50": 0.50, "p95": 0.95})


def imbalance(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """Largest over smallest count that is not 0; 0 if there is none."""
    some = F.when(F.col(n) > 0, F.col(n))
    return counts.groupBy(*(by or [])).agg(F.coalesce(F.max(some) / F.min(some), F.lit(0.0)).alias("imbalance"))


def head_file_checks(lines: DataFrame) -> DataFrame:
    """(head, label, n, status) of head lines (head, value): first label of each line; none FAIL, under 100 WARN."""
    first = F.regexp_extract("value", r"^__label__([^ ]*)", 1)
    got = lines.filter(F.startswith("value", F.lit("__label__"))).groupBy("head", first.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    want = lines.sparkSession.createDataFrame([(h, x) for h, names in T.HEADS.items() for x in names], "head string, label string")
    j = want.join(got, ["head", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("status", F.when(F.col("n") == 0, "FAIL").when(F.col("n") < 100, "WARN").otherwise("PASS"))


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Head lines without a label prefix, by head."""
    return lines.groupBy("head").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.startswith("value", F.lit("__label__"))).alias("malformed"))


def score_bucket(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for low, name in SCORE_BUCKETS:
        out = out.when(score >= low, name)
    return out.otherwise(LOWEST_BUCKET)


def error_buckets(scored: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, n, positives, false_positives, false_negatives)."""
    hit, gold = F.col("score") >= threshold, F.col("gold") == 1
    return scored.groupBy(*(by or []), score_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(gold).alias("positives"), F.count_if(hit & ~gold).alias("false_positives"), F.count_if(~hit & gold).alias("false_negatives"))


def error_sources(scored: DataFrame, threshold: float, most: int = 20, by: list[str] | None = None) -> DataFrame:
    """(by, kind, source, n): the most frequent sources of positives, false positives and false negatives; ties by name."""
    hit, gold = F.col("score") >= threshold, F.col("gold") == 1
    kinds = F.array_compact(F.array(F.when(gold, F.lit("positive")), F.when(hit & ~gold, F.lit("false_positive")), F.when(~hit & gold, F.lit("false_negative"))))
    by = by or []
    per = scored.select(*by, F.explode(kinds).alias("kind"), F.coalesce("source", F.lit("unknown")).alias("source")).groupBy(*by, "kind", "source").agg(F.count(F.lit(1)).alias("n"))
    return top_by(per, [*by, "kind"], [F.desc("n"), F.col("source")], most)


def worst_false_positives(scored: DataFrame, threshold: float, most: int = 20, by: list[str] | None = None) -> DataFrame:
    """The negatives scored highest, overall or of each group (cut to ``most`` before the exchange)."""
    wrong, order = scored.filter((F.col("score") >= threshold) & (F.col("gold") == 0)), [F.desc("score"), F.col("id")]
    return top_by(wrong, by, order, most) if by else first_n(wrong, order, most)


def weakest_positives(scored: DataFrame, most: int = 20, by: list[str] | None = None) -> DataFrame:
    """The positives scored lowest, overall or of each group."""
    right, order = scored.filter("gold = 1"), [F.col("score"), F.col("id")]
    return top_by(right, by, order, most) if by else first_n(right, order, most)


def false_pass_samples(scored: DataFrame, threshold: float, most: int = 25) -> DataFrame:
    """The first unsafe rows that a gate lets pass (id, gate, unsafe, text), texts cut to 240 characters."""
    return first_n(scored.filter(F.col("unsafe") & (F.col("gate") < threshold)), [F.col("id")], most).withColumn("text", F.substring("text", 1, 240))


def routing_distribution(classified: DataFrame) -> DataFrame:
    """Shares of requests by model (column ``triggered``) and with no model at all."""
    has = lambda *parts: F.exists("triggered", lambda t: F.lower(t).rlike("|".join(parts)))
    n = F.count(F.lit(1))
    return classified.agg(
        n.alias("requests"), F.count_if(F.size(F.filter("triggered", lambda t: t != "heads")) == 0).alias("heads_only"), F.count_if(has("prompt.injection")).alias("prompt_injection"),
        F.count_if(has("jailbreak")).alias("jailbreak"), F.count_if(has("moderation", "tinysafe", "albert")).alias("moderation"),
    )


def decision_distribution(classified: DataFrame) -> DataFrame:
    """(kind, name, n): counts of decisions, risk levels and labels."""
    each = F.concat(F.array(F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name")), F.struct(F.lit("risk_level").alias("kind"), F.col("risk_level").alias("name"))), F.transform("labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name"))))
    return classified.select(F.explode(each).alias("e")).groupBy("e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))


def build_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """(split, rows, positives, safe and a count a label) in one pass."""
    has = lambda x: F.coalesce(F.array_contains("labels", x), F.lit(False))
    positive = F.lit(False)
    for x in names:
        positive = positive | has(x)
    only_safe = F.coalesce(F.col("labels") == F.array(F.lit(T.SAFE)), F.lit(False))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(positive).alias("positives"), F.count_if(only_safe).alias("safe_rows"), *[F.count_if(has(x)).alias(x) for x in names])


def split_source_totals(df: DataFrame) -> DataFrame:
    """Rows by split and source with the totals of each and of all, as grouping sets."""
    return df.groupingSets([["split", "source"], ["split"], ["source"], []], "split", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("split", "source").alias("level"))


def worst_status(status: Column) -> Column:
    """Aggregate: FAIL over WARN over PASS."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.max(rank).cast("int"))


def benchmark_verdict(f1: Column) -> Column:
    return F.when(f1 >= 0.85, "STRONG").when(f1 >= 0.70, "OK").otherwise("WEAK")


def stage_latency(df: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """Latency percentiles of each stage in microsecond steps."""
    return percentiles(df.withColumn("_v", F.round(F.col(ms), 3)), "_v", [stage])


def weak_labels(metrics: DataFrame, least: float = 0.6) -> DataFrame:
    """Labels with support whose F1 is under ``least``, weakest first by place."""
    weak = metrics.filter((F.col("support") > 0) & (F.col("f1") < least))
    return weak.withColumn("place", F.row_number().over(Window.orderBy("f1", "label"))).select("label", "f1", "place")  # one row a label


def fastest_mode(latency: DataFrame, prefix: str = "routed") -> DataFrame:
    """The mode (stage, avg) of least average latency among those that start with ``prefix``."""
    return latency.filter(F.startswith("stage", F.lit(prefix))).agg(F.min_by("stage", F.struct("avg", "stage")).alias("mode"))


def final_report(components: dict[str, str | None]) -> tuple[str, list[tuple[str, str]]]:
    """Overall status and a row for each component; a component without status was not run and is a warning."""
    rows = [(name, status or "NOT-RUN") for name, status in components.items()]
    rank = {"PASS": 0, "NOT-RUN": 1, "WARN": 1, "FAIL": 2}
    return STATUSES[max((rank[s] for _, s in rows), default=0)], rows
