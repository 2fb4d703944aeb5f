"""Record filters: each gives every record a reason, null for the kept ones.

Conditions are tested in the given order and the first that holds is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions.labels import coarse_labels, literal_list
from ..functions.text import collapse, strip


def first_reason(cases: list[tuple[str, Column]]) -> Column:
    out = None
    for name, cond in cases:
        hit = F.coalesce(cond, F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def no_labels(labels: Column) -> Column:
    return labels.isNull() | (F.size(labels) == 0)


def check_record(text: Column, labels: Column, shortest: int = 3, longest: int = 20_000) -> Column:
    """non_string_text, too_short, too_long, missing_labels; lengths without outer blanks."""
    n = F.length(strip(text))
    return first_reason([("non_string_text", text.isNull()), ("too_short", n < shortest), ("too_long", n > longest), ("missing_labels", no_labels(labels))])


def quality_reason(text: Column, labels: Column, shortest: int = 10, longest: int = 2000) -> Column:
    """empty_text, too_short, too_long, no_labels, only_unknown, mixed_safe_risk."""
    t = strip(F.coalesce(text, F.lit("")))
    return first_reason([
        ("empty_text", t == ""), ("too_short", F.length(t) < shortest), ("too_long", F.length(t) > longest), ("no_labels", no_labels(labels)),
        ("only_unknown", labels == literal_list([T.UNKNOWN])), ("mixed_safe_risk", F.array_contains(labels, T.SAFE) & F.arrays_overlap(labels, literal_list(T.RISK))),
    ])


def source_has(source: Column, hints: list[str]) -> Column:
    """Whether any hint is part of the lower-cased source."""
    return F.coalesce(F.lower(source).rlike("|".join(hints)), F.lit(False))


def clean_records(df: DataFrame, supported: list[str], merged: bool = False, shortest: int = 8, longest: int = 2000) -> DataFrame:
    """Add clean_text, clean_labels (null if dropped), original_labels and reason.

    Positive rows need a trusted positive source, rows that are only safe a trusted
    safe one.  With ``merged`` the labels are harmful_content and sexual, and safe
    rows have an empty list.
    """
    text, labels = collapse(F.coalesce("text", F.lit(""))), F.array_compact(F.coalesce("labels", F.array().cast("array<string>")))
    mine = F.array_sort(coarse_labels(labels) if merged else F.array_intersect(F.array_distinct(labels), literal_list(supported)))
    positive = F.size(mine) > 0
    safe_only = ~positive & F.array_contains(labels, T.SAFE) & ~F.arrays_overlap(labels, literal_list([*T.RISK, T.UNKNOWN]))
    unsupported = F.arrays_overlap(labels, literal_list(["prompt_injection", "jailbreak", "dangerous_information", "illegal_activity", T.UNKNOWN]))
    positive_hints = [*T.TRUSTED_POSITIVE, "aegis"] if merged else T.TRUSTED_POSITIVE
    reason = first_reason([
        ("empty_text", text == ""), ("too_short", F.length(text) < shortest), ("too_long", F.length(text) > longest),
        ("untrusted_positive_source", positive & ~source_has(F.col("source"), positive_hints)), ("untrusted_safe_source", safe_only & ~source_has(F.col("source"), T.TRUSTED_SAFE)),
        ("unsupported_risk_only", ~positive & ~safe_only & unsupported), ("no_supported_label", ~positive & ~safe_only),
    ])
    kept = F.when(positive, mine).otherwise(literal_list([]) if merged else literal_list([T.SAFE]))
    out = df.withColumn("clean_text", text).withColumn("reason", reason).withColumn("original_labels", F.array_sort(F.array_distinct(labels)))
    return out.withColumn("clean_labels", F.when(F.col("reason").isNull(), kept))


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_between(df: DataFrame, text: str = "text", shortest: int = 8, longest: int = 4000) -> DataFrame:
    """Rows whose text, white space collapsed, has a length within the bounds; null texts are dropped."""
    return df.filter(F.length(collapse(F.col(text))).between(shortest, longest))
