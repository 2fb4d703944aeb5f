"""The deterministic gate: rule families and obfuscation signals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T

# Evasions.
SPACED = r"(?U)(?:\b\w\b[\s._\-]+){5,}\w\b"
HOMOGLYPHS = r"[\x{400}-\x{4FF}\x{370}-\x{3FF}]"
LEET = ("0134578@$!", "oieastbasi")


def family_regex(patterns: list[str]) -> str:
    """One alternation for a whole family, for lower-cased texts; Unicode classes only where the patterns have any."""
    low = lambda p: re.sub(r"\\.|[^\\]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), p)  # noqa: E731  # escapes keep their case
    both = "|".join(f"(?:{low(p)})" for p in patterns)
    return ("(?U)" if re.search(r"\\[wbs]", both) else "") + both


def deobfuscate(text: Column) -> Column:
    """Lower case, spaced letters joined, leet digits read as letters, long runs of a character cut to one."""
    low = F.lower(text)
    joined = F.when(low.rlike(SPACED), F.regexp_replace(low, r"(?U)(?<=\b\w)[\s._\-]+(?=\w\b)", "")).otherwise(low)
    return F.regexp_replace(F.translate(joined, *LEET), r"(.)\1{4,}", "$1")


def with_gate(df: DataFrame, detection: str, original: str, flags: str, out: str = "gate") -> DataFrame:
    """Add a struct (force_route, block, reasons, allow_fast_skip, matched); null where detection is null.

    Each family is one column, searched once in the text and once in its
    de-obfuscated form (only where that differs).
    """
    src, low = F.coalesce(F.col(original), F.lit("")), F.lower(F.coalesce(F.col(detection), F.lit("")))
    d = df.withColumn("_low", low).withColumn("_spaced", src.rlike(SPACED)).withColumn("_plain", deobfuscate(src))
    d = d.withColumn("_plain", F.when(F.col("_plain") != F.col("_low"), F.col("_plain")).otherwise(F.lit("")))
    d = d.withColumns({f"_g_{n}": F.col("_low").rlike(family_regex(p)) | F.col("_plain").rlike(family_regex(p)) for n, _, _, p in T.RULES})
    flag = lambda n: F.coalesce(F.col(flags)[n], F.lit(False))
    signals = [("zero_width", flag("excessive_zero_width")), ("non_printable", flag("high_non_printable")), ("base64", flag("suspicious_base64")), ("separators", flag("excessive_separators")), ("spaced_chars", F.col("_spaced")), ("homoglyphs", src.rlike(HOMOGLYPHS))]
    d = d.withColumn("_seen", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signals])))
    hit = lambda route: reduce(lambda a, b: a | b, [F.col(f"_g_{n}") for n, r, _, _ in T.RULES if r == route])
    d = d.withColumns({"_attack": hit("attack") | (F.size("_seen") > 0), "_moderation": hit("moderation")})
    block = reduce(lambda a, b: a | b, [F.col(f"_g_{n}") for n, _, blocks, _ in T.RULES if blocks])
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_g_{n}"), F.lit(f"rule:{n}")) for n, *_ in T.RULES], F.when(F.size("_seen") > 0, F.concat(F.lit("obfuscation:"), F.array_join("_seen", ",")))))
    routes = F.array_compact(F.array(F.when(F.col("_attack"), F.lit("attack")), F.when(F.col("_moderation"), F.lit("moderation"))))
    matched = F.col("_attack") | F.col("_moderation") | block
    made = F.struct(routes.alias("force_route"), block.alias("block"), reasons.alias("reasons"), (~matched).alias("allow_fast_skip"), matched.alias("matched"))
    return d.withColumn(out, F.when(F.col(detection).isNotNull(), made)).select(*df.columns, out)


def attack_phrase(detection: Column) -> Column:
    """Whether the text has one of the routing phrases."""
    out = F.lit(False)
    for p in T.ATTACK_PHRASES:
        out = out | F.contains(detection, F.lit(p))
    return out


def weak_labels(text: Column) -> Column:
    """Labels whose keywords occur in the text, in label order; [unknown] if none."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(low.rlike("(?U)" + "|".join(p)), F.lit(n)) for n, p in T.WEAK_LABELS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(T.UNKNOWN)))
