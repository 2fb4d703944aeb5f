"""Text normalization as column expressions.

``normalize`` runs in the JVM except for the three steps Spark has no function for
(Unicode NFKC, HTML entities, percent escapes): those run in one Arrow UDF that only
rows with a non-ASCII character, ``&`` or ``%`` are sent to.
"""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and limits of the normalizer.
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"
TAGS = r"[\x{E0000}-\x{E007F}]"
SPACE = r"(?U)[\s\x{1C}-\x{1F}]+"
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t\r]]"
SEPARATORS = r"([\-=_*~#.])\1{9,}"
BASE64_SPAN = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])"
MOST_SPANS, MOST_DECODED = 4, 512
EXCESSIVE_ZERO_WIDTH, HIGH_UNPRINTABLE = 5, 0.15

_INVISIBLE = re.compile("[\u200b-\u200d\ufeff\U000e0000-\U000e007f]")
_ZERO = re.compile("[\u200b-\u200d\ufeff]")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (collapse(text) == "")


def snippet(text: Column, most: int = 260) -> Column:
    """White space collapsed and cut to ``most`` characters, three of them dots."""
    c = collapse(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for t in texts:
            if t is None:
                out.append((None, None, None))
                continue
            t = unicodedata.normalize("NFKC", t)
            zero = len(_ZERO.findall(t))
            clean = _INVISIBLE.sub("", t)
            out.append((urllib.parse.unquote(html.unescape(clean)), zero, len(t) - len(clean) - zero))
        yield pd.DataFrame(out, columns=["text", "zero", "tags"])


def decoded_base64(text: Column) -> Column:
    """The readable texts behind the first base64 spans: whole quartets, valid UTF-8, at least 80 % printable."""
    spans = F.slice(F.regexp_extract_all(text, F.lit(BASE64_SPAN), F.lit(0)), 1, MOST_SPANS)
    whole = F.filter(spans, lambda s: F.length(s) % 4 == 0)
    raw = F.filter(F.transform(whole, lambda s: F.try_to_binary(s, F.lit("base64"))), lambda b: b.isNotNull())
    text_of = F.filter(F.transform(raw, lambda b: b.cast("string")), lambda s: F.is_valid_utf8(s) & (F.length(s) > 0))
    readable = F.filter(text_of, lambda s: F.length(s) - F.regexp_count(s, F.lit(r"[\p{C}\p{Z}&&[^ \n\t]]")) >= 0.8 * F.length(s))
    return F.transform(readable, lambda s: F.lower(F.substring(s, 1, MOST_DECODED)))


def normalize(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add model_text, detection_text, text_hash and the struct ``flags``.

    Null or blank text gives null in all of them (the rejected rows).
    """
    src = F.when(~is_blank(F.col(text_col)), F.col(text_col))
    special = src.rlike(r"[^\x{0}-\x{7F}]|[&%]")
    out = df.withColumn("_src", src).withColumn("_d", F.pandas_udf(_decoded, "text string, zero int, tags int")(F.when(special, F.col("_src"))))
    out = out.withColumn("_work", F.coalesce("_d.text", "_src"))
    ratio = F.regexp_count("_work", F.lit(UNPRINTABLE)) / F.nullif(F.length("_work"), F.lit(0))
    out = out.withColumn("_ratio", F.when(F.col("_src").isNotNull(), F.coalesce(ratio, F.lit(0.0)))).withColumn("model_text", collapse(F.col("_work")))
    spans = F.regexp_count("model_text", F.lit(BASE64_SPAN))
    found = F.when(spans > 0, decoded_base64(F.col("model_text"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_found", found)
    zero = F.coalesce("_d.zero", F.lit(0))
    flags = F.struct(
        zero.alias("zero_width_removed"), F.coalesce("_d.tags", F.lit(0)).alias("tag_chars_removed"), (zero >= EXCESSIVE_ZERO_WIDTH).alias("excessive_zero_width"),
        F.bround("_ratio", 4).alias("non_printable_ratio"), (F.col("_ratio") > HIGH_UNPRINTABLE).alias("high_non_printable"), F.col("_work").rlike(SEPARATORS).alias("excessive_separators"),
        spans.alias("base64_span_count"), (spans > 0).alias("suspicious_base64"), F.when(F.size("_found") > 0, F.size("_found")).alias("base64_decoded_count"),
    )
    detection = F.concat_ws(" ", F.lower("model_text"), F.when(F.size("_found") > 0, F.concat_ws(" ", "_found")))
    given = F.col("_src").isNotNull()
    out = out.withColumn("detection_text", F.when(given, detection)).withColumn("text_hash", F.when(given, F.sha2("model_text", 256))).withColumn("flags", F.when(given, flags))
    return out.drop("_src", "_d", "_work", "_ratio", "_found")
