"""Structured Streaming: stateless classification, first-wins dedup, windowed counts.

Classification has no shuffle and no state, so it runs on streams as on tables, long
records and their windows included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..plans.classify import classify, stand_ins


def classify_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Decisions for a stream of records: no state, no shuffle."""
    heads, models = stand_ins()
    return classify(stream, heads, models, text)


def dedup_stream(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """The first record of each normalized text within the watermark.

    Labels are not united (a batch operator does that): state is one hash a text.
    """
    s = normalize(stream, text).filter("text_hash is not null")
    return s.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def tumbling_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", delay: str = "10 minutes", streaming: bool = True) -> DataFrame:
    """(window_start, key, n, total) by tumbling window; late rows beyond the watermark are dropped on streams."""
    e = events.withWatermark(time, delay) if streaming else events
    got = e.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
    return got.select(F.col("w.start").alias("window_start"), key, "n", "cents")


def for_each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run any batch plan on each micro-batch; with an idempotent sink every batch counts once."""
    return stream.writeStream.foreachBatch(lambda df, epoch: sink(plan(df), epoch)).option("checkpointLocation", checkpoint).start()
