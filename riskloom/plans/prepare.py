"""Raw records to a deduplicated, split corpus."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import map_labels
from ..functions.text import is_blank, normalize, strip
from ..operators.dedup import merged_labels, stable_split, union_duplicates
from ..operators.quality import check_record
from ..sources.adapters import adapt
from ..sources.scan import detect_columns
from ..sources.sinks import write_jsonl, write_report, write_text
from .staging import stage


def process(raw: DataFrame, text: str = "text", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(records, reasons): quality filter, normalization, label mapping, dedup with union, stable split.

    ``raw``: text, labels, source and an order column.  The first record of a hash
    keeps text and source; labels, raw labels and sources are united in order.
    """
    checked = raw.withColumn("reason", check_record(F.col(text), F.col("labels")))
    reasons = checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    good = normalize(checked.filter(F.col("reason").isNull() & ~is_blank(F.col(text))), text)
    good = good.select(
        F.col("model_text").alias("text"), "detection_text", F.col("text_hash").alias("hash"), F.col("labels").alias("raw_labels"), map_labels(F.col("labels"), F.col("model_text")).alias("labels"),
        "source", F.array("source").alias("sources"), order,
    )
    united = union_duplicates(good, "hash", order, keep=["text", "detection_text", "source"], nulls=False)
    return united.withColumn("labels", merged_labels(F.col("labels"))).withColumn("split", stable_split(F.col("hash"))), reasons


@dataclass
class SourceResult:
    """Outcome of one source: status is ok, empty or unavailable."""

    name: str
    status: str
    raw: int = 0
    written: int = 0
    skipped: int = 0
    columns: list[str] | None = None
    detected: dict | None = None
    license: str | None = None
    seconds: float = 0.0
    error: str | None = None
    gated: bool = False


# Words of an error that mean missing access rights.
_GATED = ("gated", "401", "403", "authentication", "access")


def load_source(name: str, kind: str, load: Callable[[], DataFrame], out: str, license: str | None = None) -> SourceResult:
    """Load, adapt and write one source in one pass; never raises.

    ``raw`` counts the source's rows, ``written`` those the adapter kept.  Both come from
    a staged table of the adapted rows, so the source itself is read once.
    """
    began = time.monotonic()
    try:
        df = load()
        rows = stage(df, "source")
        n = rows.count()
        written, _ = write_jsonl(adapt(rows, kind, name), f"{out}/{name}")
        return SourceResult(name, "ok" if written else "empty", n, written, n - written, df.columns, detect_columns(df.columns), license or "unknown", round(time.monotonic() - began, 3))
    except Exception as e:  # a source that fails is reported, the others go on
        said = f"{type(e).__name__}: {str(e)[:300]}"
        return SourceResult(name, "unavailable", seconds=round(time.monotonic() - began, 3), error=said, gated=any(w in said.lower() for w in _GATED))


def load_all(spark: SparkSession, sources: dict[str, tuple[str, Callable[[], DataFrame]]], out: str) -> tuple[list[SourceResult], str]:
    """All sources, ``metadata.json`` and the availability report in ``out``; FAIL if none is usable, WARN if some are not, else PASS."""
    results = [load_source(n, kind, load, out) for n, (kind, load) in sources.items()]
    ok = sum(r.status == "ok" for r in results)
    status = "FAIL" if not ok else "WARN" if ok < len(results) else "PASS"
    write_text(spark, f"{out}/metadata.json", json.dumps({r.name: asdict(r) for r in results}, indent=2, default=str))
    write_report(spark, out, "availability", status, {"usable": ok, "sources": len(results), "rows": sum(r.written for r in results)}, {"by_source": availability(spark, results)})
    return results, status


def availability(spark: SparkSession, results: list[SourceResult]) -> DataFrame:
    """One row a source (few): what was read and written, and why a source is missing."""
    rows = [(r.name, r.status, r.raw, r.written, r.skipped, r.license, (r.detected or {}).get("text"), (r.detected or {}).get("label"), r.gated, r.error) for r in results]
    return spark.createDataFrame(rows, "name string, status string, raw long, written long, skipped long, license string, text_column string, label_column string, gated boolean, error string")
