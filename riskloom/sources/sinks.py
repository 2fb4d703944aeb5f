"""Sinks: processed splits, head files, reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import coarse_labels, literal_list
from ..functions.text import collapse, strip
from ..plans.staging import stage


def write_jsonl(df: DataFrame, path: str, text: str = "text") -> tuple[int, int]:
    """Write the rows with text as JSON lines; (written, skipped).

    The plan runs once, into a staged table; rows are counted there, from one column.
    """
    staged = stage(df.withColumn("_blank", strip(F.coalesce(F.col(text), F.lit(""))) == ""), "sink")
    n = staged.groupBy("_blank").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows, from the column of flags alone
    staged.filter("not _blank").drop("_blank").write.mode("overwrite").json(path)
    by = {r["_blank"]: r["n"] for r in n}
    return by.get(False, 0), by.get(True, 0)


def write_splits(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy("split").format(kind).save(path)


def head_line(labels, text):
    """``__label__a __label__b text`` on one line."""
    return F.concat_ws(" ", F.array_join(F.transform(labels, lambda x: F.concat(F.lit("__label__"), x)), " "), F.trim(F.replace(text, F.lit("\n"), F.lit(" "))))


def merged_head_line(labels, text):
    """A line of the merged head: white space collapsed, no label is safe."""
    coarse = coarse_labels(labels)
    return head_line(F.when(F.size(coarse) > 0, coarse).otherwise(literal_list(["safe"])), collapse(text))


def write_head_lines(df: DataFrame, path: str) -> None:
    """Text files of (head, split, value) in folders by head and split."""
    df.select("head", "split", "value").write.mode("overwrite").partitionBy("head", "split").text(path)


def write_report(spark: SparkSession, path: str, name: str, status: str, payload: dict, sections: dict[str, DataFrame] | None = None, most: int = 200) -> dict:
    """JSON and Markdown files of a report; sections are small result tables, at most ``most`` rows each."""
    doc = {"name": name, "status": status, "created": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()), **payload}
    md = [f"# {name}", "", f"Status: {status}", ""]
    for title, df in (sections or {}).items():
        rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
        doc[title] = rows
        md += [f"## {title}", "", markdown_table(df.columns, [[r[c] for c in df.columns] for r in rows]), ""]
    for suffix, body in (("json", json.dumps(doc, indent=2, default=str, ensure_ascii=False)), ("md", "\n".join(md))):
        write_text(spark, f"{path}/{name}.{suffix}", body)
    return doc


def load_report(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{name}.json", wholetext=True).collect()))


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One small file, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(body.encode()))
    out.close()


def markdown_table(headers: list, rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(headers), "|" + "---|" * len(headers), *map(line, rows)])


def text_table(headers: list, rows: list[list]) -> str:
    cells = [[str(c) for c in r] for r in [headers, *rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)) for r in cells)


def human_size(n: float | None) -> str:
    if n is None:
        return "n/a"
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.1f}{unit}"
        n /= 1024
    return f"{n:.1f}GB"


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder; 0 if there is nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
