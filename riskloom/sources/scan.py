"""Scans of raw records and head files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.balance import top_by

RECORD = "text string, labels array<string>, source string"
# Candidates for text and label columns, in order.
TEXT_KEYS = ["text", "prompt", "comment_text", "content", "sentence", "instruction", "question", "input", "message", "jailbreak_query", "goal"]
LABEL_KEYS = ["label", "binary_label", "label_binary", "labels", "is_injection", "injection", "is_malicious", "malicious", "class", "target", "type", "category", "ground_truth"]


def read_jsonl(spark: SparkSession, path: str, schema: str | None = RECORD) -> DataFrame:
    """Records of all JSONL files with ``ord``, their place by file name and line; blank and broken lines are dropped.

    Parsed as text with a fixed schema, so nothing is inferred; ``ord`` packs a dense
    file number (file names are few and broadcast) and the row index Spark keeps.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o")).withColumn("_i", F.monotonically_increasing_id())
    files = lines.select("_f").distinct()
    numbered = files.select("_f", F.expr("dense_rank() over (order by _f)").alias("_n"))  # one row a file
    got = lines.filter(F.trim("value") != "").join(F.broadcast(numbered), "_f")
    ord_ = F.struct("_n", "_o", "_i")
    rec = got.select(ord_.alias("ord"), F.from_json("value", schema).alias("r") if schema else F.parse_json("value").alias("r"))
    return rec.select("ord", "r.*") if schema else rec


def read_local(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, or JSONL with an inferred schema, by suffix."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.json(path)


def custom_paths(spark: SparkSession, pattern: str) -> list[str]:
    """CSV and JSONL files that a pattern of the file system matches, in order of name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(x for x in (str(f.getPath()) for f in found or []) if x.endswith((".csv", ".jsonl")))


def read_custom(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Sources ``custom_<stem>`` of local files, and the errors of those that cannot be read."""
    good, bad = {}, {}
    for p in sorted(paths):
        name = "custom_" + p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            good[name] = read_local(spark, p)
        except Exception as e:  # reported, the others go on
            bad[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return good, bad


def load_source(splits: dict[str, DataFrame], license: str | None = None) -> tuple[DataFrame, dict]:
    """All splits of a source as one table, and what is known of it: columns, splits, licence and detected columns."""
    df = concat_splits(list(splits.values()))
    return df, {"columns": df.columns, "splits": list(splits), "license": license or "unknown", "detected": detect_columns(df.columns)}


def concat_splits(splits: list[DataFrame]) -> DataFrame:
    """All splits of a source as one; columns may be missing in some."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits)


def detect_columns(columns: list[str], candidates: dict[str, list[str]] | None = None) -> dict[str, str | None]:
    """The first candidate present for text and label."""
    c = candidates or {"text": TEXT_KEYS, "label": LABEL_KEYS}
    return {k: next((x for x in v if x in columns), None) for k, v in c.items()}


def detect_key(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate among the columns, whatever their case."""
    lower = {c.lower(): c for c in columns}
    return next((lower[x] for x in candidates if x in lower), None)


def quota_scan(df: DataFrame, text: str, group: Column, quota: int, order: Column, shortest: int = 8, longest: int = 2000) -> DataFrame:
    """At most ``quota`` rows of each group among texts of the given lengths."""
    n = F.length(F.trim(F.col(text)))
    return top_by(df.filter(n.between(shortest, longest)).withColumn("_g", group), ["_g"], [order], quota).drop("_g")


def read_head_lines(spark: SparkSession, path: str) -> DataFrame:
    """Head lines (value) of text files; a line ends at a line feed only, carriage returns belong to the text."""
    return spark.read.text(path, lineSep="\n")


def parse_head_lines(lines: DataFrame) -> DataFrame:
    """(text, labels) of head lines (value): leading ``__label__`` words are labels, [unknown] without any; equal texts are united."""
    w = F.filter(F.split(collapse(F.col("value")), " "), lambda x: x != "")
    isl = lambda x: F.startswith(x, F.lit("__label__"))
    first = F.array_position(F.transform(w, lambda x: ~isl(x)), True)  # 1-based place of the first word of the text
    n = F.when(first == 0, F.size(w)).otherwise(first - 1).cast("int")
    labels = F.transform(F.slice(w, 1, n), lambda x: F.substring(x, 10, 1 << 20))
    text = F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(1))), " ")
    one = lines.filter(F.trim("value") != "").select(F.when(n >= F.size(w), F.lit("")).otherwise(text).alias("text"), F.when(n == 0, F.array(F.lit("unknown"))).otherwise(labels).alias("labels"))
    entries = one.select("text", F.explode("labels").alias("label")).distinct()
    return entries.groupBy("text").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # labels of a vocabulary


def count_labels(lines: DataFrame) -> DataFrame:
    """(label, n): leading labels over head lines."""
    got = F.regexp_extract_all(F.regexp_extract("value", r"^((?:__label__\S+\s*)+)", 1), F.lit(r"__label__(\S+)"), F.lit(1))
    return lines.select(F.explode(got).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
