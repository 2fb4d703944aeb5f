"""spark-submit entry: classify texts and print JSON lines."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators.heads import load_heads
    from .plans.classify import classify, classify_with_heads, stand_ins

    ap = argparse.ArgumentParser(description="Classify texts")
    ap.add_argument("text", nargs="*")
    ap.add_argument("--input", help="Parquet table with a column text")
    ap.add_argument("--output", help="folder for the results as JSON")
    ap.add_argument("--heads", help="folder of trained heads (operators.heads.save_heads); without it hash stand-ins score")
    ap.add_argument("--full-scan", action="store_true")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    df = spark.read.parquet(a.input) if a.input else spark.createDataFrame([(t,) for t in a.text], "text string")
    heads, models = stand_ins()
    if a.heads:
        out = classify_with_heads(df, load_heads(spark, a.heads), models, full_scan=a.full_scan)
    else:
        out = classify(df, heads, models, full_scan=a.full_scan)
    if a.output:
        out.write.mode("overwrite").json(a.output)
    else:
        for line in out.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
