"""Small pieces shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of letters and digits (Unicode L and N).
WORD = r"[\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: str | Column) -> Column:
    """The distinct words of the lower-cased text; null text gives null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)))


def strip_all(col: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
