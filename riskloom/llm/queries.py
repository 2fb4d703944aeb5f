"""The registered queries of this package: each maps (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, format_duplicates, lookalikes, near_duplicates, packing, source_mixing, split_overlap, subjects, target_sampling
from ..plans.staging import stage
from .common import table


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return target_sampling.sample(table(spark, d, "all_test"), table(spark, d, "label_aliases"), table(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return target_sampling.report(*_p1(spark, d)).filter("short > 0").select("request_id", "label")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return target_sampling.report(*_p1(spark, d))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the sample itself holds: rows, different rows and rows of another category for each request and label."""
    drawn, _ = _p1(spark, d)
    own = target_sampling.categories(table(spark, d, "all_test"), table(spark, d, "label_aliases")).withColumnRenamed("label", "own")
    j = drawn.join(own, "rec_id")
    return j.groupBy(F.col("request_id").cast("int").alias("request_id"), "label").agg(F.count(F.lit(1)).alias("drawn"), F.countDistinct("rec_id").alias("different"), F.count_if(F.col("own") != F.col("label")).alias("wrong"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[0].select(F.col("request_id").cast("int").alias("request_id"), "rec_id", "label", "how")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(table(spark, d, "all_test"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapsed(table(spark, d, "all_test"))


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return source_mixing.mix(table(spark, d, "all_test"), table(spark, d, "mix_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.report(*_p3(spark, d)).filter("reached < wanted").select("mix_id", "source")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.report(*_p3(spark, d))


def _p3_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mixes again with shares of tokens instead of rows."""
    rows = table(spark, d, "all_test").select("rec_id", "text", "source", "labels")
    sizes = stage(encoding.encode(rows, "rec_id", lengths_only=True), "p3-tokens")
    sized = stage(rows.drop("text").join(sizes, "rec_id"), "p3-sized")
    return source_mixing.mix(sized, table(spark, d, "mix_targets"), size=F.col("tokens"))


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.report(*_p3_tokens(spark, d))


def p3_draws(spark: SparkSession, d: str) -> DataFrame:
    """What the mix itself holds: rows, draws, most draws of a row and rows of another source for each target."""
    drawn, _ = _p3(spark, d)
    own = table(spark, d, "all_test").select("rec_id", source_mixing.source_name().alias("own"))
    j = drawn.join(own, "rec_id")
    return j.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("rec_id").alias("different"), F.sum("times").alias("draws"), (F.max("times") - F.min("times")).alias("uneven"), F.count_if(F.col("own") != F.col("source")).alias("wrong"))


def p3_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d)[0].drop("size")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, d, "test")).select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.linked(table(spark, d, "test")).withColumnRenamed("id", "row_id")


def _p5_eval(spark: SparkSession, d: str) -> DataFrame:
    val = table(spark, d, "all_val").select("rec_id", "text", "source", F.lit("val").alias("split"))
    return val.unionByName(table(spark, d, "all_test").select("rec_id", "text", "source", F.lit("test").alias("split")))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(_p5_eval(spark, d), table(spark, d, "all_train"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(_p5(spark, d))


def p5_overlap(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.chunk_overlap(_p5_eval(spark, d), table(spark, d, "all_train")).drop("source").withColumnRenamed("id", "rec_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    overlap = split_overlap.chunk_overlap(_p5_eval(spark, d), table(spark, d, "all_train"))
    return split_overlap.report(_p5(spark, d), overlap)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = lookalikes.pairs(table(spark, d, "normalized_text"), ["original_text", "detection_text"])
    return got.select("field", F.col("id_a").alias("norm_id_a"), F.col("id_b").alias("norm_id_b"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical(table(spark, d, "normalized_text"), ["original_text", "detection_text"]).withColumnRenamed("id", "norm_id")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every value as its least id: does not depend on which member is canonical."""
    c = p6_canonical(spark, d)
    least = c.groupBy("field", "canonical").agg(F.min("norm_id").alias("least_id"))
    return c.join(least, ["field", "canonical"]).select("field", "norm_id", "least_id", "members")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def _p8(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    specs = table(spark, d, "pack_specs")
    sizes = stage(encoding.encode(table(spark, d, "documents"), lengths_only=True), "p8-tokens")
    few = [(r["spec_id"], r["capacity_tokens"]) for r in specs.orderBy("spec_id").collect()]  # a fixed table of a few rows
    return packing.pack_all(sizes, few), specs, sizes


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    packed, specs, _ = _p8(spark, d)
    return packing.report(packed, specs)


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    packed, specs, sizes = _p8(spark, d)
    return packing.faults(stage(packed, "p8-packed"), sizes, specs)


def _p9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rules = subjects.fit(docs, table(spark, d, "subject_examples"), table(spark, d, "subject_areas"))
    return subjects.assign(docs, rules)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_p9(spark, d), table(spark, d, "documents"), table(spark, d, "subject_areas"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = [p1_found, p1_report, p1_counts, p1_sample, p2_found, p2_records, p3_found, p3_report, p3_draws, p3_tokens, p3_mix, p4_found, p4_groups, p5_found, p5_overlap, p5_report]
    fs += [p6_found, p6_canonical, p6_classes, p7_ids, p8_containers, p8_report, p8_faults, p9_found, p9_composition]
    return {f.__name__: f for f in fs}
