"""Problem 5: records of evaluation splits that occur, the same or nearly, in training.

Two results.

``chunk_overlap`` is the method named: the normalised record (its words in text
order, lower-cased) is cut where a hash over a sliding window of WINDOW words says so,
one cut in AVERAGE words, so that an edit moves only the cuts around it; the digests
of the chunks are joined across the splits, and the lengths of the shared chunks add
up to the fraction of each record that stands in training.  Digests are made distinct
before they meet, so a boilerplate chunk is one row on either side.

``overlaps`` lists the pairs of records with a word share of at least 3/4, and does
not use those chunks: no cut rule gives every such pair a common chunk, since the word
share ignores order and a quarter of the words may differ, and chunks of common
phrases would need quadratically many candidates (figures in the README).  It is the
exact word-set join of ``setjoin`` between the splits, verified on the words.
Records with one word set are one class on either side; found pairs of classes are
given their members at the end, large classes in blocks.

Defined results: null text and text without letter or digit match nothing and have
no chunks (fraction null); other columns are ignored; an empty table gives an empty
result; repeated rows are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_checked
from ..plans.staging import stage
from .common import WORD, word_list
from .setjoin import LEFT, REGION, RIGHT, Share, candidates, expanded, tokens_of, verified, with_rows
from .source_mixing import source_name

CLASS = ["role", "h1", "h2"]
#: Words in the sliding window of the cut rule, and words in a chunk on average.
WINDOW = 2
AVERAGE = 4


def overlaps(evaluation: DataFrame, training: DataFrame, id_col: str = "rec_id", text_col: str = "text", num: int = 3, den: int = 4, region: int = REGION) -> DataFrame:
    """(split, source, id, train_id, common, either) of every pair of word share >= num / den.

    ``evaluation`` has a column ``split``; ``source`` is that of the evaluation
    record.  Ids are unique on either side.
    """
    src = F.col("source") if "source" in evaluation.columns else F.lit(None).cast("string")
    e = evaluation.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "split", src.alias("source"), F.lit(LEFT).alias("role"))
    t = training.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit("train").alias("split"), F.lit(None).cast("string").alias("source"), F.lit(RIGHT).alias("role"))
    every = e.unionByName(t)
    recs = every.filter(F.col("text").rlike(WORD)).withColumn("tokens", tokens_of(word_list("text")))
    recs = recs.select("split", "source", "id", "role", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), "tokens")
    recs = stage(recs, "p5-records")
    copies = stage(recs.groupBy(*CLASS).agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "p5-copies")
    heads = join_checked(recs, copies, CLASS, "rows", how="left").filter("cid is null or cid = id").select(F.col("id").alias("cid"), "role", "tokens")
    share = Share(num, den)
    met = stage(candidates(heads, share, region), "p5-met")
    ok = stage(verified(met, every.select(F.col("id").alias("cid"), "role", "text"), share, two=True), "p5-similar")
    ok = stage(with_rows(ok, copies, two=True), "p5-pairs")

    own = join_checked(recs.drop("tokens"), copies, CLASS, "rows", how="left")
    own = own.select("split", "source", "id", "role", F.coalesce("cid", "id").alias("cid"), F.coalesce("rows", F.lit(1)).alias("rows"))
    ends = ok.select(F.lit(LEFT).alias("role"), F.col("cid_l").alias("cid"), F.col("rows_l").alias("of")).unionByName(ok.select(F.lit(RIGHT).alias("role"), F.col("cid_r").alias("cid"), F.col("rows_r").alias("of")))
    members = stage(join_checked(own, stage(ends.distinct(), "p5-classes"), ["role", "cid"], "of").drop("of"), "p5-members")
    l = members.filter(F.col("role") == LEFT).select(F.col("cid").alias("cid_l"), F.col("rows").alias("rows_l"), F.col("id").alias("id_l"), "split", "source")
    r = members.filter(F.col("role") == RIGHT).select(F.col("cid").alias("cid_r"), F.col("rows").alias("rows_r"), F.col("id").alias("id_r"))
    return expanded(ok, l, r).select("split", "source", F.col("id_l").alias("id"), F.col("id_r").alias("train_id"), "common", "either")


def found(pairs: DataFrame) -> DataFrame:
    """(split, rec_id_a, rec_id_b), the smaller id first."""
    return pairs.select("split", F.least("id", "train_id").alias("rec_id_a"), F.greatest("id", "train_id").alias("rec_id_b"))


def chunks(text: str | Column, window: int = WINDOW, average: int = AVERAGE) -> Column:
    """array<struct<digest, length>>: the content-defined chunks of a text; null without words.

    A chunk ends after the word at which the hash over the last ``window`` words is
    a multiple of ``average``, and at the end of the text; length is in characters
    of the words.
    """
    col = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))

    def cut(of: Column) -> Column:
        hashed = lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(of, i - window + 1, window), " ")), 1, 8), 16, 10).cast("long")
        ends = F.filter(F.sequence(F.lit(window), F.size(of)), lambda i: (hashed(i) % average == 0) & (i < F.size(of)))
        ends = F.concat(F.when(F.size(of) >= window, ends).otherwise(F.array().cast("array<int>")), F.array(F.size(of)))
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        joined = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(of, a + 1, b - a), " "))
        return F.transform(joined, lambda c: F.struct(F.md5(c).alias("digest"), F.length(F.replace(c, F.lit(" "), F.lit(""))).cast("long").alias("length")))

    one = F.transform(F.array(words), cut)  # the words are extracted once
    return F.when(F.size(words) > 0, F.get(one, F.lit(0)))


def chunk_overlap(evaluation: DataFrame, training: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> DataFrame:
    """(id, split, source, chunks, shared, length, shared_length, overlap): how much of each evaluation record stands in training."""
    e = evaluation.select(F.col(id_col).alias("id"), "split", "source", chunks(text_col).alias("cs")).withColumn("c", F.explode_outer("cs"))
    e = stage(e.select("id", "split", "source", "c.digest", "c.length"), "p5-chunks")
    there = training.select(F.explode(chunks(text_col)).alias("c")).select("c.digest").distinct()
    shared = stage(e.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(there, "digest", "left_semi"), "p5-shared")
    hit = join_checked(e, shared, ["digest"], "n", how="left")
    per = hit.groupBy("id", "split", "source").agg(
        F.count("digest").alias("chunks"), F.count("n").alias("shared"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("length"))), F.lit(0)).alias("shared_length")
    )
    return per.withColumn("overlap", F.col("shared_length") / F.nullif("length", F.lit(0)))


def report(pairs: DataFrame, overlap: DataFrame) -> DataFrame:
    """Of each split and source: records, those with a partner in training and with its very words, and the share of their text that stands in training."""
    hit = pairs.groupBy("split", "id").agg(F.max((F.col("common") == F.col("either")).cast("int")).alias("_same"), F.first("source").alias("source"))
    hits = hit.groupBy("split", source_name().alias("source")).agg(F.count(F.lit(1)).alias("overlapping"), F.sum("_same").alias("same_words"))
    every = overlap.groupBy("split", source_name().alias("source")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(4 * F.col("shared_length") >= 3 * F.nullif("length", F.lit(0))).alias("mostly_shared"), F.sum("length").alias("_len"), F.sum("shared_length").alias("_shared")
    )
    j = every.alias("a").join(hits.alias("b"), (F.col("a.split") == F.col("b.split")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("a.split", "a.source", "records", zero("overlapping"), zero("same_words"), "mostly_shared", (F.col("_shared") / F.nullif("_len", F.lit(0))).alias("text_share"))
