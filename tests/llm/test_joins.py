"""Problems 4 and 5 and the set join below them, against all pairs."""

import itertools
import random
from collections import Counter

import pytest
from fixtures import TEXTS, rows, similar, some_texts, words
from pyspark.sql import functions as F

from riskloom.llm import near_duplicates, setjoin, split_overlap


def edited(rng, n, vocabulary, lengths):
    """Distinct word sets, many of them edits of each other."""
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        for share in (0, *[rng.random() * 0.25 for _ in range(rng.randint(0, 3))]):
            other = base[:]
            for _ in range(int(len(base) * share)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            out.append(frozenset(other))
    return sorted(set(out), key=sorted)


KINDS = {
    "few words": (400, [f"w{i}" for i in range(60)], [1, 2, 3, 5, 10, 20, 30]),
    "skewed": (300, [f"w{int(2000 ** (i / 3000))}" for i in range(3000)], [10, 40, 60, 70, 130, 200]),
    "long": (60, [f"x{int(5000 ** (i / 9000))}" for i in range(9000)], [300, 900, 1500]),
}


@pytest.mark.parametrize("kind,num,den,region,sent", [("few words", 7, 10, 8, 0), ("few words", 3, 4, 40, 99), ("skewed", 7, 10, 8, 9999), ("skewed", 3, 4, 8, 0), ("long", 7, 10, 8, 0), ("long", 4, 5, 2048, 9999)])
def test_every_similar_pair_is_a_candidate(spark, kind, num, den, region, sent):
    sets = edited(random.Random(3), *KINDS[kind])
    data = [(i, 3, 1 + (i % 3 > 0), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(data, "cid long, role int, side int, words array<string>").withColumn("tokens", setjoin.tokens_of(F.col("words")))
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if similar(sets[a], sets[b], num, den)}
    got = [tuple(r) for r in setjoin.candidates(df, setjoin.Share(num, den), region, sent).collect()]
    assert len(want) > 10 and len(got) == len(set(got)) and want <= set(got) and all(a < b for a, b in got)
    two = {tuple(r) for r in setjoin.candidates(df.withColumn("role", F.col("side")), setjoin.Share(num, den), region, sent).collect()}
    assert {(a, b) if a % 3 == 0 else (b, a) for a, b in want if (a % 3 == 0) != (b % 3 == 0)} <= two
    assert all(a % 3 == 0 and b % 3 for a, b in two)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    texts = some_texts()
    df = spark.createDataFrame(rows(texts), TEXTS)
    sets = {i + 1: words(t) for i, t in enumerate(texts)}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b], 7, 10)}
    got = [tuple(r) for r in near_duplicates.pairs(df, "rec_id", region=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = Counter(x for p in want for x in p)
    linked = near_duplicates.linked(df, "rec_id", region=4).collect()
    assert {r.id: r.links for r in linked} == {i: links[i] for i, s in sets.items() if s}
    group = {r.id: r.group_id for r in linked}
    assert all(group[a] == group[b] for a, b in want)
    assert near_duplicates.pairs(df.limit(0), "rec_id").count() == 0 and near_duplicates.linked(df.limit(0), "rec_id").count() == 0


@pytest.mark.parametrize("hub", [4096, 3])
def test_components(spark, hub):
    edges = [(1, i) for i in range(2, 20)] + [(i, i + 1) for i in range(30, 60)] + [(70, 71), (19, 80)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 90)], "cid long")
    got = {r.cid: r.group for r in near_duplicates.components(nodes, spark.createDataFrame(edges, "cid_a long, cid_b long"), hub).collect()}
    assert len(got) == 89
    assert all(got[i] == 1 for i in [*range(1, 20), 80]) and all(got[i] == 30 for i in range(30, 61)) and got[71] == 70 and got[89] == 89


def test_one_class_of_a_third_and_boilerplate(spark):
    """A third of 30,000 rows is one text, and a phrase stands in all others."""
    base = spark.range(30_000).withColumn("n", F.col("id") * 7919 % 30_000)
    own = F.concat_ws(" ", *[F.concat(F.lit(f"n{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000))) for k in range(9)])
    text = F.when(F.col("id") % 3 == 0, "this one text is a third of all of the rows").otherwise(F.concat(F.lit("all rights reserved by the owner of this page "), own))
    df = base.select(F.col("id").alias("row_id"), text.alias("text"))
    got = near_duplicates.linked(df, region=256).groupBy("class_id", "links").agg(F.count(F.lit(1)).alias("n")).filter("links > 0").collect()
    assert [(r.class_id, r.links, r.n) for r in got] == [(0, 9_999, 10_000)]
    ev = df.filter("row_id < 300").select(F.col("row_id").alias("rec_id"), "text", F.lit("val").alias("split"), F.lit("s").alias("source"))
    assert split_overlap.overlaps(ev, df.filter("row_id >= 300").withColumnRenamed("row_id", "rec_id"), region=256).count() == 100 * 9_900


def test_split_overlap(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    texts = some_texts(seed=9)
    df = spark.createDataFrame(rows(texts), TEXTS)
    ev, tr = df.filter("rec_id % 3 = 0").withColumn("split", F.lit("test")), df.filter("rec_id % 3 <> 0")
    sets = {i + 1: words(t) for i, t in enumerate(texts)}
    want = {("test", min(a, b), max(a, b)) for a in sets for b in sets if a % 3 == 0 and b % 3 and similar(sets[a], sets[b], 3, 4)}
    pairs = split_overlap.overlaps(ev, tr, region=4)
    got = [tuple(r) for r in split_overlap.found(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rep = split_overlap.report(pairs, split_overlap.chunk_overlap(ev, tr)).collect()
    assert sum(r.overlapping for r in rep) == len({p for p in {a if a % 3 == 0 else b for _, a, b in want}}) and sum(r.records for r in rep) == ev.count()
    assert split_overlap.overlaps(ev.limit(0), tr).count() == 0 and split_overlap.overlaps(ev, tr.limit(0)).count() == 0


def test_chunk_overlap(spark):
    text = " ".join(f"word{i * i % 97}" for i in range(60))
    cases = [(1, text, "same"), (2, text.upper().replace(" ", ",\n"), "same"), (3, text + " and a new end of it", "most"), (4, "other words here " + text, "most"), (5, "nothing in common at all with it", "none"), (6, "one", "none"), (7, None, None), (8, "!!", None), (9, text, "same")]
    ev = spark.createDataFrame([(i, t, "val", "s") for i, t, _ in cases], "rec_id long, text string, split string, source string")
    tr = spark.createDataFrame([(100, text), (101, None), (102, "")], "rec_id long, text string")
    got = {r.id: r for r in split_overlap.chunk_overlap(ev, tr).collect()}
    for i, _, kind in cases:
        o = got[i].overlap
        assert {"same": o == 1, "none": o == 0, None: o is None, "most": o is not None and 0.7 < o < 1}[kind], (i, o)
    assert got[1].length == len(text.replace(" ", "")) and got[7].chunks == 0
    assert split_overlap.chunk_overlap(ev.limit(0), tr).count() == 0 and split_overlap.chunk_overlap(ev, tr.limit(0)).filter("overlap > 0").count() == 0
