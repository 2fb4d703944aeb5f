"""Brute-force comparisons and edge cases of the nine operators on small fixtures."""

import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from fixtures import TEXTS, rows, similar, some_texts, words
from pyspark.sql import functions as F

from riskloom.llm import encoding, format_duplicates, lookalikes, packing, source_mixing, subjects, target_sampling
from riskloom.llm.lexicon import Lexicon, build


# problem 1 -------------------------------------------------------------------


ALIASES = [("safe", "safe"), ("fine", "safe"), ("hate", "hate"), ("tox", "toxicity")]


def test_target_sampling(spark):
    labels = [["safe"]] * 300 + [[" FINE "]] * 100 + [["hate"]] * 7 + [["tox", "hate"]] * 60 + [None] * 5 + [[]] * 5 + [[None]] * 5 + [["odd"]] * 5
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(labels)], "rec_id long, labels array<string>, label string")
    aliases = spark.createDataFrame(ALIASES, "alias string, label string")
    targets = spark.createDataFrame([(1, 10, "safe", 50, 3), (1, 10, "hate", 40, 3), (1, 10, "toxicity", 10, 9), (1, 10, "unknown", 0, 25), (2, 50, "safe", 100, 1)], "request_id int, sample_pct int, label string, target_pct int, min_rows int")
    drawn, plan = target_sampling.sample(df, aliases, targets)
    got = drawn.collect()
    assert len({(r.request_id, r.rec_id) for r in got}) == len(got)
    rep = {(r.request_id, r.label): r for r in target_sampling.report(drawn, plan).collect()}
    n = len(labels)
    for (req, pct, lab, share, least), available in zip([r for r in targets.collect()], [400, 7, 60, 20, 400]):
        want = max(least, -(-share * (n * pct // 100) // 100))
        r = rep[(req, lab)]
        assert (r.available, r.wanted, r.drawn, r.short) == (available, want, min(want, available), max(0, want - available))
    assert any(r.how == "systematic" for r in got) and any(r.how == "repair" for r in got)


def test_target_sampling_empty(spark):
    aliases = spark.createDataFrame(ALIASES, "alias string, label string")
    targets = spark.createDataFrame([(1, 10, "safe", 50, 3)], "request_id int, sample_pct int, label string, target_pct int, min_rows int")
    drawn, plan = target_sampling.sample(spark.createDataFrame([], "rec_id long, labels array<string>"), aliases, targets)
    assert drawn.count() == 0 and target_sampling.report(drawn, plan).first().short == 3


# problem 2 -------------------------------------------------------------------


SAME = [
    ["Hello, World 7!", "hello world7", "HELLO  WORLD\n7"],
    ['{"topic": "Big cat", "tone": "dry"}', "tone: DRY | topic: big cat!", "topic = big, cat\ntone = dry", "tone: dry; topic: big cat", "topic big cat tone dry"],
    ["topic: big cat | tone: dry | tone: dry"],
    ['{"a": {"x": 1, "y": [1, 2]}, "b": null}', '{"b": null, "a": {"y": [1, 2], "x": 1}}'],
    ['{"a": {"x": 1, "y": [2, 1]}, "b": null}'],
    ['{"broken": '],
    ['{"price": 1.50, "item": "pen"}', "price: 1.50 | item: pen", "item = PEN\nprice = 1.50"],
    ['{"price": 1.5, "item": "pen"}', "price: 1.5 | item: pen"],
    ['{"n": 1e5, "k": 123456789012345678901234567890}', "n: 1e5; k: 123456789012345678901234567890"],
    ["n: 100000; k: 123456789012345678901234567890"],
    ['{"n": NaN, "ok": true, "no": null}', "n: NaN | ok: TRUE | no: null"],
]


def test_format_duplicates(spark):
    texts = [t for g in SAME for t in g] + [None, "", "***", SAME[0][0], "x" * 200_000, "X" * 200_000]
    group = [i for i, g in enumerate(SAME) for _ in g] + [None, None, None, 0, 99, 99]
    got = {(r.first_id, r.copy_id) for r in format_duplicates.copies(spark.createDataFrame(rows(texts), TEXTS)).collect()}
    by = defaultdict(list)
    for i, g in enumerate(group):
        if g is not None:
            by[g].append(i + 1)
    assert got == {(min(v), x) for v in by.values() for x in v if x != min(v)}
    collapsed = {(r.first_id, r.copies) for r in format_duplicates.collapsed(spark.createDataFrame(rows(texts), TEXTS)).collect()}
    assert collapsed == {(min(v), len(v)) for v in by.values()}


def test_format_duplicates_with_colliding_digests(spark, monkeypatch):
    monkeypatch.setattr(format_duplicates, "_digest", lambda kind, parts: b"0" * 16)
    texts = ["a: 1 | b: 2", "b: 2; a: 1", "a: 3 | b: 4", '{"b": 4, "a": 3}', "a: 5 | b: 6", "plain"]
    got = {tuple(r) for r in format_duplicates.copies(spark.createDataFrame(rows(texts), TEXTS)).collect()}
    assert got == {(1, 2), (3, 4)}


def test_format_duplicates_hot_and_empty(spark):
    texts = ["Same  text."] * 3000 + ["same, TEXT"] * 3 + [f"other {i}" for i in range(50)]
    got = format_duplicates.copies(spark.createDataFrame(rows(texts), TEXTS))
    assert got.count() == 3002 and got.select("first_id").distinct().count() == 1
    assert format_duplicates.copies(spark.createDataFrame([], TEXTS)).count() == 0


# problem 3 -------------------------------------------------------------------


def test_source_mixing(spark):
    data = [(i, "A ::fold" if i % 3 else " a", ["safe"]) for i in range(1000)] + [(2000 + i, "b", ["x"]) for i in range(20)] + [(3000, None, ["x"]), (3001, "b", None), (3002, "b", [])]
    data = [(i, s.replace(" ::", "::") if s else s, x) for i, s, x in data]
    df = spark.createDataFrame(data, "rec_id long, source string, labels array<string>").withColumn("_passes", F.lit(1)).withColumn("held", F.lit("clash"))
    targets = spark.createDataFrame([(1, 100, "a", 30, 2), (1, 100, "b", 10, 3), (1, 100, "none", 60, 4), (2, 200, "a", 90, 1)], "mix_id int, mix_pct int, source string, target_pct int, max_repeats int")
    drawn, plan = source_mixing.mix(df, targets)
    n = len(data)
    rep = {(r.mix_id, r.source): r for r in source_mixing.report(drawn, plan).collect()}
    for m, pct, s, share, most in [tuple(r) for r in targets.collect()]:
        held = {"a": 1000, "b": 20}.get(s, 0)
        want = -(-share * (n * pct // 100) // 100)
        assert (rep[(m, s)].wanted, rep[(m, s)].reached) == (want, min(want, held * most))
        assert rep[(m, s)].most_repeats <= most
    small = {r.rec_id for r in drawn.filter("mix_id = 1 and source = 'a'").collect()}
    large = {r.rec_id for r in drawn.filter("mix_id = 2 and source = 'a'").collect()}
    assert small <= large  # thresholds are nested
    drawn, plan = source_mixing.mix(df.limit(0), targets)
    assert drawn.count() == 0 and source_mixing.report(drawn, plan).agg(F.sum("reached")).first()[0] == 0


def test_source_mixing_by_size(spark):
    df = spark.createDataFrame([(i, "a", ["x"], i % 7) for i in range(500)], "rec_id long, source string, labels array<string>, size int")
    targets = spark.createDataFrame([(1, 50, "a", 40, 1)], "mix_id int, mix_pct int, source string, target_pct int, max_repeats int")
    r = source_mixing.report(*source_mixing.mix(df, targets, size=F.col("size"))).first()
    assert r.wanted <= r.reached < r.wanted + 7


# problems 4 and 5 ------------------------------------------------------------


# problem 6 -------------------------------------------------------------------


def test_lookalikes(spark):
    same = [["Café ﬁn", "Café fin", "Ｃａｆé fin", "Саfé​ fin", "Ca­fé　fin"], ["cafe fin"], ["CAFÉ FIN"], ["café fin"], ["", "​﻿"], ["a  b"], ["a b", "а Ь".replace("Ь", "b")], ["привет"], ["x" * 100_000, "х" * 100_000]]
    values = [v for g in same for v in g] + [None, "Café ﬁn"]
    group = [i for i, g in enumerate(same) for _ in g] + [None, 0]
    df = spark.createDataFrame([(i + 1, v, None, "clash") for i, v in enumerate(values)], "norm_id long, original_text string, detection_text string, look string")
    want = {("original_text", a + 1, b + 1) for a, b in itertools.combinations(range(len(values)), 2) if group[a] is not None and group[a] == group[b] and values[a] != values[b]}
    assert {tuple(r) for r in lookalikes.pairs(df, ["original_text", "detection_text"], block=3).collect()} == want
    form = {r.id: r.canonical for r in lookalikes.canonical(df, ["original_text"]).collect()}
    assert len(form) == len(values) - 1
    assert all((form[a + 1] == form[b + 1]) == (group[a] == group[b]) for a, b in itertools.combinations([i for i, g in enumerate(group) if g is not None], 2))
    assert lookalikes.pairs(df.limit(0), ["original_text"]).count() == 0


# problem 7 -------------------------------------------------------------------


def test_lexicon(tmp_path):
    entries = {b"": [9], b"a": [1], b"ab": [2, 3], b"abc": [], b"xbc": [4], b"\xff\x00": [5] * 40}
    path = tmp_path / "lexicon"
    path.write_bytes(build(sorted(entries.items())))
    lex = Lexicon(str(path))
    assert {w: lex.get(w) for w in entries} == entries and len(lex) == len(entries)
    assert lex.get(b"b") is None and lex.get(b"abcd") is None and lex.get(b"x") is None
    assert lex.nodes < sum(len(w) + 1 for w in entries)  # suffixes are shared
    path.write_bytes(build([]))
    assert Lexicon(str(path)).get(b"a") is None


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    texts = [None, "", " ", "Hello there", "Hello there", "naïve 漢字 ​\n\n  x\t", "<|endoftext|> it's", "é" * 700, "ab" * 5000, "a b  c   d", "\x00\x01", "🙂🙂🏽"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode(df, words=3).collect()}
    assert got == {i: ref.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.tokens for r in encoding.encode(df, lengths_only=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert encoding.encode(df.limit(0)).count() == 0


# problem 8 -------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [10, 100, 512])
def test_packing(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(capacity)
    sizes = [None, 0, 0, 1, capacity, capacity + 1, 3 * capacity, 7 * capacity + 3] + [min(rng.randint(1, 60) ** 2 // 9 + 1, 1500) for _ in range(400)]
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)], "doc_id long, tokens int, size string")
    got = packing.pack(df, capacity).collect()
    assert len({(r.id, r.part) for r in got}) == len(got)
    held, parts = Counter(), defaultdict(list)
    for r in got:
        held[r.container] += r.size
        parts[r.id].append(r.size)
    assert max(held.values()) <= capacity
    assert {i: sum(v) for i, v in parts.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    assert all(len(v) == 1 for i, v in parts.items() if (sizes[i] or 0) <= capacity)
    assert len(held) <= 1.1 * sum(s or 0 for s in sizes) / capacity + 12
    assert packing.pack(df.limit(0), capacity).count() == 0


# problem 9 -------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(2)
    terms = {"law": ["court", "judge", "plaintiff", "verdict"], "music": ["violin", "octave", "chorus", "tempo"]}
    docs, gold = [], {}
    for i in range(240):
        mine = rng.choice([["law"], ["music"], ["law", "music"], []])
        ss = [f"The {rng.choice(terms[s])} of N{rng.randint(0, 999)}x moved a {rng.choice(terms[s])} today." for s in mine for _ in range(2)] + [f"My cousin stacked {rng.choice(['boxes', 'lamps', 'chairs'])} slowly there."] * 2
        rng.shuffle(ss)
        docs.append((i, " ".join(ss), "clash"))
        gold[i] = set(mine)
    docs += [(1000, None, ""), (1001, "", ""), (1002, "Hm.", ""), (1003, "plaintiff " * 20_000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    examples = spark.createDataFrame([(i, " LAW" if s == "law" else s) for i in range(160) for s in sorted(gold[i])] + [(5, "nonsense"), (None, "law"), (7, None)], "doc_id long, subject string")
    areas = spark.createDataFrame([("law", ""), ("music", "")], "subject string, note string")
    rules = subjects.fit(df, examples, areas)
    got = defaultdict(set)
    for r in subjects.assign(df, rules).collect():
        got[r.doc_id].add(r.subject)
    held_out = range(160, 240)
    assert sum(got[i] == gold[i] for i in held_out) >= 0.95 * len(held_out)
    assert not got[1000] | got[1001] | got[1002]
    shares = {r.subject: r for r in subjects.composition(subjects.assign(df, rules), df, areas).collect()}
    assert shares["law"].documents == sum("law" in s for s in got.values())
    none = subjects.fit(df, examples.limit(0), areas)
    assert subjects.assign(df, none).count() == 0
    assert subjects.assign(df.limit(0), rules).count() == 0


def test_sentences():
    assert subjects.sentences("1. The court met today.\n2. Hm. \"Next comes this,\" they said here! Last one goes here") == [["the", "court", "met", "today"], ["next", "comes", "this", "they", "said", "here"], ["last", "one", "goes", "here"]]
    assert subjects.sentences(None) == subjects.sentences("") == []


def test_json_fields():
    assert format_duplicates.fields('{"a": 1, "a": 2}') is not None
    assert format_duplicates.fields('{"a": 1}') is None and format_duplicates.fields("plain: one") is None
    assert format_duplicates.fields("a: 1; more\nb = 2") == [("a", " 1 more"), ("b", " 2")]
    deep = "[" * 5000
    assert format_duplicates.fields('{"a": ' + deep) is None
    assert json.loads('{"x": 1}') == {"x": 1}
