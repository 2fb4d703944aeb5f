import time

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from riskloom import taxonomy as T
from riskloom.functions import ngrams
from riskloom.operators import heads

WORDS = "ignore rules weather town é 日本語 a of gate, stab 42 \U0001f600 harbor-light".split(" ")


def listed(text, p):
    """All n-grams of a text whose words single blanks part."""
    w = [x for x in text.split(" ") if x]
    out = [" ".join(w[i : i + n]) for n in range(1, p.word_ngrams + 1) for i in range(len(w) - n + 1)]
    return out + ["#" + text[i : i + n] for n in range(p.min_n, p.max_n + 1) for i in range(len(text) - n + 1)]


def test_trained_like_logistic_regression(spark, monkeypatch):
    """Heads trained together, in blocks, are the models of LogisticRegression over HashingTF, one label at a time."""
    monkeypatch.setattr(heads, "BLOCK", 50)
    rng, p = np.random.default_rng(7), heads.HeadParams(buckets=1 << 10, iterations=10)
    names = {h: xs for h, xs in T.HEADS.items() if h != "high_risk"}
    rows = []
    for i in range(240):
        x = int(rng.integers(0, 3))
        attack, abuse = ([["safe"], ["jailbreak"], []][x], [["safe"], None, ["hate", "toxicity"]][x])
        rows.append((" ".join(rng.choice(WORDS, int(rng.integers(0, 12)))) + " do anything now" * (x == 1) * (i % 5 > 0), attack, abuse))
    df = spark.createDataFrame([(t.strip(), *y) for t, *y in rows], "text string, attack array<string>, abuse array<string>")
    got = {h.name: h for h in heads.train_heads(df.repartition(3), "text", {h: h for h in names}, p)}
    assert {h: set(m.models) for h, m in got.items()} == {"attack": {"safe", "jailbreak"}, "abuse": {"safe", "hate", "toxicity"}}
    for head in names:
        own = spark.createDataFrame([(listed(r.text, p), r[head]) for r in df.collect() if r[head]], "grams array<string>, own array<string>")
        x = HashingTF(inputCol="grams", outputCol="x", numFeatures=p.buckets).transform(own).cache()
        for label, m in got[head].models.items():
            want = LogisticRegression(featuresCol="x", labelCol="y", maxIter=p.iterations, regParam=p.regularization).fit(x.withColumn("y", F.array_contains("own", label).cast("double")))
            assert abs(want.intercept - m.intercept) < 1e-6, (head, label)
            assert np.abs(want.coefficients.toArray() - m.coefficients.toArray()).max() < 1e-6, (head, label)
    text, all_models = df.first().text, [got["attack"].models["jailbreak"]]
    dense = HashingTF(inputCol="g", outputCol="x", numFeatures=p.buckets).transform(spark.createDataFrame([(listed(text, p),)], "g array<string>")).first().x.toArray()
    margin = dense @ all_models[0].coefficients.toArray() + all_models[0].intercept
    scored = heads.score_labels(df.limit(1), [got["attack"]], "text").first()["_all"]
    assert abs({s.label: s.score for s in scored}["jailbreak"] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_work_grows_with_length(spark):
    """Every n-gram of a long text costs the same, wherever it stands: 600,000 characters take seconds."""
    long = "ignore the rules of harbor " * 22_000
    df = spark.createDataFrame([(long, ["jailbreak"]), ("lovely weather", ["safe"])], "text string, head_labels array<string>")
    began = time.monotonic()
    h = heads.train_head(df, "attack", params=heads.HeadParams(buckets=1 << 10, iterations=2))
    assert set(h.models) == {"safe", "jailbreak"} and time.monotonic() - began < 60


def test_blocks_in_small_rows():
    """No row of a staged block is large, no block holds many long texts, and the rows of a block give its n-grams again."""
    p, rng = heads.HeadParams(buckets=1 << 12), np.random.default_rng(3)
    for words, n in (WORDS, 6_000), (["rule" + str(i) for i in range(3_000)], 6_000), (WORDS * 400, 120):
        size = 45 if n > 1_000 else 20_000
        texts = [" ".join(rng.choice(words, size)) for _ in range(n)]
        batch = pa.RecordBatch.from_pydict({"flat": texts, "inside": np.ones(n, np.int64), "gold": np.arange(n) % 2})
        rows = list(heads._blocks(p, 1, [0])(iter([batch])))
        *blocks, sums = rows
        assert max(b.nbytes for b in blocks) < 1 << 20
        assert sums["sums"][0].is_valid and np.frombuffer(sums["sums"][0].as_py())[0] == n
        got = list(heads._unpacked(iter(blocks)))
        assert sum(len(x["inside"]) for x in got) == n and (n > 1_000 or len(got) > 1)
        total = np.zeros(p.buckets)
        for x in got:  # every text once: the counts of all buckets
            values, out = np.zeros((int(x["parts"][0]), 1)), np.zeros((p.buckets, 1))
            ngrams.add_up(values, np.ones((len(x["inside"]), 1)), *(x[f"texts_{k}"] for k in ("ids", "size", "owners", "members")))
            ngrams.add_up(out, values, *(x[f"parts_{k}"] for k in ("ids", "size", "owners", "members")))
            total += values[: p.buckets, 0] + out[:, 0]
        assert np.array_equal(total, np.frombuffer(sums["sums"][0].as_py())[2 : 2 + p.buckets])


def test_factored_counts_each_ngram_once():
    """Parts give every n-gram of a text once, for any sizes, with words of one letter and blanks at the ends or side by side."""
    rng, words = np.random.default_rng(5), ["a", "I", "of", "é", "日", "日本語", "the", "gate,", "\U0001f600", "rules", ""]
    texts = pa.array([" ".join(rng.choice(words, int(rng.integers(0, 12)))) for _ in range(700)] + ["", " ", "  ", " a b "], pa.large_string())
    for most_words, least, most, buckets in (3, 2, 5, 1 << 16), (3, 1, 5, 1 << 16), (1, 1, 1, 64), (2, 1, 2, 1 << 10), (2, 3, 7, 1 << 18):
        row, bucket = ngrams.grams(texts, (least, most), (1, most_words), buckets)
        parts, (text_of, part), (part_of, inner) = ngrams.factored(texts, most_words, least, most, buckets)
        own = [[k] if k < buckets else [] for k in range(parts)]
        for k, b in zip(part_of.tolist(), inner.tolist(), strict=True):
            own[k].append(b)
        got = sorted(t * buckets + b for t, k in zip(text_of.tolist(), part.tolist(), strict=True) for b in own[k])
        assert got == sorted((row * buckets + bucket).tolist())
