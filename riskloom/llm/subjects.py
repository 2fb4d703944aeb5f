"""Problem 9: the subject areas of every document.

Class-association rules.  The sentences of labelled documents become transactions
(their telling words and the subjects of the document); parallel frequent-pattern
growth mines rules words -> subject; a rule that says no more than a shorter one is
pruned.  A rule's evidence is the gain in log-odds of its (cautious) confidence over
the share of the subject.  A sentence is about the subject with most evidence if
that evidence, calibrated on labelled documents kept out of a first round of mining,
stands for a precision of at least PRECISION.  A document has each subject that at
least a fifth of its sentences is about, and at most the two strongest.

The classifier is fitted on at most LABELLED documents (a hash sample of the
labelled ones); every document is scored, whole, in one pass without a shuffle.

Defined results: null or empty text and text without a sentence of three words has
no subject; labels are trimmed and lower-cased, those outside the list of areas are
dropped, repeated labels count once; without labels there are no rules and no
subjects; documents with the same id are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import hash63
from ..plans.staging import stage
from .common import strip_all

#: Labelled documents that the classifier is fitted on, at most.
LABELLED = 50_000
#: A word is telling if this many labelled documents have it and a subject has this share of them.
MIN_DOCUMENTS = 3
MIN_SHARE = 0.35
#: Rules occur in this many sentences and hold in this share of them.
MIN_SENTENCES = 3
MIN_CONFIDENCE = 0.4
#: Telling words in a transaction; a longer sentence is several transactions, the most telling words together.
#: (Frequent sets grow as two to the power of this.  README has how often it is reached.)
MOST_ITEMS = 10
#: Held-out sentences of the labelled sample that the threshold is calibrated on, at most.
CALIBRATED = 200_000
PRECISION = 0.7
#: Share of sentences that makes a subject: one in FIFTH.
FIFTH = 5

_CUT = regex.compile(r"""(?<=[.!?。…])["')\]]*\s+|[\r\n]+|(?<=[.!?])",\s*\"""")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]+")
_CLASS = "@"


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that has at least three words of three letters."""
    out = []
    for s in _CUT.split(text.lower()) if text else ():
        words = [w for w in _WORD.findall(s) if len(w) > 2]
        if len(words) >= 3:
            out.append(words)
    return out


def labelled(examples: DataFrame, areas: DataFrame, id_col: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """(id, subjects) of at most ``most`` labelled documents, chosen by hash."""
    names = areas.select(strip_all(F.lower("subject")).alias("subject")).filter("subject <> ''").distinct()
    clean = examples.select(F.col(id_col).alias("id"), strip_all(F.lower("subject")).alias("subject")).join(F.broadcast(names), "subject", "left_semi")  # a fixed list of areas
    per = clean.filter("id is not null").groupBy("id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))  # at most one entry an area
    return per.orderBy(hash63("id", seed=9), "id").limit(most)


def transactions(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, held, subjects, words): a row for each sentence of the labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subjects, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, s, sorted(set(w))) for i, s, t in zip(ids, subjects, texts) for w in sentences(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["id", "subjects", "words"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(labels, "id")
    out = d.select("id", "subjects", "text").mapInArrow(run, "id long, subjects array<string>, words array<string>")
    return out.withColumn("held", hash63("id", seed=5) % 5 == 0)


@dataclass
class Rules:
    """Evidence of single words and of pairs: {word: {subject: e}}, {(a, b): {subject: e}}."""

    words: dict[str, dict[str, float]]
    pairs: dict[tuple[str, str], dict[str, float]]
    threshold: float = 1.0

    def best(self, words: set[str]) -> tuple[str | None, float]:
        """The subject with most evidence in a sentence; ties go to the first by name."""
        total: dict[str, float] = defaultdict(float)
        known = sorted(w for w in words if w in self.words)
        for w in known:
            for s, e in self.words[w].items():
                total[s] += e
        if self.pairs and len(known) > 1:
            for i, a in enumerate(known):
                for b in known[i + 1 :]:
                    for s, e in self.pairs.get((a, b), {}).items():
                        total[s] += e
        return max(((s, e) for s, e in sorted(total.items())), key=lambda x: x[1], default=(None, 0.0))

    def subjects(self, text: str | None) -> tuple[list[tuple[str, int]], int]:
        """([(subject, sentences about it)], sentences) for the subjects of a text."""
        ss, count = sentences(text), defaultdict(int)
        for words in ss:
            s, e = self.best(set(words))
            if s is not None and e >= self.threshold:
                count[s] += 1
        enough = sorted(((s, n) for s, n in count.items() if FIFTH * n >= len(ss)), key=lambda x: (-x[1], x[0]))
        return enough[:2], len(ss)


def cautious(hits: float, n: float) -> float:
    """Lower end of a 68 % Wilson interval."""
    p = hits / n
    return (p + 1 / (2 * n) - math.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)


def mine(tx: DataFrame) -> Rules:
    """Rules of the transactions: telling words first, then frequent-pattern growth over them."""
    spark = tx.sparkSession
    one = tx.select("id", "subjects", F.explode("words").alias("w")).distinct()
    seen = one.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DOCUMENTS)
    by = one.select("w", F.explode("subjects").alias("s")).groupBy("w", "s").agg(F.count(F.lit(1)).alias("c"))
    # bounded: words of at most LABELLED documents
    telling: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)
    for r in by.join(seen, "w").filter(F.col("c") >= MIN_SHARE * F.col("n")).collect():
        telling[r["w"]][r["s"]] = (r["c"], r["n"])
    total, share = tx.count(), {r["s"]: r["c"] for r in tx.select(F.explode("subjects").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not total or not telling:
        return Rules({}, {})
    strength = {w: max(c / n for c, n in by_subject.values()) for w, by_subject in telling.items()}
    vocabulary = spark.createDataFrame(list(strength.items()), "w string, strength double")
    own = tx.withColumn("_t", F.monotonically_increasing_id()).select("_t", "subjects", F.explode("words").alias("w")).join(F.broadcast(vocabulary), "w")
    items = own.withColumn("_p", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("strength"), "w")) - 1)  # words of one sentence
    marked = F.transform("subjects", lambda s: F.concat(F.lit(_CLASS), s))
    grouped = items.groupBy("_t", "subjects", (F.col("_p") / MOST_ITEMS).cast("int").alias("_g")).agg(F.array_sort(F.collect_set("w")).alias("ws"))
    baskets = stage(grouped.select(F.concat("ws", marked).alias("items")), "p9-baskets")
    n = baskets.count()
    if not n:
        return Rules({}, {})
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, MIN_SENTENCES / n), minConfidence=MIN_CONFIDENCE).fit(baskets)
    is_class = lambda c: F.startswith(c, F.lit(_CLASS))
    rules = model.associationRules.filter(is_class(F.get("consequent", F.lit(0))) & ~F.exists("antecedent", is_class) & (F.size("antecedent") <= 2))
    found: dict[tuple[str, ...], dict[str, tuple[float, float]]] = defaultdict(dict)
    for r in rules.select("antecedent", "consequent", "confidence", "support").collect():  # rules over the telling words only
        n_if = r["support"] * n / r["confidence"]
        found[tuple(sorted(r["antecedent"]))][r["consequent"][0][1:]] = (r["confidence"] * n_if, n_if)

    def gain(s: str, p: float) -> float:
        prior = min(max(share.get(s, 0) / total, 1e-3), 0.999)
        p = min(max(p, 1e-3), 0.98)
        return math.log(p / (1 - p)) - math.log(prior / (1 - prior))

    words: dict[str, dict[str, float]] = {}
    sure: dict[tuple[str, str], float] = {}
    for key, subjects in found.items():
        if len(key) == 1:
            for s, (hits, n_if) in subjects.items():
                docs = telling[key[0]].get(s)
                if docs:  # the word must be cautiously telling by documents as well as by sentences
                    p = min(cautious(hits, n_if), cautious(*docs))
                    if p >= MIN_CONFIDENCE:
                        words.setdefault(key[0], {})[s] = gain(s, p)
                        sure[key[0], s] = p
    pairs: dict[tuple[str, str], dict[str, float]] = {}
    for key, subjects in found.items():
        if len(key) == 2:
            for s, (hits, n_if) in subjects.items():
                p, known = cautious(hits, n_if), max(sure.get((w, s), 0.0) for w in key)
                if n_if >= 5 and p >= MIN_CONFIDENCE and p > known + 0.05 and any(w in words for w in key):  # else redundant
                    pairs.setdefault(key, {})[s] = gain(s, p) - sum(max(words.get(w, {}).get(s, 0.0), 0.0) for w in key)
    for a, b in pairs:
        words.setdefault(a, {}), words.setdefault(b, {})
    return Rules(words, {k: {s: e for s, e in v.items() if e > 0} for k, v in pairs.items()})


def calibrate(rules: Rules, held: DataFrame, most: int = CALIBRATED) -> float:
    """Least evidence whose pooled precision on sentences of held-out documents is PRECISION.

    Pools adjacent evidence bins until precision does not fall with evidence
    (isotonic regression by pool-adjacent-violators).
    """
    scored = []
    for r in held.select("subjects", "words").limit(most).toLocalIterator():  # sentences of a fifth of the labelled sample
        s, e = rules.best(set(r["words"]))
        if s is not None:
            scored.append((e, s in r["subjects"]))
    if len(scored) < 100:
        return 1.0
    scored.sort()
    size = max(20, len(scored) // 50)
    pools: list[list[float]] = []  # hits, count, least evidence
    for at in range(0, len(scored), size):
        part = scored[at : at + size]
        pools.append([sum(h for _, h in part), len(part), part[0][0]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
    return next((low for hits, n, low in pools if hits >= PRECISION * n), math.inf)


def fit(docs: DataFrame, examples: DataFrame, areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> Rules:
    tx = stage(transactions(docs, labelled(examples, areas, id_col, most), id_col, text_col), "p9-sentences")
    threshold = calibrate(mine(tx.filter("not held")), tx.filter("held"))
    rules = mine(tx)
    rules.threshold = threshold
    return rules


def assign(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, about, sentences) for every subject of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((rules.words, rules.pairs, rules.threshold))  # bounded by the fitted sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rules(*shared.value)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got, n = r.subjects(t)
                rows += [(i, s, k, n) for s, k in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.int32())],
                names=[id_col, "subject", "about", "sentences"],
            )

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, subject string, about int, sentences int")


def composition(assigned: DataFrame, docs: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, share, weight): what the corpus is about.

    ``weight`` is the factor that would give every subject the same number of
    documents; null where there is none to be weighted.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    got = assigned.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    a = areas.select("subject").distinct().join(F.broadcast(got), "subject", "left").crossJoin(F.broadcast(n))  # one row an area; one row
    a = a.withColumn("documents", F.coalesce("documents", F.lit(0)))
    mean = a.agg(F.avg("documents").alias("mean"))
    a = a.crossJoin(F.broadcast(mean))
    return a.select("subject", "documents", (F.col("documents") / F.nullif("n", F.lit(0))).alias("share"), (F.col("mean") / F.nullif("documents", F.lit(0))).alias("weight"))
