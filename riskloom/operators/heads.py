"""Linear n-gram heads: one-vs-all logistic regression over hashed word and character n-grams.

Word n-grams up to ``word_ngrams`` and character n-grams of ``min_n``..``max_n`` are
hashed into one sparse vector; each label of a head has its own binary model.  There
is no quantized form: hashing already bounds the size of a model.

All labels of all heads are trained together: n-grams are hashed once, staged as blocks
of parts (``functions.ngrams.factored``), and a pass over the blocks, one in a worker at a time
and never whole in an executor's heap, gives the losses and gradients of every label.  The models are those of ``LogisticRegression``: centred
and scaled features, L2 on the scaled weights, L-BFGS (``functions.lbfgs``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions.lbfgs import minimize
from ..functions.ngrams import add_up, factored, grouped, hashed, pieces
from ..functions.text import collapse
from ..plans.staging import _delete, stage_path
from ..sources.sinks import write_text

#: Texts of a block, their most bytes with 16 for each blank, the rows that hold a block, and vectors that a task adds.
BLOCK, BLOCK_BYTES, SLICES, PARTIALS = 8_192, 8 << 20, 64, 8
#: Parquet options of staged blocks: a block is a row group, so no split of a file parts it, and pages hold a few of its rows.
BLOCKWISE = {"compression": "zstd", "parquet.block.row.count.limit": str(SLICES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
#: Settings of the session that reads them: a row at a time goes to Python, and a few are decoded.
ROWWISE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "4"}


@dataclass
class HeadParams:
    word_ngrams: int = 3
    min_n: int = 2
    max_n: int = 5
    buckets: int = 1 << 18
    iterations: int = 25
    regularization: float = 1e-4


@dataclass
class Head:
    name: str
    params: HeadParams
    models: dict[str, LogisticRegressionModel] = field(default_factory=dict)


def flat_text(text: str) -> Column:
    """The text as its n-grams are taken: line breaks and other white space as single blanks."""
    return collapse(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(" ")))


def _blocks(p: HeadParams, heads: int, targets: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (flat, inside: a bit a head, gold: a bit a target) to blocks, and at the end the sums of the partition.

    ``targets``: the head of each.  Sums: rows of each head, rows and positives of each
    target, then for each head the sums and the squares of every bucket.
    """
    shape = (p.word_ngrams, p.min_n, p.max_n, p.buckets)

    def row(**given) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([given.get(k)], kind) for k, kind in (("shape", pa.string()), ("data", pa.binary()), ("sums", pa.binary()))})

    def block(t: pa.Table, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = t["flat"].combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
        inside, gold = t["inside"].to_numpy(), t["gold"].to_numpy()
        member = (inside[:, None] >> np.arange(heads)) & 1
        counted = sums[len(targets) + heads :].reshape(heads, 2, p.buckets)
        sums[:heads] += member.sum(0)
        sums[heads : heads + len(targets)] += ((gold[:, None] >> np.arange(len(targets))) & 1 & member[:, targets]).sum(0)
        for i, j in pieces(flat):
            bucket, count, bounds = hashed(flat.slice(i, j - i), *shape)
            for h in range(heads):
                w = count * np.repeat(member[i:j, h], np.diff(bounds))
                counted[h, 0] += np.bincount(bucket, w, p.buckets)
                counted[h, 1] += np.bincount(bucket, w * count, p.buckets)
        parts, (text_of, part), (part_of, bucket) = factored(flat, *shape)
        arrays = {"parts": np.array([parts]), "inside": inside, "gold": gold}
        for name, a, b in (("in_part", part_of, bucket), ("in_text", text_of, part), ("texts", part, text_of), ("parts", bucket, part_of)):
            arrays |= {f"{name}_{k}": v for k, v in grouped(a, b).items()}
        shape_of, data = _packed(arrays)
        step = -(-len(data) // SLICES)
        for i in range(SLICES):
            yield row(shape=None if i else shape_of, data=data[i * step : (i + 1) * step])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(targets) + heads + heads * 2 * p.buckets)
        held, n, size = [], 0, 0
        for b in batches:
            flat = b.column(b.schema.get_field_index("flat"))
            weight = np.append(0, np.cumsum(pc.add(pc.binary_length(flat), pc.multiply(pc.count_substring(flat, " "), 16)).to_numpy(zero_copy_only=False)))
            i = 0
            while i < len(b):
                j = min(i + BLOCK - n, max(i + 1, int(np.searchsorted(weight, weight[i] + BLOCK_BYTES - size, "right")) - 1), len(b))
                held.append(b.slice(i, j - i))
                n, size, i = n + j - i, size + int(weight[j] - weight[i]), j
                if n >= BLOCK or size >= BLOCK_BYTES or i < len(b):
                    yield from block(pa.Table.from_batches(held), sums)
                    held, n, size = [], 0, 0
        if n:
            yield from block(pa.Table.from_batches(held), sums)
        if sums[:heads].any():
            yield row(sums=sums.tobytes())

    return run


def _packed(arrays: dict[str, np.ndarray]) -> tuple[str, bytes]:
    """Arrays of numbers from 0 in the narrowest types that hold them, one after the other, and where they are."""
    shape, data, at = {}, [], 0
    for k, v in arrays.items():
        v = v.astype(np.min_scalar_type(int(v.max(initial=0))))
        shape[k] = v.dtype.str, at, len(v)
        data += v.tobytes(), bytes(-v.nbytes % 8)
        at += v.nbytes + -v.nbytes % 8
    return json.dumps(shape), b"".join(data)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each block."""
    shape, held = "", []
    for b in batches:
        for of, data in zip(b["shape"], b["data"], strict=True):
            if of.is_valid == bool(held):
                raise RuntimeError("the rows of a block are not in order")
            shape, _ = of.as_py() or shape, held.append(data.as_py())
            if len(held) == SLICES:
                data, held = b"".join(held), []
                yield {k: np.frombuffer(data, kind, n, at) for k, (kind, at, n) in json.loads(shape).items()}
    if held:
        raise RuntimeError("a block is not whole")


def _added(spark: SparkSession, rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors in the column ``sums``, staged where ``spark`` stages.  Tasks add and stage them until one is left: the driver holds one vector, and no shuffle files gather over the passes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_py())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    staged = []
    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // PARTIALS)
        staged.append(stage_path(spark, "partial-sums"))
        rows.write.parquet(staged[-1])
        rows = rows.sparkSession.read.schema("sums binary").parquet(staged[-1]).coalesce(n).mapInArrow(add, "sums binary")
    total = np.zeros(size)
    for r in rows.collect():
        total += np.frombuffer(r["sums"])
    for path in staged:
        _delete(spark, path)
    return total


def _pass(weights, p: HeadParams, targets: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks to the sums of losses, of residuals, and of residuals times features, of each active target (index, weights, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = weights.value
        of, n, wide = np.array([t for t, *_ in active]), len(active), -(-len(active) // 4) * 4  # whole rows of the processor's registers
        w, offset = np.zeros((p.buckets, wide)), np.array([b for *_, b in active])
        for k, (_, x, _) in enumerate(active):
            w[:, k] = x
        sums, slope = np.zeros((n, 2)), np.zeros((p.buckets, wide))
        for x in _unpacked(batches):
            sides = lambda name: [x[f"{name}_{k}"] for k in ("ids", "size", "owners", "members")]  # noqa: E731, B023
            inside, gold = x["inside"].astype(np.int64), x["gold"].astype(np.int64)
            margin, values = np.zeros((len(inside), wide)), np.zeros((int(x["parts"][0]), wide))
            if w.any():  # not at the start
                values[: p.buckets] = w
                add_up(values, w, *sides("in_part"))
                add_up(margin, values, *sides("in_text"))
            m = margin[:, :n] + offset
            member, y = (inside[:, None] >> np.array(targets)[of]) & 1, (gold[:, None] >> of) & 1
            e = np.exp(-np.abs(m))
            sums[:, 0] += (member * (np.log1p(e) + np.maximum(m, 0) - y * m)).sum(0)
            margin[:, :n] = member * (np.where(m >= 0, 1, e) / (1 + e) - y)
            sums[:, 1] += margin[:, :n].sum(0)
            values[: p.buckets] = 0
            add_up(values, margin, *sides("texts"))
            slope += values[: p.buckets]
            own = np.zeros_like(slope)
            add_up(own, values, *sides("parts"))
            slope += own
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.hstack([sums, slope[:, :n].T]).tobytes()], pa.binary())})

    return run


def _model(spark: SparkSession, label: str, w: np.ndarray, b: float, p: HeadParams) -> LogisticRegressionModel:
    sc = spark.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"ngrams_{label}", _py2java(sc, DenseVector(w)), float(b))
    m = LogisticRegressionModel(made)
    return m.copy({m.maxIter: p.iterations, m.regParam: p.regularization, m.featuresCol: "_x", m.labelCol: "_y"})


def train_heads(df: DataFrame, text: str, labels: dict[str, str], params: HeadParams | None = None) -> list[Head]:
    """Fit the binary models of every head at once.

    ``labels``: the column of each head with a record's labels there; null or empty: the
    record is not of that head.  Labels without both classes are left out.
    """
    p, spark, names = params or HeadParams(), df.sparkSession, list(labels)
    targets = [(i, x) for i, h in enumerate(names) for x in T.HEADS[h]]
    of = [i for i, _ in targets]
    bits = lambda each: sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(each)), F.lit(0)).cast("long")
    rows = df.select(flat_text(text).alias("flat"), bits([F.size(labels[h]) > 0 for h in names]).alias("inside"), bits([F.array_contains(labels[names[i]], x) for i, x in targets]).alias("gold"))
    schema = "shape string, data binary, sums binary"
    path = stage_path(spark, "head-blocks")
    rows.filter("inside > 0").mapInArrow(_blocks(p, len(names), of), schema).write.options(**BLOCKWISE).parquet(path)
    reader = spark.newSession()
    for k, v in ROWWISE.items():
        reader.conf.set(k, v)
    staged = reader.read.schema(schema).parquet(path)
    sums = _added(spark, staged.filter("sums is not null").select("sums"), len(names) + len(of) + len(names) * 2 * p.buckets)
    n, positive, counted = sums[: len(names)], sums[len(names) : len(names) + len(of)], sums[len(names) + len(of) :].reshape(len(names), 2, p.buckets)
    mean = counted[:, 0] / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(counted[:, 1] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    scale = np.divide(1, spread, out=np.zeros_like(spread), where=spread > 1e-9)
    del sums, counted
    searches, asked = {}, {}
    for t, (i, _) in enumerate(targets):
        if 0 < positive[t] < n[i]:
            start = np.zeros(p.buckets + 1)
            start[-1] = np.log(positive[t] / (n[i] - positive[t]))
            searches[t] = minimize(start, p.iterations)
            asked[t] = next(searches[t])
    cores = spark.sparkContext.defaultParallelism
    blocks = staged.filter("sums is null").drop("sums").coalesce(cores)
    found = {}
    while asked:
        active = []
        for t, x in asked.items():
            w = x[:-1] * scale[of[t]]
            active.append((t, w, x[-1] - w @ mean[of[t]]))
        sent = spark.sparkContext.broadcast(active)
        got = _added(spark, blocks.mapInArrow(_pass(sent, p, of), "sums binary"), len(active) * (p.buckets + 2)).reshape(len(active), p.buckets + 2)
        sent.destroy()
        for (t, x), (loss, left), g in zip(list(asked.items()), got[:, :2], got[:, 2:], strict=True):
            h = of[t]
            slope = np.append((g - left * mean[h]) * scale[h] / n[h] + p.regularization * x[:-1], left / n[h])
            try:
                asked[t] = searches[t].send((loss / n[h] + p.regularization / 2 * (x[:-1] @ x[:-1]), slope))
            except StopIteration as end:
                found[t] = end.value
                del asked[t], searches[t]
    _delete(spark, path)
    out = {h: Head(h, p) for h in names}
    for t, (i, label) in enumerate(targets):
        if t in found:
            w = found[t][:-1] * scale[i]
            out[names[i]].models[label] = _model(spark, label, w, found[t][-1] - w @ mean[i], p)
    return list(out.values())


def train_head(df: DataFrame, head: str, text: str = "text", labels: str = "head_labels", params: HeadParams | None = None) -> Head:
    """Fit a binary model for each label of one head (rows: text, labels array); labels without both classes are left out."""
    return train_heads(df, text, {head: labels}, params)[0]


def head_metrics(df: DataFrame, head: Head, text: str = "text", labels: str = "head_labels") -> DataFrame:
    """P@1 and R@1 of a head on labelled records (validation or test report)."""
    scored = score_labels(df, [head], text)
    best = F.array_max(F.transform("_all", lambda s: F.struct(s["score"].alias("score"), s["label"].alias("label"))))["label"]
    return precision_recall_at_1(scored.select(F.col(labels).alias("gold"), best.alias("top1"))).withColumn("head", F.lit(head.name))


def score_labels(df: DataFrame, heads: list[Head], text: str, out: str = "_all") -> DataFrame:
    """Add an array of (head, label, score) with every label of every head; n-grams are hashed once for equal parameters."""
    shapes: dict[tuple, list] = {}
    for h in heads:
        for label, m in h.models.items():
            shapes.setdefault(tuple(vars(h.params)[k] for k in ("word_ngrams", "min_n", "max_n", "buckets")), []).append((h.name, label, m))
    keep, parts = df.columns, {}
    for i, (shape, models) in enumerate(shapes.items()):
        w = df.sparkSession.sparkContext.broadcast((np.ascontiguousarray(np.stack([m.coefficients.toArray() for *_, m in models], 1)), np.array([m.intercept for *_, m in models])))
        df = df.withColumn(f"_s{i}", F.pandas_udf(_scorer(w, shape), "array<double>")(flat_text(text)))
        for k, (head, label, _) in enumerate(models):
            parts[head, label] = F.struct(F.lit(head).alias("head"), F.lit(label).alias("label"), F.col(f"_s{i}")[k].alias("score"))
    every = F.array(*[parts[h.name, x] for h in heads for x in h.models]) if parts else F.array().cast("array<struct<head:string,label:string,score:double>>")
    return df.withColumn(out, every).select(*keep, out)


def _scorer(weights, shape: tuple) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = weights.value
        for texts in batches:
            scores = np.empty((len(texts), len(b)))
            flat = pa.array(texts, pa.large_string())
            for i, j in pieces(flat):
                bucket, count, bounds = hashed(flat.slice(i, j - i), *shape)
                for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    scores[i + k] = count[x:y] @ w.take(bucket[x:y], 0) + b
            e = np.exp(-np.abs(scores))
            yield pd.Series(list(np.where(scores >= 0, 1, e) / (1 + e)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def score_heads(df: DataFrame, heads: list[Head], text: str = "detection_text", out: str = "head_scores") -> DataFrame:
    """Add an array of (label, score): for each scored label the greatest probability over the heads; ``safe`` is left out."""
    d = score_labels(df, heads, text)
    one = lambda x: F.coalesce(F.array_max(F.transform(F.filter("_all", lambda s: s["label"] == x), lambda s: s["score"])), F.lit(0.0))
    return d.withColumn(out, F.array(*[F.struct(F.lit(x).alias("label"), one(x).alias("score")) for x in T.SCORED])).drop("_all")


def save_heads(spark: SparkSession, heads: list[Head], path: str, **metadata: object) -> None:
    """Write the models of heads and ``heads.json`` (parameters, labels and what else is given)."""
    doc = {h.name: {"params": vars(h.params), "labels": list(h.models)} for h in heads}
    for h in heads:
        for label, m in h.models.items():
            m.write().overwrite().save(f"{path}/{h.name}/{label}")
    write_text(spark, f"{path}/heads.json", json.dumps({"heads": doc, **metadata}, indent=2, default=str))


def load_heads(spark: SparkSession, path: str) -> list[Head]:
    doc = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/heads.json", wholetext=True).collect()))
    return [Head(name, HeadParams(**h["params"]), {x: LogisticRegressionModel.load(f"{path}/{name}/{x}") for x in h["labels"]}) for name, h in doc["heads"].items()]


def precision_recall_at_1(predicted: DataFrame) -> DataFrame:
    """P@1 and R@1 over records (gold array, top1)."""
    hit = F.count_if(F.array_contains("gold", F.col("top1")))
    return predicted.agg(F.count(F.lit(1)).alias("records"), (hit / F.nullif(F.count_if(F.col("top1").isNotNull()), F.lit(0))).alias("p_at_1"), (hit / F.nullif(F.sum(F.size("gold")), F.lit(0))).alias("r_at_1"))
