"""Problem 7: the token ids of every text under a public byte-level BPE tokenizer.

The words (pre-tokens) of the whole corpus are counted in the JVM, map-side
combined; the most frequent ones, a documented number, are merged once and compiled
into a transducer (see ``lexicon``) that is written to the shared folder, sent to
the executors as a file and mapped into memory by each worker.  Words it does not
hold are merged exactly on the spot.  The lexicon decides only where ids come from,
never what they are.

Defined results: null and empty texts give an empty list of ids; strings of special
tokens are ordinary text; other columns are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir
from .lexicon import Lexicon, build

#: Words compiled into the lexicon, at most; bounds what the driver holds.
LEXICON_WORDS = 1 << 16
#: Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file; the folder is a parameter of the environment."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one word: the pair of least rank first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 512:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for very long words."""
    import heapq

    n = len(parts)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if i >= 0 and j >= 0:
            both = parts[i] + parts[j]
            r = ranks.get(both)
            if r is not None:
                heapq.heappush(heap, (r, i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], alive[j], after[i] = both, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i >= 0:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


def frequent_words(texts: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of the corpus; ties by the word itself."""
    words = texts.filter(F.col(text_col).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit("(?U)" + PATTERN), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.length("w") <= 64))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(most).select("w").collect()]  # at most ``most``


def compile_lexicon(spark: SparkSession, words: list[str], ranks: dict[bytes, int]) -> str:
    """Write the lexicon to the shared folder, hand it to the executors, return its file name."""
    data = build((w, merge(w, ranks)) for w in sorted({w.encode() for w in words}))
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def encoder(lexicon: Lexicon | None, ranks: dict[bytes, int]) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """A function texts -> (number of ids of each text, all ids in order).

    The distinct words of the texts are looked up in the lexicon once, those it does
    not hold are merged; the ids of the texts are then gathered by word number.
    Nothing is remembered from one call to the next.
    """
    cut = regex.compile(PATTERN).findall

    def ids_of(word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        ids = lexicon.get(raw) if lexicon else None
        return merge(raw, ranks) if ids is None else ids

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        codes, words = [], []
        for t in texts:
            ws = cut(t) if t else ()
            codes += [number.setdefault(w, len(number)) for w in ws]
            words.append(len(ws))
        table = [ids_of(w) for w in number]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        flat = np.fromiter(chain.from_iterable(table), np.int32, int(sizes.sum()))
        code = np.array(codes, dtype=np.int64)
        each = sizes[code]
        at = np.repeat((np.cumsum(sizes) - sizes)[code], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        ends = np.r_[0, np.cumsum(each)]
        stop = np.cumsum(words)
        return ends[stop] - ends[stop - words], flat[at]

    return encode


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS, lengths_only: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, or (id, tokens) with ``lengths_only``."""
    spark = texts.sparkSession
    path = vocabulary or vocabulary_path()
    name = compile_lexicon(spark, frequent_words(texts, text_col, words), read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(Lexicon(SparkFiles.get(name)), read_ranks(path))
        for batch in batches:
            n, ids = enc(batch.column(1).to_pylist())
            col = pa.array(n.astype(np.int32)) if lengths_only else pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), col], names=[id_col, "tokens" if lengths_only else "ids"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ("tokens int" if lengths_only else "ids array<int>"))
