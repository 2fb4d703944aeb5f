"""Exact joins of word sets by word share (Jaccard), for one table or two.

What it is: a prefix filter over words in a common order, whose inverted lists
(*regions*: the records that have a given word, or given two, three ... words) are
divided by one more word until their counted size is at most REGION.

Bands.  A record of n words belongs to the band j with n <= BASE 2^j, and to the next
one if a partner of it can; in band j the words are dealt to 2^j groups by hash, and
each group of a record is a record of its own.  If two sets share t of their words,
then by averaging they do so in one group at least, and all sizes lie in a band of
both; so the cost of a record grows with its length, not with its square.

Order and windows.  Words that at most REGION records of the band have are *rare* and
come first, the others follow by falling rarity.  Of n words a partner shares at least
ceil(t n), so the first shared word is among the first n - ceil(t n) + 1, the second
among one more, and so on.  A record is sent to the region of each rare word in its
first window and, for its frequent words, to the regions of two words.  Regions are
counted (combined map-side); one above REGION is divided by the next word of the
path, again and again, while that pays: when the children would still hold more than
half of the pairs, its records are alike in their words and it is joined in blocks.
A path that has no further word is closed by an end mark, which is a region too.  Two
records within the threshold always meet: follow their shared words in order down to
the first region that is not divided.

Join.  Postings go to their region by one exchange.  Within a region a pair survives
if the words skipped before the meeting plus the bits in which the parity maps of the
words after it differ, a lower bound of the number of words that only one of the two
has, allow the threshold.  This is bit arithmetic on some thousand pairs
a record, done in numpy on whole Arrow batches.  The caller verifies the survivors on
the words themselves.

The table of frequent words goes to the workers while it has at most SENT rows;
beyond, the counts are joined to the words by a shuffle.  Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_checked, semi_join_checked
from ..plans.staging import stage
from .common import word_list

#: A region counted to hold more records than this is divided.
REGION = 2048
#: Records of at most this many words are one group.
BASE = 64
#: Frequent words that are sent to every worker, at most (16 bytes each).
SENT = 1 << 20
#: Copies of a class that are expanded together.
BLOCK = 4096
_END = np.int64(-0x61C8864680B583EB)
_CLOSED = 1 << 61
_FLUSH = 1 << 18
_COMBINE = 1 << 21
_ROWS = 256
_OFFSETS = 64
POSTING = "key long, cid long, meta long, bits long, parent long"
ROW = ["key", "cid", "meta", "bits"]
LEFT, RIGHT = 1, 2


@dataclass(frozen=True)
class Share:
    """The threshold num / den, above one half."""

    num: int
    den: int

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Words of a set of n that any partner shares."""
        return (self.num * n + self.den - 1) // self.den

    def window(self, n: np.ndarray) -> np.ndarray:
        return n - self.needed(n) + 1

    def apart(self, both: np.ndarray) -> np.ndarray:
        """Words that only one of two sets may have, by the sum of their sizes."""
        return both - 2 * ((self.num * both + self.num + self.den - 1) // (self.num + self.den))


def mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several integer columns."""
    with np.errstate(over="ignore"):
        h = np.full(parts[0].shape, 0x9E3779B97F4A7C15 + len(parts), dtype=np.uint64)
        for p in parts:
            h ^= p.astype(np.uint64)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def tokens_of(words: Column) -> Column:
    """64-bit hashes of words, sorted: equal for equal sets."""
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


@dataclass
class Groups:
    """The groups of the records of one Arrow batch, words in common order."""

    cid: np.ndarray
    meta: np.ndarray  # role, band and group, see ``groups``
    owner: np.ndarray  # row in the batch
    sizes: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray
    parity: np.ndarray  # map of all words up to a place, one more than there are words

    def rest(self, idx: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Parity map of the words of groups after the places ``last``."""
        return self.parity[self.starts[idx] + self.sizes[idx]] ^ self.parity[self.starts[idx] + last + 1]


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Banded:
    """Records once in each of their bands; the tokens of a band are its own."""

    cid: np.ndarray
    role: np.ndarray
    band: np.ndarray
    row: np.ndarray  # place in the batch
    owner: np.ndarray  # record of each token
    tokens: np.ndarray


def banded(batch: pa.RecordBatch, share: Share, only: np.ndarray | None = None) -> Banded:
    """``batch``: cid, role, tokens; with ``only``, records in the band given for each row."""
    cid, role = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cid", "role"))
    n, tokens = _flat(batch.column("tokens"))
    own = np.frexp((np.maximum(n, 1) - 1) // BASE)[1].astype(np.int64)  # least j with n <= BASE 2^j
    row = np.arange(len(n))
    if only is None:
        also = n * share.den > share.num * np.left_shift(BASE, own)  # a partner may be in the next band
        row, band = np.r_[row, row[also]], np.r_[own, own[also] + 1]
    else:
        band = only
    sizes, starts = n[row], (np.cumsum(n) - n)[row]
    owner = np.repeat(np.arange(len(row)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
    return Banded(cid[row], role[row], band, row, owner, (tokens[at] & ~31) | band[owner])  # stays in order within a record


def groups(b: Banded, counts: np.ndarray) -> Groups:
    many = np.left_shift(1, b.band)
    group = np.zeros(len(b.tokens), np.int64)
    if (b.band > 0).any():
        group = (mix(b.tokens) >> 8) & (many[b.owner] - 1)
    gid = (np.cumsum(many) - many)[b.owner] + group
    # by group, then rare words and rising counts (as floats, whose bits are in order), then by word as they came
    order = np.argsort((gid << 32) | counts.astype(np.float32).view(np.int32), kind="stable")
    owner, group, gid, tokens, counts = b.owner[order], group[order], gid[order], b.tokens[order], counts[order]
    starts = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    of = owner[starts]
    bit = np.left_shift(np.uint64(1), ((tokens >> 8) & 63).astype(np.uint64))
    parity = np.r_[np.zeros(1, np.int64), np.bitwise_xor.accumulate(bit).view(np.int64)]
    # 2 bits of role, 1 for a closed path, 5 of band, 24 of group; 16 of size and 16 of skipped words follow (groups are small)
    meta = (b.role[of] << 62) | (b.band[of] << 56) | (group[starts] << 32)
    return Groups(b.cid[of], meta, b.row[of], np.diff(np.r_[starts, len(tokens)]), starts, tokens, counts, parity)


def _combined(key: list[np.ndarray], *values: tuple[list[np.ndarray], np.ufunc]) -> list[np.ndarray]:
    """Values of equal keys combined."""
    k = np.concatenate(key)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return [k[at], np.diff(np.r_[at, len(k)]), *[f.reduceat(np.concatenate(v)[order], at) for v, f in values]]


class Frequencies:
    """Counts of the frequent words: a table sent to the workers, or joined to the words by a shuffle."""

    def __init__(self, sets: DataFrame, share: Share, region: int, sent: int) -> None:
        """``sets``: (cid, role, tokens)."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in _combined(held)], names=["w", "c"])

            for batch in batches:
                held.append(banded(batch, share).tokens)
                rows += len(held[-1])
                if rows > _COMBINE:
                    yield flush()
                    held, rows = [], 0
            if rows:
                yield flush()

        self.share, self.sets = share, sets
        counts = sets.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).filter(F.col("c") > region)
        counts = stage(counts, "words")
        self.table = None
        if counts.count() <= sent:
            got = counts.toPandas()  # at most ``sent`` rows, just counted
            order = np.argsort(got["w"].to_numpy(dtype=np.int64), kind="stable")
            self.table = (got["w"].to_numpy(dtype=np.int64)[order], got["c"].to_numpy(dtype=np.int64)[order])
        else:
            self.sets = self._joined(counts)
        self.shared = sets.sparkSession.sparkContext.broadcast(self.table)

    def _joined(self, counts: DataFrame) -> DataFrame:
        """(cid, role, tokens, words, counts): words in their bands, with their counts where frequent."""
        share = self.share

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = banded(batch, share)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.cid[b.owner], b.role[b.owner], b.tokens)], names=["cid", "role", "w"])

        one = self.sets.mapInArrow(each, "cid long, role long, w long").join(counts, "w")  # frequent ones only
        per = one.groupBy("cid", "role").agg(F.collect_list(F.struct("w", "c")).alias("l"))  # words of one record
        s = self.sets.join(per, ["cid", "role"], "left")
        return stage(s.select("cid", "role", "tokens", F.col("l.w").alias("words"), F.col("l.c").alias("counts")), "counted")

    def reader(self):
        """A function (batch, words in bands) -> counts; travels to the workers."""
        shared = self.shared

        def counts(batch: pa.RecordBatch, b: Banded) -> np.ndarray:
            if shared.value is not None:
                words, count = shared.value
                key = b.tokens
            else:  # words are looked up by (row, word)
                n, words = _flat(batch.column("words"))
                count = _flat(batch.column("counts"))[1]
                words = mix(words, np.repeat(np.arange(len(n)), n))
                order = np.argsort(words)
                words, count, key = words[order], count[order], mix(b.tokens, b.row[b.owner])
            if not len(words):
                return np.zeros(len(key), np.int64)
            at = np.minimum(np.searchsorted(words, key), len(words) - 1)
            return np.where(words[at] == key, count[at], 0)

        return counts


def first_regions(g: Groups, share: Share) -> Iterator[Posting]:
    """(key, index of group, place of the last word, words skipped, flag of a closed path, parent key): single rare words and pairs of frequent ones."""
    n, window = g.sizes, share.window(g.sizes)
    place = np.arange(len(g.tokens)) - np.repeat(g.starts, n)
    owner = np.repeat(np.arange(len(n)), n)
    rare = np.add.reduceat((g.counts == 0).astype(np.int64), g.starts) if len(n) else np.zeros(0, np.int64)
    single = (g.counts == 0) & (place < np.repeat(window, n))
    yield g.tokens[single], owner[single], place[single], place[single], 0, g.tokens[single]
    idx = np.flatnonzero(rare < window)
    first = window[idx] - rare[idx]
    head = np.repeat(idx, first)
    at = rare[head] + np.arange(len(head)) - np.repeat(np.cumsum(first) - first, first)
    yield from extended(g, share, g.tokens[g.starts[head] + at], head, at, 1)


def extended(g: Groups, share: Share, key: np.ndarray, idx: np.ndarray, last: np.ndarray, level: int) -> Iterator[Posting]:
    """The regions below ``key``, reached by group ``idx`` with ``level`` words, the last at place ``last``."""
    n = g.sizes[idx]
    stop = np.minimum(share.window(n) + level, n)
    more = np.maximum(stop - last - 1, 0)
    step = max(1, (1 << 21) // max(1, int(more.max(initial=1))))
    for a in range(0, len(idx), step):
        k, i, m = key[a : a + step], idx[a : a + step], more[a : a + step]
        pick = np.repeat(np.arange(len(i)), m)
        at = last[a : a + step][pick] + 1 + np.arange(len(pick)) - np.repeat(np.cumsum(m) - m, m)
        yield mix(k[pick], g.tokens[g.starts[i[pick]] + at]), i[pick], at, at - level, 0, k[pick]
    end = share.needed(n) <= level
    if end.any():
        yield mix(key[end], np.full(int(end.sum()), _END)), idx[end], last[end], last[end] + 1 - level, _CLOSED, key[end]


def _ranges(key: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probes, lo, hi): the postings that look for partners, and where these stand; sorted by key and role.

    Of one table a posting looks at those after it in its region; of two, a RIGHT
    one at the LEFT ones, which stand behind the RIGHT ones.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[starts, len(key)])
    ends = np.repeat(starts + length, length)
    if (role == LEFT | RIGHT).any():
        return np.arange(len(key)), np.arange(len(key)) + 1, ends
    rights = np.add.reduceat((role == RIGHT).astype(np.int64), starts)
    probes = np.flatnonzero(role == RIGHT)
    return probes, np.repeat(starts + rights, length)[probes], ends[probes]


def pairs_of(key: np.ndarray, cid: np.ndarray, meta: np.ndarray, bits: np.ndarray, share: Share) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i LEFT and j RIGHT, of postings of one region that may be within the threshold; sorted by key, of two tables the RIGHT ones first."""
    size, skip, role = ((meta >> 16) & 0xFFFF).astype(np.int32), (meta & 0xFFFF).astype(np.int32), ((meta >> 62) & 3).astype(np.int8)
    apart = share.apart(np.arange(2 * int(size.max(initial=0)) + 1)).astype(np.int32)
    # apart[a + b] - skipped words <= left[a] + left[b]; in a byte for the blocks
    left = np.clip(size * (share.den - share.num) // (share.num + share.den) + 1 - skip, -50, 50).astype(np.int8)
    u = bits.view(np.uint64)
    probes, lo, hi = _ranges(key, role)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        most = apart[size[i] + size[j]]
        ok = (np.bitwise_count(u[i] ^ u[j]) + skip[i] + skip[j] <= most) & (np.abs(size[i] - size[j]) <= most)
        if len(i) and role[i[0]] == LEFT | RIGHT:
            ok &= cid[i] != cid[j]
        found.append((i[ok], j[ok]))

    many = np.flatnonzero(hi - lo > _OFFSETS)
    i, a, b = probes, lo, hi
    for d in range(_OFFSETS):
        more = a + d < b
        i, a, b = i[more], a[more], b[more]
        if not len(i):
            break
        ok = left[i] + left[a + d] >= 0  # most pairs have skipped too many words
        keep(i[ok], a[ok] + d)
    # probes with more partners meet the rest of them in blocks of one region
    cuts = np.flatnonzero(np.r_[True, key[probes[many]][1:] != key[probes[many]][:-1]]) if len(many) else []
    for s, e in zip(cuts, np.r_[cuts[1:], len(many)].astype(np.int64)) if len(many) else ():
        for at in range(int(s), int(e), _ROWS):
            rows = many[at : min(at + _ROWS, int(e))]
            x, first, last = probes[rows], int(lo[rows].min()) + _OFFSETS, int(hi[rows].max())
            near = np.bitwise_count(u[x, None] ^ u[None, first:last]).view(np.int8) <= left[x, None] + left[None, first:last]
            p, q = np.divmod(np.flatnonzero(near), last - first)
            q += first
            far = (q >= lo[rows][p] + _OFFSETS) & (q < hi[rows][p])
            keep(x[p[far]], q[far])
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    swap = np.where(role[i] == LEFT | RIGHT, cid[i] > cid[j], role[i] == RIGHT)
    return np.where(swap, j, i), np.where(swap, i, j)


def joined(postings: DataFrame, share: Share) -> DataFrame:
    """(cid_l, cid_r) of the pairs that survive in their region; one exchange, no region above REGION is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))  # the open region waits
            done, held = [c[:cut] for c in cols], [[c[cut:] for c in cols]]
            rows = len(cols[0]) - cut
            if cut:
                role = (done[2] >> 62) & 3
                if (role != LEFT | RIGHT).any():
                    order = np.lexsort((-role, done[0]))
                    done = [c[order] for c in done]
                i, j = pairs_of(*done, share)
                a, b = done[1][i], done[1][j]
                if len(a):
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["cid_l", "cid_r"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                rows += batch.num_rows
                if rows >= _FLUSH:
                    yield from flush(False)
        if rows:
            yield from flush(True)

    placed = postings.select(*ROW).repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "cid_l long, cid_r long")


def _blocked(known: DataFrame, region: int) -> DataFrame:
    """Postings with ``m``, the size of their region where it is above ``region``: cut into blocks, every two blocks of a region meet in one of their own."""
    nb = F.ceil(F.coalesce("m", F.lit(1)) / region).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    h = known.withColumn("nb", nb).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    key = F.when(F.col("nb") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, "o"), F.greatest(own, "o")))
    return h.select(key.alias("key"), "cid", "meta", "bits")


def _counting(made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[Groups, Posting]]]):
    """Postings as (key, parent, n, closed), combined before they leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        rows = 0

        def flush() -> pa.RecordBatch:
            key, n, closed, parent = _combined(held[0], (held[1], np.maximum), (held[2], np.maximum))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, parent, n, closed)], names=["key", "parent", "n", "closed"])

        for _, (key, _, _, _, closed, parent) in made(batches):
            for to, x in zip(held, (key, np.full(len(key), int(closed > 0)), parent)):
                to.append(x)
            rows += len(key)
            if rows > _COMBINE:
                yield flush()
                held, rows = [[], [], []], 0
        if rows:
            yield flush()

    return run


def _writing(made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[Groups, Posting]]]):
    """Postings as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, (key, idx, last, skipped, closed, parent) in made(batches):
            if len(key):
                meta = g.meta[idx] | (g.sizes[idx] << 16) | skipped | closed
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, g.cid[idx], meta, g.rest(idx, last), parent)], names=["key", "cid", "meta", "bits", "parent"])

    return run


def candidates(sets: DataFrame, share: Share, region: int = REGION, sent: int = SENT) -> DataFrame:
    """(cid_l, cid_r), distinct: every pair of records of word share >= share, and some others.

    ``sets``: (cid, role, tokens) with the distinct tokens of ``tokens_of``; role 3 for one table joined
    with itself (each pair once, cid_l < cid_r), 1 and 2 for two tables.
    """
    sets = sets.select(F.col("cid").cast("long"), F.col("role").cast("long"), "tokens").filter(F.size("tokens") > 0)
    freq = Frequencies(sets, share, region, sent)
    counts, source = freq.reader(), freq.sets

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Groups, Posting]]:
        for batch in batches:
            b = banded(batch, share)
            g = groups(b, counts(batch, b))
            for made in first_regions(g, share):
                yield g, made

    def below(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Groups, Posting]]:
            for batch in batches:
                key, meta = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "meta"))
                b = banded(batch, share, (meta >> 56) & 31)
                g = groups(b, counts(batch, b))
                idx = np.flatnonzero(g.meta >> 32 == meta[g.owner] >> 32)  # the group that was in the region
                of = g.owner[idx]
                for made in extended(g, share, key[of], idx, (meta[of] & 0xFFFF) + level - 1, level):
                    yield g, made

        return run

    def sized(rows: DataFrame, made: Callable) -> DataFrame:
        n = rows.mapInArrow(_counting(made), "key long, parent long, n long, closed long")
        return n.groupBy("key").agg(F.sum("n").alias("m"), F.max("closed").alias("closed"), F.max("parent").alias("parent"))

    level, from_, made, out = 2, source, first, []
    hot = stage(sized(from_, made).filter(F.col("m") > region), "hot")
    while True:
        postings = from_.mapInArrow(_writing(made), POSTING)
        if hot.isEmpty():
            out.append(postings.select(*ROW))
            break
        # records of the regions to be divided, with their words
        inside = join_checked(postings, hot.filter("closed = 0").select("key", "m"), ["key"], "m").select("key", "meta", "cid", F.shiftrightunsigned("meta", 62).alias("role"))
        inside = stage(inside, "inside")
        of = stage(inside.select("cid", "role").distinct(), "inside-records")
        deeper = inside.join(semi_join_checked(source, of, ["cid", "role"]), ["cid", "role"])
        deeper = deeper.select("key", "meta", *source.columns)
        split = stage(sized(deeper, below(level)), "split")
        square = F.col("m").cast("double") * F.col("m")
        work = split.groupBy(F.col("parent").alias("key")).agg(F.sum(square).alias("after"))
        pays = (F.col("closed") == 0) & (2 * F.col("after") <= square)
        judged = stage(hot.join(work, "key", "left").select("key", "m", F.coalesce(pays, F.lit(False)).alias("pays")), "judged")
        # regions that are not worth dividing meet in blocks, the others only in their children
        known = join_checked(postings, judged, ["key"], "m", how="left").filter("pays is null or not pays")
        out.append(_blocked(known, region))
        paying = judged.filter("pays").select("key", "m")
        from_, made = join_checked(deeper, paying, ["key"], "m").drop("m"), below(level)
        hot = stage(join_checked(split, paying.withColumnRenamed("key", "parent").withColumnRenamed("m", "of"), ["parent"], "of").filter(F.col("m") > region).drop("of"), "hot")
        level += 1
    return joined(reduce(DataFrame.unionByName, out), share).distinct()


def verified(pairs: DataFrame, texts: DataFrame, share: Share, two: bool) -> DataFrame:
    """(cid_l, cid_r, common, either) of the pairs that hold on the words themselves.

    ``texts``: (cid, role, text), read again for the records that are in a pair.
    """
    sides = {"l": LEFT, "r": RIGHT} if two else {"l": LEFT | RIGHT, "r": LEFT | RIGHT}
    ends = [pairs.select(F.col(f"cid_{side}").alias("cid"), F.lit(role).alias("role")) for side, role in sides.items()]
    wanted = stage(ends[0].unionByName(ends[1]).distinct(), "wanted")
    near = semi_join_checked(texts, wanted, ["cid", "role"]).select("cid", "role", F.array_sort(word_list("text")).alias("words"))
    near = stage(near, "near")
    j = pairs
    for side, role in sides.items():
        j = j.join(near.filter(F.col("role") == role).select(F.col("cid").alias(f"cid_{side}"), F.col("words").alias(f"words_{side}")), f"cid_{side}")
    j = j.withColumn("common", F.size(F.array_intersect("words_l", "words_r"))).withColumn("either", F.size("words_l") + F.size("words_r") - F.col("common"))
    return j.filter(F.col("common") * share.den >= F.col("either") * share.num).select("cid_l", "cid_r", "common", "either")


def with_rows(pairs: DataFrame, copies: DataFrame, two: bool) -> DataFrame:
    """Pairs of classes with ``rows_l`` and ``rows_r``; ``copies``: (cid, role, rows) of classes of several records."""
    for side, role in (("l", LEFT if two else LEFT | RIGHT), ("r", RIGHT if two else LEFT | RIGHT)):
        own = copies.filter(F.col("role") == role).select(F.col("cid").alias(f"cid_{side}"), F.col("rows").alias(f"rows_{side}"))
        pairs = join_checked(pairs, own, [f"cid_{side}"], f"rows_{side}", how="left").withColumn(f"rows_{side}", F.coalesce(f"rows_{side}", F.lit(1)))
    return pairs


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of records; large classes block by block.

    ``pairs``: (cid_l, cid_r, rows_l, rows_r, ...); ``left``: (cid_l, rows_l, id_l, ...)
    and ``right`` alike with the records of the classes.
    """
    blocks = {t: F.ceil(F.col(f"rows_{t}") / BLOCK).cast("int") for t in "lr"}
    split = pairs
    for t in "lr":
        split = split.withColumn(f"block_{t}", F.explode(F.sequence(F.lit(0), blocks[t] - 1)))
    l, r = (side.withColumn(f"block_{t}", F.pmod(F.xxhash64(f"id_{t}"), blocks[t]).cast("int")).drop(f"rows_{t}") for t, side in (("l", left), ("r", right)))
    return split.join(l, ["cid_l", "block_l"]).join(r, ["cid_r", "block_r"]).drop("block_l", "block_r")
