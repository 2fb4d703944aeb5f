"""Hashed n-grams of a batch of texts in numpy: buckets and counts equal to ``HashingTF`` over the same n-grams.

For Python workers.  Texts come with white space collapsed, so words are what single
blanks part; character n-grams stand behind ``#``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts, or parts of texts, that are hashed at once, their most bytes, and rows that are added up at once.
PIECE, PIECE_BYTES, ROWS = 512, 1 << 18, 8_192


def murmur3(four: np.ndarray, start: np.ndarray, size: np.ndarray, sharp: bool) -> np.ndarray:
    """Murmur3 (x86, 32 bits, seed 42) of ``size`` bytes from ``start``; ``four[i]``: the bytes i..i+3.  With ``sharp`` a # stands before them."""

    def mixed(k):
        k = k * np.uint32(0xCC9E2D51)
        return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

    def block(k, at):
        if not sharp:
            return four[start[at] + 4 * k]
        return np.where(k == 0, (four[start[at]] << np.uint32(8)) | np.uint32(35), four[start[at] + np.maximum(4 * k - 1, 0)])

    n = size + sharp
    whole = n >> 2
    h = np.full(len(n), 42, np.uint32)
    for k in range(int(whole.max(initial=0))):
        at = np.flatnonzero(whole > k)
        if len(at) == len(n):
            at = slice(None)
        v = h[at] ^ mixed(block(k, at))
        h[at] = ((v << np.uint32(13)) | (v >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= mixed(block(whole, slice(None)) & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[n & 3])
    h ^= n.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of few texts and few bytes: memory for n-grams is a hundred times these."""
    end = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(end, end[i] + PIECE_BYTES, "right")) - 1
        yield i, (i := min(max(j, i + 1), i + PIECE, len(texts)))


ALL, IN_WORD, ACROSS, BEYOND = range(4)


def grams(texts: pa.Array, sizes: tuple[int, int], words: tuple[int, int], buckets: int, kind: int = ALL) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram of ``sizes`` of a kind, and of every word n-gram of ``words``.

    Kinds, by the blanks before the last character: at most the first character
    (``IN_WORD``); some, but the first character is none and none stands before it in
    the text (``ACROSS``); the first character and others (``BEYOND``).
    """
    t = texts.cast(pa.large_string())
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    ends = ends - first
    b = np.zeros(last - first + 8, np.uint8)
    if last > first:
        b[: last - first] = np.frombuffer(t.buffers()[2], np.uint8, last - first, first)
    wide = b.astype(np.uint32)
    four = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    body = b[: last - first]
    row = np.repeat(np.arange(len(t)), np.diff(ends))
    blank = body == 32
    seen = np.append(0, np.cumsum(blank))
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(start, stop, of, sharp):
        rows.append(of)
        out.append(murmur3(four, start, stop - start, sharp).view(np.int32).astype(np.int64) % buckets)

    # characters: a byte that begins one, and where the one n later begins if it is in the text
    begins = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
    for n in range(sizes[0], sizes[1] + 1):
        s, e = begins[:-n], begins[n:]
        if len(s):
            good = e <= ends[1:][row[s]]
            if kind != ALL:
                led, inner = blank[s], seen[begins[n - 1 : -1]] - seen[s]
                good &= inner <= led if kind == IN_WORD else ~led & (inner > 0) & (seen[s] == seen[ends[row[s]]]) if kind == ACROSS else led & (inner > 1)
            add(s[good], e[good], row[s[good]], True)
    # words: from a byte after a blank or the start of the text to the next blank or the end
    part = np.zeros(len(body) + 1, bool)
    part[ends] = True
    starts = np.flatnonzero((part[:-1] | np.append(True, blank[:-1])[: len(body)]) & ~blank)
    stops = np.flatnonzero((part[1:] | np.append(blank[1:], True)[: len(body)]) & ~blank) + 1
    of = row[starts]
    for n in range(words[0], words[1] + 1):
        m = len(starts) - n + 1
        if m > 0:
            same = of[:m] == of[n - 1 :]
            add(starts[:m][same], stops[n - 1 :][same], of[:m][same], False)
    return np.concatenate(rows), np.concatenate(out)


def hashed(texts: pa.Array, words: int, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its buckets in order, their counts, and the bounds of each text in both."""
    row, bucket = grams(texts, (least, most), (1, words), buckets)
    key = row * buckets + bucket
    key = np.sort(key.astype(np.uint32) if len(texts) * buckets < 1 << 32 else key)  # half as wide, twice as fast
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return key % buckets, count, np.searchsorted(key, np.arange(len(texts) + 1) * buckets)


def factored(texts: pa.Array, words: int, least: int, most: int, buckets: int) -> tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The n-grams of many texts as two steps: the number of parts, (text, part) and (part, bucket).

    Parts are the distinct words with the blanks beside them, and the distinct surroundings
    of a blank; what these do not hold is a bucket itself.  Parts under ``buckets`` are
    buckets, the others are counted from there.  Counts of a text are the sums over its
    parts: no n-gram is left out or counted twice.  A few hundred texts are hashed at once.
    """
    blank, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    token = lists.flatten()
    del lists
    same = of[:-1] == of[1:]
    before, after = np.append(False, same)[: len(of)], np.append(same, False)[: len(of)]
    next_to = np.flatnonzero(after)
    text_of, part, part_of, bucket = [of], [], [], []
    parts = buckets

    def add(own: pa.Array, sizes: tuple[int, int], single: tuple[int, int], kind: int) -> None:
        for i, j in pieces(own):
            x, y = grams(own.slice(i, j - i), sizes, single, buckets, kind)
            part_of.append((x + (parts + i)).astype(np.int32))
            bucket.append(y.astype(np.int32))

    # words: with the blanks beside them; a single blank belongs to the word before it
    coded = pc.dictionary_encode(token)
    word, own = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, which = np.unique(own * 4 + before * 2 + after, return_inverse=True)
    base, sides = word.take(pa.array(kinds >> 2)), [np.where(kinds & x, " ", "") for x in (2, 1)]
    left, right = (pa.array(x, pa.large_string()) for x in sides)
    ended = pc.binary_join_element_wise(base, right, nothing)
    add(pc.binary_join_element_wise(left, ended, nothing), (max(least, 2), most), (1, 1), IN_WORD)
    if least < 2:
        add(ended, (1, 1), (1, 0), IN_WORD)
    part.append((which + parts).astype(np.int32))
    parts += len(kinds)
    # surroundings of a blank: the end of the word before it, and what follows it in the text
    reach = max(most - 2, 0)
    if reach and len(next_to):
        tail = pc.dictionary_encode(pc.utf8_slice_codeunits(word, -reach))
        ahead = pc.utf8_slice_codeunits(word, 0, reach).take(coded.indices)
        short = np.flatnonzero((pc.utf8_length(word).to_numpy(zero_copy_only=False) < reach)[own] & after)
        begun = token.take(pa.array(short))
        for _ in range(reach if len(short) else 0):
            longer = pc.utf8_slice_codeunits(pc.binary_join_element_wise(begun, ahead.take(pa.array(short + 1)), blank), 0, reach)
            mask = np.zeros(len(token), bool)
            mask[short] = True
            ahead = pc.replace_with_mask(ahead, pa.array(mask), longer)
        head = pc.dictionary_encode(ahead)
        tails, heads = tail.indices.to_numpy(zero_copy_only=False).astype(np.int64), head.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, which = np.unique(tails[own[next_to]] * len(head.dictionary) + heads[next_to + 1], return_inverse=True)
        add(pc.binary_join_element_wise(tail.dictionary.take(pa.array(pair // len(head.dictionary))), head.dictionary.take(pa.array(pair % len(head.dictionary))), blank), (least, most), (1, 0), ACROSS)
        text_of.append(of[next_to])
        part.append((which + parts).astype(np.int32))
        parts += len(pair)
    for i, j in pieces(texts):
        x, y = grams(texts.slice(i, j - i), (least, most), (2, words), buckets, BEYOND)
        text_of.append(x + i)
        part.append(y.astype(np.int32))
    every = lambda x: np.concatenate([y.astype(np.int32) for y in x]) if x else np.zeros(0, np.int32)
    return parts, (every(text_of), every(part)), (every(part_of), every(bucket))


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0, by their halves: numpy sorts 16 bits by counting."""
    a = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return a[np.argsort((x >> 16).astype(np.uint16)[a], kind="stable")] if x.max(initial=0) >> 16 else a


def grouped(owner: np.ndarray, member: np.ndarray) -> dict[str, np.ndarray]:
    """Members by owner, for ``add_up``: owners in the order of how many members they have, each such number and its owners, the members in that order."""
    count = np.bincount(owner)
    ids = np.flatnonzero(count)
    ids = ids[np.argsort(count[ids], kind="stable")]
    size, owners = np.unique(count[ids], return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[ids] = np.arange(len(ids))
    return {"ids": ids, "size": size, "owners": owners, "members": member[_order(rank[owner])]}


def add_up(out: np.ndarray, values: np.ndarray, ids: np.ndarray, size: np.ndarray, owners: np.ndarray, members: np.ndarray) -> None:
    """Set the row of ``out`` of each owner to the sum of its members' rows of ``values``."""
    room, at, done = np.empty((ROWS, values.shape[1])), 0, 0
    for k, n in zip(size.tolist(), owners.tolist(), strict=True):
        if k > ROWS:
            for own in ids[done : done + n]:
                out[own] = sum(values.take(members[i : min(i + ROWS, at + k)], 0, mode="clip").sum(0) for i in range(at, at + k, ROWS))
                at += k
        else:
            step = ROWS // k
            for i in range(0, n, step):
                m = min(step, n - i)
                got = values.take(members[at : at + m * k], 0, room[: m * k], "clip")
                out[ids[done + i : done + i + m]] = got if k == 1 else np.einsum("ijk->ik", got.reshape(m, k, -1))
                at += m * k
        done += n
