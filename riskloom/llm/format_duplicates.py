"""Problem 2: collapse records that differ only in how they are written down.

Merkle-style hashing of the record's structure, bottom up: a leaf is its letters
and digits in order, regardless of case; an object's digest is the digest of its
sorted child digests (field order does not matter); a list keeps its order.  A
text of two or more named fields (JSON object, or ``name: value`` / ``name =
value`` pieces separated by line break, ``|`` or ``;``) has such a tree; any text
also has the digest of its plain letters and digits.  Two records are the same
when they share either digest; since a copy may share the one with a second and
the other with a third record, a record's root is the least field digest among
the records with its plain digest, closed over by propagation.

After grouping by digest, every group is confirmed on the whole canonical forms.  Beside
each digest goes a second one of the whole form by another function, from the same
pass; only where one digest comes with two of these can it stand for more than one
form.  Then the forms themselves are compared, and the digest is split by the form.

Numbers in JSON are compared as they are written: 1.50 is the leaf 150, as in
``price: 1.50``, and 1e5 is 1e5.

Skew: counts and heads are aggregated map-side; the head of a hot group (more
than a thousandth of all rows) is broadcast, so copies are never gathered.

Defined results: null text and text without letter or digit belong to no group;
broken JSON is plain text; repeated field names stay a multiset; other columns
are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_checked, join_heads, semi_join_checked
from ..plans.staging import stage

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
_PIECE = regex.compile(r"[\r\n|;]+")
_NAMED = regex.compile(r"\s*([\p{L}\p{N}_\-]+)\s*[:=](.*)", regex.S)


_LITERAL = {None: "null", True: "true", False: "false"}


def leaf(s: str) -> str:
    return _NOT_WORD.sub("", s).upper().lower()


def _digest(kind: str, parts: list[bytes]) -> bytes:
    h = hashlib.blake2b(kind.encode(), digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(4, "big"))
        h.update(p)
    return h.digest()


class _Pairs(list):
    """The fields of a JSON object in order, repeated names kept."""


def merkle(value: object) -> tuple[bytes, str]:
    """(digest, canonical form) of a parsed value."""
    if isinstance(value, _Pairs):
        nodes = []
        for k, v in value:
            d, c = merkle(v)
            name = leaf(k)
            nodes.append((_digest("f", [name.encode(), d]), f"{name}={c}"))
        nodes.sort()
        return _digest("o", [d for d, _ in nodes]), "{" + ",".join(c for _, c in nodes) + "}"
    if isinstance(value, list):
        nodes = [merkle(v) for v in value]
        return _digest("l", [d for d, _ in nodes]), "[" + ",".join(c for _, c in nodes) + "]"
    text = leaf(value if isinstance(value, str) else _LITERAL[value])
    return _digest("t", [text.encode("utf-8", "surrogatepass")]), text


def fields(text: str) -> _Pairs | None:
    """The named fields of a text, or None if it has fewer than two."""
    s = text.strip()
    if s.startswith("{"):
        try:
            got = json.loads(s, object_pairs_hook=_Pairs, parse_float=str, parse_int=str, parse_constant=str)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, _Pairs):
            return got if len(got) > 1 else None
    out: list[list[str]] = []
    for piece in _PIECE.split(s):
        if not piece.strip():
            continue
        m = _NAMED.match(piece)
        if m:
            out.append([m[1], m[2]])
        elif out:  # a separator inside a value
            out[-1][1] += piece
        else:
            return None
    return _Pairs((k, v) for k, v in out) if len(out) > 1 else None


def _trees(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        digests, second, forms = [], [], []
        for t in texts:
            got = fields(t) if t else None
            d, c = merkle(got) if got else (None, None)
            digests.append(d.hex() if d else None)
            second.append(int.from_bytes(hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True) if d else None)
            forms.append(c)
        yield pd.DataFrame({"digest": digests, "second": pd.array(second, dtype="Int64"), "form": forms})


def _tree(text: Column) -> Column:
    """Struct (digest, second, form) of the field tree; texts that cannot have one stay in the JVM."""
    maybe = text.rlike(r"^\s*\{") | (text.rlike(r"^[\s|;]*[\p{L}\p{N}_-]+\s*[:=]") & text.rlike(r"[\r\n|;]"))
    return F.pandas_udf(_trees, "digest string, second long, form string")(F.when(maybe, text))


def plain_form(text: Column) -> Column:
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))


def forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, plain, pdigest, psecond, fdigest, fsecond, fform) of every record with a letter or digit."""
    base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t is not null")
    base = base.withColumn("plain", plain_form(F.col("t"))).filter("plain <> ''").withColumn("tree", _tree(F.col("t")))
    second = F.xxhash64(F.lit(7), "plain")
    return base.select("id", "plain", F.md5("plain").alias("pdigest"), second.alias("psecond"), F.col("tree.digest").alias("fdigest"), F.col("tree.second").alias("fsecond"), F.col("tree.form").alias("fform"))


def _roots(digests: DataFrame) -> DataFrame:
    """(pdigest, root) for each plain digest that some record with fields has."""
    edges = stage(digests.filter("fdigest is not null").select("pdigest", "fdigest").distinct(), "p2-edges")
    roots = edges.groupBy("pdigest").agg(F.min("fdigest").alias("root"), F.max("fdigest").alias("_most"))
    if roots.filter("root <> _most").isEmpty():  # no text has two readings: closed already
        return roots.select("pdigest", "root")
    labels = edges.select("fdigest", F.col("fdigest").alias("root")).distinct()
    while True:
        by_plain = edges.join(labels, "fdigest").groupBy("pdigest").agg(F.min("root").alias("root"))
        new = stage(edges.join(by_plain, "pdigest").groupBy("fdigest").agg(F.min("root").alias("root")), "p2-roots")
        if new.join(labels.withColumnRenamed("root", "_old"), "fdigest").filter("root <> _old").isEmpty():
            return by_plain
        labels = new


def _colliding(digests: DataFrame, kind: str) -> DataFrame:
    """Digests that come with more than one second digest."""
    seen = digests.filter(f"{kind}digest is not null").groupBy(F.col(f"{kind}digest").alias("digest"))
    return seen.agg(F.min(f"{kind}second").alias("_lo"), F.max(f"{kind}second").alias("_hi")).filter("_lo <> _hi").select(F.lit(kind).alias("kind"), "digest")


def _confirmed(digests: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests, with those that stand for several forms split by the form."""
    split = stage(_colliding(digests, "p").unionByName(_colliding(digests, "f")), "p2-collisions")
    if split.isEmpty():
        return digests
    for kind in "pf":
        odd = split.filter(F.col("kind") == kind).select(F.col("digest").alias(f"{kind}digest"))
        ids = stage(digests.join(odd, f"{kind}digest", "left_semi").select("id"), "p2-odd")
        again = forms(semi_join_checked(rows.withColumn("id", F.col(id_col)), ids, ["id"]), id_col, text_col)
        form = F.col("plain" if kind == "p" else "fform")
        own = again.filter(form.isNotNull()).select("id", F.concat(f"{kind}digest", F.lit(":"), F.sha2(form, 256), F.length(form)).alias("_own"))
        digests = stage(digests.join(own, "id", "left").withColumn(f"{kind}digest", F.coalesce("_own", f"{kind}digest")).drop("_own"), "p2-digests")
    return digests


def groups(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (id, key) and heads (key, first_id, copies) of all groups, singletons included."""
    digests = stage(forms(rows, id_col, text_col).drop("plain", "fform"), "p2-digests")
    digests = _confirmed(digests, rows, id_col, text_col).select("id", "pdigest", "fdigest")
    total = digests.count()
    roots = _roots(digests)
    sized = roots.join(digests.groupBy("pdigest").agg(F.count(F.lit(1)).alias("_n")), "pdigest")
    rooted = join_heads(digests, sized, ["pdigest"], "_n", total, how="left").select("id", F.coalesce("root", "pdigest").alias("key"))
    members = stage(rooted, "p2-members")
    return members, members.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> DataFrame:
    """(first_id, copy_id): every record but the first of its group."""
    members, heads = groups(rows, id_col, text_col)
    j = join_checked(members, stage(heads.filter("copies > 1"), "p2-heads"), ["key"], "copies")
    return j.filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def collapsed(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text") -> DataFrame:
    """(first_id, copies): one record for each group with the number of its copies."""
    _, heads = groups(rows, id_col, text_col)
    return heads.select("first_id", F.col("copies").cast("long").alias("copies"))
