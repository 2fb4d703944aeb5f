"""Label mapping over arrays of external labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import taxonomy as T
from .text import SPACE


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def literal_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def map_label(label: Column, context: Column | None = None) -> Column:
    """Canonical name of one external label; ``unknown`` if there is none or it is null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(label, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")), SPACE, "_")
    got = F.coalesce(F.try_element_at(literal_map(T.ALIAS_OF), name), F.lit(T.UNKNOWN))
    if context is None:
        return got
    sexual = F.lower(context).rlike("|".join(T.SEXUAL_CONTEXT))
    return F.when((name == "obscene") & F.coalesce(sexual, F.lit(False)), F.lit("sexual")).otherwise(got)


def without_safe(labels: Column) -> Column:
    """Distinct labels in order, ``safe`` dropped beside any risk label or ``unknown``."""
    d = F.array_distinct(labels)
    return F.when(F.arrays_overlap(d, literal_list([*T.RISK, T.UNKNOWN])), F.filter(d, lambda x: x != T.SAFE)).otherwise(d)


def map_labels(labels: Column, context: Column | None = None) -> Column:
    """Canonical labels of a record; null or empty gives [unknown]."""
    some = F.coalesce(labels, F.array().cast("array<string>"))
    mapped = without_safe(F.transform(some, lambda x: map_label(x, context)))
    return F.when(F.size(mapped) == 0, literal_list([T.UNKNOWN])).otherwise(mapped)


def coarse_labels(labels: Column) -> Column:
    """harmful_content and sexual, the two labels of the merged head."""
    harmful = F.arrays_overlap(labels, literal_list(T.HARMFUL))
    return F.array_compact(F.array(F.when(harmful, F.lit("harmful_content")), F.when(F.array_contains(labels, "sexual"), F.lit("sexual"))))


def route_labels(labels: Column) -> Column:
    """attack and moderation of a record; safe only if neither; else nothing."""
    attack = F.arrays_overlap(labels, literal_list(["prompt_injection", "jailbreak"]))
    moderation = F.arrays_overlap(labels, literal_list([x for x in T.RISK if x not in T.HEADS["attack"]]))
    both = F.array_compact(F.array(F.when(attack, F.lit("attack")), F.when(moderation, F.lit("moderation"))))
    safe = F.when(F.array_contains(labels, T.SAFE), literal_list([T.SAFE])).otherwise(literal_list([]))
    return F.when(F.size(both) > 0, both).otherwise(safe)


def head_labels(labels: Column, head: str, sources: Column | None = None) -> Column:
    """A record's labels in a head: its risk labels there, else [safe] for a record without any risk, else nothing.

    ``violence`` does not count when every source is ``beavertails``.
    """
    mine = F.filter(labels, lambda x: x.isin([v for v in T.HEADS[head] if v != T.SAFE]))
    if sources is not None and "violence" in T.HEADS[head]:
        only = (F.size(sources) > 0) & F.forall(sources, lambda s: F.coalesce(s == "beavertails", F.lit(False)))
        mine = F.when(only, F.filter(mine, lambda x: x != "violence")).otherwise(mine)
    safe = F.array_contains(labels, T.SAFE) & ~F.arrays_overlap(labels, literal_list(T.RISK))
    return F.when(F.size(mine) > 0, mine).when(safe, literal_list([T.SAFE])).otherwise(literal_list([]))


def multi_hot(labels: Column, names: list[str]) -> Column:
    return F.array(*[F.coalesce(F.array_contains(labels, n), F.lit(False)).cast("double") for n in names])
