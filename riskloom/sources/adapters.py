"""Adapters: DataFrames of external datasets to (text, labels, source).

Each adapter is a projection and a filter over the columns that are there; rows
without text are dropped.  Labels are still external; ``map_labels`` comes later.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from .. import taxonomy as T
from ..functions.labels import literal_list
from ..functions.rules import weak_labels
from ..functions.text import strip
from .scan import TEXT_KEYS


def _col(df: DataFrame, name: str) -> Column:
    """The column, or null if the dataset lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)


def _string(df: DataFrame, name: str) -> Column:
    c = _col(df, name).cast("string")
    return F.lower(c) if name in df.columns and isinstance(df.schema[name].dataType, ty.BooleanType) else c


def first_text(df: DataFrame, *before: str) -> Column:
    """The first column with a text that is not blank; ``before`` are tried first."""
    cols = [c for c in [*before, *TEXT_KEYS] if c in df.columns and isinstance(df.schema[c].dataType, ty.StringType)]
    return F.coalesce(*[F.when(strip(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in cols]) if cols else F.lit(None).cast("string")


def _out(df: DataFrame, source: str, text: Column, labels: Column) -> DataFrame:
    """Rows with text and labels; null labels drop a row."""
    return df.select(text.alias("text"), labels.alias("labels"), F.lit(source).alias("source")).filter((strip(F.col("text")) != "") & F.col("labels").isNotNull())


def _one(label: str | Column) -> Column:
    return F.array(F.lit(label) if isinstance(label, str) else label)


def prompt_injection(df: DataFrame, source: str) -> DataFrame:
    """1 / injection: prompt_injection; 0 / legit / safe / null: safe; any other label stays."""
    s = _string(df, "label")
    lab = F.when(s.isin("1", "1.0", "true", "injection", "INJECTION"), "prompt_injection").when(s.isNull() | s.isin("0", "0.0", "false", "legit", "safe"), T.SAFE).otherwise(s)
    return _out(df, source, first_text(df), _one(lab))


def rogue_injection(df: DataFrame, source: str) -> DataFrame:
    """Unknown labels drop the row."""
    s = F.trim(F.lower(_string(df, "label")))
    lab = F.when(s.isin("benign", "safe", "0", "false"), T.SAFE).when(s.isin("jailbreak", "injection", "prompt_injection", "1", "true", "malicious", "attack"), "prompt_injection")
    return _out(df, source, first_text(df), F.when(lab.isNotNull(), _one(lab)))


def jailbreak(df: DataFrame, source: str) -> DataFrame:
    """``type`` where there is one, else ``label``; neither: jailbreak."""
    s = F.lower(_string(df, "type" if "type" in df.columns else "label"))
    lab = F.when(s.isNull() | F.contains(s, F.lit("jailbreak")) | s.isin("1", "true"), "jailbreak").when(s.isin("benign", "safe", "0", "false"), T.SAFE).otherwise(s)
    return _out(df, source, first_text(df), _one(lab))


def salad(df: DataFrame, source: str) -> DataFrame:
    return _out(df, source, first_text(df, "augq", "attack"), literal_list(["prompt_injection", "jailbreak"]))


def xstest(df: DataFrame, source: str) -> DataFrame:
    """Types with ``safe`` in them (``unsafe`` too) are safe unless they start with ``contrast``; others unknown."""
    s = F.coalesce(F.lower(_string(df, "type")), F.lit("none" if "type" in df.columns else ""))
    safe = F.startswith(s, F.lit("safe")) | (~F.startswith(s, F.lit("contrast")) & F.contains(s, F.lit("safe")))
    return _out(df, source, first_text(df), _one(F.when(safe, T.SAFE).otherwise(T.UNKNOWN)))


def _at_least(df: DataFrame, cols: list[str], least: float = 0.5) -> Column:
    """Names of the columns whose value is at least ``least``."""
    return F.array_compact(F.array(*[F.when(F.coalesce(_col(df, c).cast("double"), F.lit(0.0)) >= least, F.lit(c)) for c in cols]))


def _or_safe(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, labels).otherwise(literal_list([T.SAFE]))


def jigsaw(df: DataFrame, source: str) -> DataFrame:
    cols = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
    return _out(df, source, first_text(df, "comment_text"), _or_safe(_at_least(df, cols)))


def toxicchat(df: DataFrame, source: str) -> DataFrame:
    is1 = lambda c: F.coalesce(_col(df, c).cast("int"), F.lit(0)) == 1
    labels = F.array_compact(F.array(F.when(is1("toxicity"), F.lit("toxicity")), F.when(is1("jailbreaking"), F.lit("jailbreak"))))
    return _out(df, source, first_text(df, "user_input"), _or_safe(labels))


def toxigen(df: DataFrame, source: str) -> DataFrame:
    lab = _col(df, "prompt_label" if "prompt_label" in df.columns else "label").cast("int")
    return _out(df, source, first_text(df, "generation", "text"), F.when(F.coalesce(lab, F.lit(0)) == 1, literal_list(["hate", "toxicity"])).otherwise(literal_list([T.SAFE])))


def _true_keys(df: DataFrame, path: list[str]) -> Column:
    """Keys of a nested map or struct of booleans whose value is true."""
    kind, c = df.schema[path[0]].dataType, F.col(f"`{path[0]}`")
    for p in path[1:]:
        kind, c = kind[p].dataType, c[p]
    if isinstance(kind, ty.MapType):
        return F.map_keys(F.map_filter(c, lambda k, v: F.coalesce(v, F.lit(False))))
    return F.array_compact(F.array(*[F.when(c[f.name], F.lit(f.name)) for f in kind.fields]))


def moderation_410k(df: DataFrame, source: str) -> DataFrame:
    """Categories that are exactly true in ``moder`` (or ``moderation``); none: safe."""
    top = next((c for c in ("moder", "moderation") if c in df.columns), None)
    labels = F.coalesce(_true_keys(df, [top, "categories"]), literal_list([])) if top else literal_list([])
    return _out(df, source, first_text(df), _or_safe(labels))


# Subcategories, the first that is part of the name wins.
WILDGUARD = {
    "toxic_language_hate_speech": ["hate", "toxicity"],
    "social_stereotypes_and_unfair_discrimination": ["hate"],
    "violence_and_physical_harm": ["violence"],
    "sexual_content": ["sexual"],
    "mental_health": ["self_harm"],
    "fraud_assisting_illegal_activities": ["illegal_activity"],
    "copyright_violations": ["illegal_activity"],
    "private_information": ["illegal_activity"],
    "sensitive_information_organization_government": ["dangerous_information"],
    "cyberattack": ["dangerous_information"],
    "defamation": ["harassment"],
}
# Categories and their labels.
BEAVERTAILS = {
    "animal_abuse": "violence",
    "child_abuse": "sexual",
    "controversial_topics,politics": "unknown",
    "discrimination,stereotype,injustice": "hate",
    "drug_abuse,weapons,banned_substance": "dangerous_information",
    "financial_crime,property_crime,theft": "illegal_activity",
    "hate_speech,offensive_language": "hate",
    "misinformation_regarding_ethics,laws_and_safety": "unknown",
    "non_violent_unethical_behavior": "unknown",
    "privacy_violation": "illegal_activity",
    "self_harm": "self_harm",
    "sexually_explicit,adult_content": "sexual",
    "terrorism,organized_crime": "illegal_activity",
    "violence,aiding_and_abetting,incitement": "violence",
}
# Kinds of harm, the first that is part of the name wins.
DO_NOT_ANSWER = {
    "information hazards": ["dangerous_information"],
    "malicious uses": ["illegal_activity"],
    "discrimination, stereotype, injustice": ["hate"],
    "human trafficking": ["illegal_activity"],
    "financial crime": ["illegal_activity"],
    "privacy violation": ["illegal_activity"],
    "mental health or self-harm": ["self_harm"],
    "self-harm": ["self_harm"],
    "violence": ["violence"],
    "hate speech": ["hate"],
    "adult content": ["sexual"],
    "terrorism": ["illegal_activity"],
    "weapons": ["dangerous_information"],
}


def _first_part(value: Column, table: dict[str, list[str]]) -> Column:
    """Labels of the first key that is part of the value, else null."""
    return F.coalesce(*[F.when(F.contains(value, F.lit(k)), literal_list(v)) for k, v in table.items()])


def wildguard(df: DataFrame, source: str) -> DataFrame:
    """unharmful: safe; not harmful: dropped; else by subcategory, or unknown."""
    harm = F.trim(F.lower(_string(df, "prompt_harm_label")))
    sub = F.coalesce(F.trim(F.lower(_string(df, "subcategory"))), F.lit(""))
    labels = F.when(harm == "unharmful", literal_list([T.SAFE])).when(harm == "harmful", F.coalesce(_first_part(sub, WILDGUARD), literal_list([T.UNKNOWN])))
    return _out(df, source, first_text(df, "prompt"), labels)


def beavertails(df: DataFrame, source: str) -> DataFrame:
    """Safe rows are dropped; true categories by table, distinct in order, or unknown."""
    keys = F.coalesce(_true_keys(df, ["category"]), literal_list([])) if "category" in df.columns else literal_list([])
    table = F.create_map(*[F.lit(x) for kv in BEAVERTAILS.items() for x in kv])
    labels = F.array_distinct(F.array_compact(F.transform(keys, lambda k: F.try_element_at(table, k))))
    labels = F.when(F.size(labels) > 0, labels).otherwise(literal_list([T.UNKNOWN]))
    return _out(df, source, first_text(df, "prompt"), F.when(~F.coalesce(_col(df, "is_safe").cast("boolean"), F.lit(False)), labels))


def aegis(df: DataFrame, source: str) -> DataFrame:
    """Votes labels_0..4 without none / other / blank: none at all, or most for intervention: dropped; else safe."""
    votes = F.filter(F.array(*[F.coalesce(F.trim(F.lower(_string(df, f"labels_{i}"))), F.lit("")) for i in range(5)]), lambda v: ~v.isin("none", "other", ""))
    bad = F.size(F.filter(votes, lambda v: F.contains(v, F.lit("intervention"))))
    return _out(df, source, first_text(df), F.when((F.size(votes) > 0) & (2 * bad <= F.size(votes)), literal_list([T.SAFE])))


def do_not_answer(df: DataFrame, source: str) -> DataFrame:
    harm = F.coalesce(F.trim(F.lower(_string(df, "types_of_harm"))), F.lit(""))
    return _out(df, source, first_text(df, "question"), F.coalesce(_first_part(harm, DO_NOT_ANSWER), literal_list([T.SAFE])))


def harmful_prompts(df: DataFrame, source: str) -> DataFrame:
    t = first_text(df)
    return _out(df, source, t, weak_labels(t))


def _first_turns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def first(s: str | None) -> str | None:
        try:
            got = ast.literal_eval(s) if s else None
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            return None
        return got[0] if isinstance(got, list) and got and isinstance(got[0], str) else None

    for texts in batches:
        yield pd.Series([first(s) for s in texts], dtype="object")


def sorry_bench(df: DataFrame, source: str) -> DataFrame:
    """The first turn (a list, or a list written as text), else the first text; labels by keyword, else unknown."""
    turn = F.lit(None).cast("string")
    if "turns" in df.columns:
        if isinstance(df.schema["turns"].dataType, ty.ArrayType):
            turn = F.get("turns", F.lit(0))
        else:
            turn = F.pandas_udf(_first_turns, "string")(F.when(F.startswith(F.trim("turns"), F.lit("[")), F.col("turns")))
    d = df.withColumn("_turn", turn).withColumn("_text", F.coalesce(F.when(F.col("_turn") != "", F.col("_turn")), first_text(df)))
    return _out(d, source, F.col("_text"), weak_labels(F.col("_text")))


def generic(df: DataFrame, source: str) -> DataFrame:
    """``labels`` as a list or separated by commas, else ``label``, else safe."""
    single = _string(df, "label")
    base = F.when(single.isNotNull(), _one(single)).otherwise(literal_list([T.SAFE]))
    if "labels" in df.columns:
        many = F.col("labels") if isinstance(df.schema["labels"].dataType, ty.ArrayType) else F.filter(F.transform(F.split("labels", ","), lambda x: strip(x)), lambda x: x != "")
        base = F.coalesce(many.cast("array<string>"), base)
    return _out(df, source, first_text(df), base)


def civil_route(df: DataFrame, source: str = "civil") -> DataFrame:
    """moderation if any toxicity column is at least a half, else safe."""
    cols = ["toxicity", "identity_attack", "insult", "threat", "sexual_explicit", "severe_toxicity", "obscene"]
    return _out(df, source, first_text(df), F.when(F.size(_at_least(df, cols)) > 0, literal_list(["moderation"])).otherwise(literal_list([T.SAFE])))


def civil_labels(df: DataFrame, source: str = "civil") -> DataFrame:
    """The columns' canonical labels, distinct in order; none: safe."""
    table = {"toxicity": "toxicity", "identity_attack": "hate", "insult": "harassment", "threat": "violence", "sexual_explicit": "sexual"}
    hit = F.array_compact(F.array(*[F.when(F.coalesce(_col(df, c).cast("double"), F.lit(0.0)) >= 0.5, F.lit(v)) for c, v in table.items()]))
    return _out(df, source, first_text(df), _or_safe(F.array_distinct(hit)))


# Words of binary labels.
_POSITIVE = ["inject", "injection", "prompt_injection", "attack", "jailbreak", "malicious", "unsafe", "harmful", "true", "1", "yes", "positive"]
_NEGATIVE = ["safe", "benign", "legit", "clean", "normal", "harmless", "none", "false", "0", "no", "negative"]


def to_binary(value: Column, build: bool = True) -> Column:
    """0, 1 or null of a label of any spelling: numbers by 0.5, exact words, then positive parts before negative ones.

    Two variants: in building data ``none`` is 0, ``null`` is null and ``positive`` /
    ``negative`` are exact words; in evaluation ``none`` is null.
    """
    s = F.lower(F.trim(value.cast("string")))
    num = s.try_cast("double")
    empty, one, zero = (["", "nan", "null"], ["true", "yes", "positive"], ["false", "no", "negative"]) if build else (["", "nan", "none"], ["true", "yes"], ["false", "no"])
    return (
        F.when(s.isNull() | s.isin(*empty), F.lit(None).cast("int")).when(s.isin(*one), 1).when(s.isin(*zero), 0)
        .when(num.isNotNull(), (num >= 0.5).cast("int")).when(s.rlike("|".join(_POSITIVE)), 1).when(s.rlike("|".join(_NEGATIVE)), 0)
    )


Adapter = Callable[[DataFrame, str], DataFrame]
ADAPTERS: dict[str, Adapter] = {f.__name__: f for f in (
    prompt_injection, rogue_injection, jailbreak, salad, xstest, jigsaw, toxicchat, toxigen, moderation_410k, wildguard, beavertails, aegis, do_not_answer, harmful_prompts, sorry_bench, generic, civil_route, civil_labels,
)}


def adapt(df: DataFrame, kind: str, source: str) -> DataFrame:
    """Apply the adapter of this kind; unknown kinds are generic."""
    return ADAPTERS.get(kind, generic)(df, source)
