"""Problem 6: one form for texts that look the same but differ in characters.

Values are mapped in the JVM (look-alike letters to one letter of their class, width
forms, ligatures, Roman numerals and kinds of space to the plain ones, characters
without a glyph removed).  Distinct mapped values are grouped in SQL under the
accent-sensitive, case-sensitive Unicode collation, under which composed and
decomposed accents are equal and letters of different case or accent are not.  Each
class gets its least mapped member as canonical form, which is joined back to the
rows.  The collation is evaluated once for each distinct mapped value; rows know their
value and class by 128-bit hashes.

Letter case, accents and other letters keep texts apart, and so do the number of
spaces and line breaks, punctuation of other shape, and the fonts of the mathematical
alphabets.  A letter with an accent looks like the look-alike of the letter with that
accent (U+0450 like U+00E8).  Nothing is decoded: entities and escapes are shown as
they are written.

Skew: equal values are counted map-side before they are grouped; the canonical form
of a hot class is broadcast (see ``join_heads``), pairs within a class are made in
blocks.

Defined results: null stays null and is in no class; a value without any glyph is
in the class of the empty text; an empty table gives empty results; other columns
are ignored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.skew import join_checked, join_heads, pairs_within
from ..plans.staging import stage

#: Letters without accent and the letter of their class, by alphabet.
#: Composed letters follow from these by Unicode's decompositions.
LOOK_ALIKES = {
    "Latin": {"\u0131": "i", "\u0237": "j", "\u0251": "a", "\u0261": "g", "\u0269": "i", "\u00b5": "\u03bc"},
    "Greek": {
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
        "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    },
    "Cyrillic": {
        "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
        "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κ", "ф": "φ", "Ѳ": "Θ", "Ѱ": "Ψ", "Ѡ": "Ω",
    },
    "Armenian": {"Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o"},
    "Cherokee": {
        "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    },
    "Coptic": {"Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲅ": "Γ", "Ⲡ": "Π", "Ⲫ": "Φ"},
    "Lisu": {
        "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    },
    "Deseret": {"\U0001042c": "o", "\U00010404": "O", "\U0001043d": "c", "\U00010415": "C"},
}
#: Characters without a glyph (as a character class).
INVISIBLE = (
    r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """Character to character, and character to several: LOOK_ALIKES, and by Unicode's own decompositions composed letters, width forms, spaces, Roman numerals and ligatures."""
    plain = {k: v for alphabet in LOOK_ALIKES.values() for k, v in alphabet.items()}
    single, multiple = dict(plain), {}
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1D000)):
        ch = chr(code)
        if unicodedata.category(ch) == "Zs":
            single[ch] = " "
            continue
        tag, _, _ = unicodedata.decomposition(ch).partition(" ")
        whole = unicodedata.normalize("NFKC", ch)
        if tag in ("<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and (unicodedata.category(ch) == "Nl" or len(whole) > 1) and all(unicodedata.category(c)[0] == "L" for c in whole)):
            (single if len(whole) == 1 else multiple)[ch] = whole
        elif tag and tag[0] != "<":
            base, *marks = unicodedata.normalize("NFD", ch)
            if base in plain:
                single[ch] = unicodedata.normalize("NFC", plain[base] + "".join(marks))
    return {k: v for k, v in single.items() if k != v and len(v) == 1}, multiple | {k: v for k, v in single.items() if len(v) > 1}


SINGLE, MULTIPLE = _tables()


def mapped(value: Column) -> Column:
    """The value with every character that has a plainer look-alike replaced."""
    out = F.regexp_replace(value, INVISIBLE, "")
    spelled = out
    for ch, plain in MULTIPLE.items():
        spelled = F.replace(spelled, F.lit(ch), F.lit(plain))
    out = F.when(F.translate(out, "".join(MULTIPLE), "") != out, spelled).otherwise(out)  # a class of so many characters is slow in a pattern
    out = F.translate(out, "".join(SINGLE), "".join(SINGLE.values()))
    return F.when(value.rlike(r"[^\x{9}-\x{D}\x{20}-\x{7E}]"), out).otherwise(value)  # plain ASCII stays


_KEY = ["field", "h1", "h2"]


def looks(rows: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    """(field, id, raw1, raw2, h1, h2, look): hashes of the value as it is and as mapped, and the mapped value."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    m = rows.select(F.col(id_col).alias("id"), one.alias("v")).select("v.field", "id", "v.raw").filter("raw is not null").withColumn("look", mapped(F.col("raw")))
    pair = lambda c, a, b: [F.xxhash64(c).alias(a), F.xxhash64(F.lit(1), c).alias(b)]
    return stage(m.select("field", "id", *pair("raw", "raw1", "raw2"), *pair("look", "h1", "h2"), "look"), "p6-mapped")


def classes(m: DataFrame) -> DataFrame:
    """(field, h1, h2, c1, c2, look, here, members, forms) for each distinct mapped value.

    ``c1``, ``c2`` name its class, ``here`` and ``members`` count the rows of value
    and class; ``forms`` is 1 if all members of the class are the same characters, else more.
    """
    raw = [f(c).alias(f"{tag}_{c}") for c in ("raw1", "raw2") for tag, f in (("lo", F.min), ("hi", F.max))]
    values = m.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("here"), F.first("look").alias("look"), *raw)  # equal hashes, equal texts
    same = Window.partitionBy("field", F.expr("collate(look, 'UNICODE')"))  # variants of one class; copies are counted already
    least = F.min(F.struct("h1", "h2")).over(same)
    forms = F.when((F.min("lo_raw1").over(same) != F.max("hi_raw1").over(same)) | (F.min("lo_raw2").over(same) != F.max("hi_raw2").over(same)), 2).otherwise(1)
    c = values.select(*_KEY, "look", "here", least.alias("c"), F.sum("here").over(same).alias("members"), forms.alias("forms"))
    return stage(c.select(*_KEY, F.col("c.h1").alias("c1"), F.col("c.h2").alias("c2"), "look", "here", "members", "forms"), "p6-classes")


def canonical(rows: DataFrame, fields: list[str], id_col: str = "norm_id") -> DataFrame:
    """(field, id, canonical, members): the one form of every value that is not null."""
    m = looks(rows, fields, id_col)
    c = classes(m)
    form = c.groupBy("field", "c1", "c2").agg(F.min("look").alias("canonical"))
    heads = c.select(*_KEY, "c1", "c2", "here", "members").join(form, ["field", "c1", "c2"]).drop("c1", "c2")
    return join_heads(m.drop("look"), heads, _KEY, "here", m.count()).select("field", "id", "canonical", "members")


def pairs(rows: DataFrame, fields: list[str], id_col: str = "norm_id", block: int = 2048) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: values that look the same and are different characters."""
    m = looks(rows, fields, id_col)
    mixed = stage(classes(m).filter("forms > 1").select(*_KEY, "c1", "c2", "here"), "p6-mixed")
    k = join_checked(m.drop("look"), mixed, _KEY, "here").select("field", "id", "raw1", "raw2", F.xxhash64("field", "c1", "c2").alias("key"), "c1", "c2")
    same = (F.col("raw1_a") == F.col("raw1_b")) & (F.col("raw2_a") == F.col("raw2_b"))
    j = pairs_within(stage(k, "p6-members"), "key", "id", block).filter(~same & (F.col("c1_a") == F.col("c1_b")) & (F.col("c2_a") == F.col("c2_b")) & (F.col("field_a") == F.col("field_b")))
    return j.select(F.col("field_a").alias("field"), "id_a", "id_b")
