"""Japanese text as column expressions: moras, syllables, vowels, phonemes and comparison keys stay on the JVM side."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The syllabary, its irregular consonants, small kana and obsolete kana.
ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ"}
OTHERS = {"ヤ": ("y", "a"), "ユ": ("y", "u"), "ヨ": ("y", "o"), "ワ": ("w", "a"), "ヲ": ("", "o"), "ヴ": ("v", "u")}
IRREGULAR = {"シ": "sh", "チ": "ch", "ツ": "ts", "フ": "f", "ジ": "j", "ヂ": "j"}
SMALL = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "a", "ュ": "u", "ョ": "o", "ヮ": "a"}
ALONE = dict(zip("ァィゥェォャュョヮヵヶ", "アイウエオヤユヨワカケ", strict=True))
OBSOLETE = {"ヰ": "イ", "ヱ": "エ", "ヷ": "ヴァ", "ヸ": "ヴィ", "ヹ": "ヴェ", "ヺ": "ヴォ"}
SPECIAL = "ンッー"

BASE = {k: (c, v) for c, row in ROWS.items() for k, v in zip(row, "aiueo", strict=True)} | OTHERS
_BASES, _SMALLS = "".join(BASE), "".join(SMALL)
MORA = f"[{_BASES}][{_SMALLS}]?|."
#: A mora that begins a syllable with the long marks, closures and nasals that follow it.
SYLLABLE = f"(?:[{_BASES}][{_SMALLS}]?|.)[{SPECIAL}]*"
ALLOWED = f"^[{_BASES}{_SMALLS}ヵヶ{SPECIAL}]*$"


def sound(mora: str) -> tuple[str, str]:
    """(consonant, vowel) of one mora; the nasal is N, the closure q, the long mark has neither."""
    if mora in ("ン", "ッ", "ー"):
        return {"ン": ("N", ""), "ッ": ("q", ""), "ー": ("", "")}[mora]
    head = ALONE.get(mora, mora[0]) if len(mora) == 1 else mora[0]
    consonant, vowel = BASE[head]
    consonant = IRREGULAR.get(head, consonant)
    if len(mora) == 2:
        vowel = SMALL[mora[1]]
        if mora[1] in "ャュョ" and consonant and consonant not in ("sh", "ch", "j"):
            consonant += "y"
    return consonant, vowel


def sounds() -> dict[str, tuple[str, str]]:
    """All moras' sounds, built by the rule."""
    singles = [*BASE, *ALONE, "ン", "ッ", "ー"]
    return {m: sound(m) for m in singles} | {b + s: sound(b + s) for b in BASE for s in SMALL}


def katakana(text: Column) -> Column:
    """Hiragana as katakana; NFKC has to come first where the text may hold compatibility characters."""
    return F.translate(text, "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7))))


def normalize_reading(text: Column) -> Column:
    """Katakana without white space and obsolete kana; null where another character is left."""
    kana = F.regexp_replace(katakana(text), r"\s+", "")
    for old, new in OBSOLETE.items():
        kana = F.replace(kana, F.lit(old), F.lit(new))
    return F.when(kana.rlike(ALLOWED), kana)


def moras(kana: Column) -> Column:
    return F.regexp_extract_all(kana, F.lit(MORA), F.lit(0))


def syllables(kana: Column) -> Column:
    return F.regexp_extract_all(kana, F.lit(SYLLABLE), F.lit(0))


def _lookup(mora: Column, part: int) -> Column:
    table = [F.lit(x) for m, s in sounds().items() for x in (m, s[part])]
    return F.try_element_at(F.create_map(*table), mora)


def vowels(kana: Column) -> Column:
    """The vowels of a reading in order, without those of long marks, nasals and closures."""
    return F.filter(F.transform(moras(kana), lambda m: _lookup(m, 1)), lambda v: v != "")


def phonemes(kana: Column) -> Column:
    """Consonants and vowels in order; a long mark repeats the vowel before it, `a` at the beginning."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("a").alias("vowel"))

    def step(acc: Column, m: Column) -> Column:
        c, v = _lookup(m, 0), _lookup(m, 1)
        v = F.when(m == "ー", acc["vowel"]).otherwise(v)
        new = F.filter(F.array(c, v), lambda x: x != "")
        return F.struct(F.concat(acc["out"], new).alias("out"), F.when(v != "", v).otherwise(acc["vowel"]).alias("vowel"))

    return F.aggregate(moras(kana), zero, step, lambda acc: acc["out"])


def role(symbol: Column) -> Column:
    """The role of a phoneme."""
    return F.when(symbol == "N", "nasal").when(symbol == "q", "closure").when(symbol.isin("a", "i", "u", "e", "o"), "vowel").otherwise("consonant")


def strip_ruby(text: Column) -> Column:
    return F.regexp_replace(text, "[|｜]([^《|｜]+)《[^》]+》", "$1")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def recognized(text: pd.Series) -> pd.Series:
    """NFKC, case folded, without punctuation and separators."""

    def one(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if unicodedata.category(c)[0] not in "PZ")

    return text.map(one)


def latin_only(text: Column) -> Column:
    """At least one letter, and all letters Latin."""
    return text.rlike(r"\p{L}") & text.rlike(r"^[\P{L}\p{IsLatin}]*$")


def repeat_unit(text: Column, most: int = 16) -> Column:
    """Largest number of equal parts, up to `most`, that a text falls into."""
    n = F.length(text)
    counts = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: (n % k == 0) & (n >= k) & (F.repeat(F.substring(text, F.lit(1), (n / k).cast("int")), k) == text))
    return F.coalesce(F.array_max(counts), F.lit(1))
