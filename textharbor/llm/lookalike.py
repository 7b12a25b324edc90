"""One consistent form for texts that look the same (problem 2).

Strings are exploded to positioned code points, which a broadcast join maps to their decomposition (compatibility forms,
accents, kinds of blank, invisible characters) and, for the comparison form, to the Latin letter they look like. Combining
marks are ordered by class behind their base, the result is recomposed and rebuilt into strings. Only distinct strings
with a character beyond ASCII are exploded: every ASCII character maps to itself, blanks apart.

Two forms come out. ``form`` is for use: widths, blanks, invisible characters and order of accents are settled, and in a
word that mixes scripts the look-alikes follow the word's prevailing script. ``skeleton`` is for comparison: all
look-alikes become Latin, so that texts which look the same have the same skeleton. Letter case, accents and word breaks stay.

Defined results: null stays null; an empty or all-invisible string becomes empty; unassigned code points stay.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textharbor.llm.common import cut, one_per_key, sized

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "ɡ": "g", "ɑ": "a", "ı": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Լ": "L", "Տ": "S", "Օ": "O", "գ": "q", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "ք": "p",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Lower-case forms of look-alike capitals, for text that was lower-cased after the look-alikes came in.
LOWERED = {"β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x", "α": "a", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t"}
#: Characters that one task explodes, about.
TASK_CHARACTERS = 400_000
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def read_confusables(path: str) -> dict[str, str]:
    """Pairs of one character and the one or more it looks like, from a file in the format of Unicode's confusables.txt.

    Only pairs from beyond ASCII to ASCII letters count: these the skeleton needs. Lines that are no pairs are passed over.
    """
    found = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = line.partition("#")[0].split(";")
            try:
                a, b = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
            except ValueError:
                continue
            if len(a) == 1 and a > "\x7f" and b.isascii() and b.isalpha():
                found[a] = b
    return found


def mapping_rows(looks_like: dict[str, str] | None = None) -> list[tuple[str, list[tuple[str, int]], list[tuple[str, int]]]]:
    """(character, its form, its skeleton) of every character beyond ASCII that changes or has a combining class.

    Each form is a list of (character, combining class). The size is bounded by Unicode: some 18,000 rows without Hangul, which
    is left to recomposition. looks_like: the look-alikes, LOOKALIKES if none are given.
    """
    table = LOOKALIKES if looks_like is None else looks_like
    rows = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co"):
            continue
        if kind == "Cf" or cp in _INVISIBLE or (kind == "Cc" and cp != 0x85):
            out = ""
        elif kind[0] == "Z" or cp == 0x85:
            out = " "
        else:
            tag = unicodedata.decomposition(ch).partition(">")[0]
            wide = tag in ("<wide", "<narrow", "<font", "<compat") or not tag.startswith("<")
            out = unicodedata.normalize("NFKD" if wide else "NFD", ch).replace(" ", " ")
        looks = "".join(table.get(c, c) for c in out)
        if out != ch or looks != ch or unicodedata.combining(ch):
            rows.append((ch, [(c, unicodedata.combining(c)) for c in out], [(c, unicodedata.combining(c)) for c in looks]))
    return rows


def mapping(spark: SparkSession, confusables: str | None = None) -> DataFrame:
    part = "array<struct<c:string,class:int>>"
    looks_like = None if confusables is None else LOOKALIKES | read_confusables(confusables)
    return spark.createDataFrame(mapping_rows(looks_like), f"ch string, form {part}, skeleton {part}")


@F.pandas_udf(StringType())
def _recompose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _unmix(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """In words of more than one script, look-alikes of the rarer script become Latin if Latin prevails, else Cyrillic."""
    latin = {v: k for k, v in reversed(list(LOOKALIKES.items())) if "Ѐ" <= k < "԰"}

    def word(w: str) -> str:
        other = sum("Ͱ" <= c < "԰" or c > "԰" and c in LOOKALIKES for c in w)
        plain = sum(c.isalpha() and c < "ɐ" for c in w)
        if not other or not plain:
            return w
        swap = LOOKALIKES if plain + sum(c in LOOKALIKES for c in w if c > "Ͱ") > other + sum(c in latin for c in w) - (plain >= other) else latin
        return unicodedata.normalize("NFC", "".join(swap.get(c, c) for c in unicodedata.normalize("NFD", w)))

    for s in parts:
        yield s.map(lambda x: None if x is None else x if x.isascii() else " ".join(word(w) for w in x.split(" ")))


def _blanks(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", " "), r"[\x00-\x08\x0E-\x1F\x7F]", ""))


def consistent_forms(strings: DataFrame, lowered: bool = False, confusables: str | None = None) -> DataFrame:
    """(s, form, skeleton) of each distinct string of ``strings(s)``. lowered: text that was lower-cased before. confusables: a file of further look-alikes."""
    spark = strings.sparkSession
    distinct = strings.where("s IS NOT NULL").select("s").distinct()
    plain = distinct.where(~F.col("s").rlike(r"[^\x00-\x7F]")).select("s", _blanks(F.col("s")).alias("form"), _blanks(F.col("s")).alias("skeleton"))
    # exploded rows carry a digest, not the string: a long string would be repeated for each of its characters
    rich = cut(distinct.where(F.col("s").rlike(r"[^\x00-\x7F]")).select("s", F.md5("s").alias("id")))
    characters = rich.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("n")).first().n
    spread = rich.repartition(1 + characters // TASK_CHARACTERS, "id")  # by what the explosion makes of it, not by its size now
    points = spread.select("id", F.posexplode(F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("class")))
    points = points.join(F.broadcast(mapping(spark, confusables)), "ch", "left").select("id", "pos", F.coalesce("form", own).alias("form"), F.coalesce("skeleton", own).alias("skeleton"))
    both = F.explode(F.array(*[F.struct(F.lit(w).alias("kind"), F.col(w).alias("parts")) for w in ("form", "skeleton")]))
    parts = points.select("id", "pos", both.alias("x")).select("id", "pos", "x.kind", F.posexplode("x.parts").alias("sub", "part")).select("id", "kind", "pos", "sub", "part.c", "part.class")
    # a mark belongs to the base before it: number the bases, then order each one's marks by class, in place among equals
    base = F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(Window.partitionBy("id", "kind").orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = parts.withColumn("base", base).groupBy("id", "kind").agg(F.sort_array(F.collect_list(F.struct("base", "class", "pos", "sub", "c"))).alias("p"))
    text = ordered.select("id", "kind", F.array_join(F.transform("p", lambda x: x["c"]), "").alias("t"))
    made = text.groupBy("id").agg(*[F.max(F.when(F.col("kind") == w, F.col("t"))).alias(w) for w in ("form", "skeleton")])
    made = rich.join(made.hint("merge"), "id", "left").select("s", *[F.coalesce(w, F.lit("")).alias(w) for w in ("form", "skeleton")])  # nothing is left of invisible strings
    both = plain.unionByName(made.select("s", _unmix(_blanks(_recompose("form"))).alias("form"), _blanks(_recompose("skeleton")).alias("skeleton")))
    if lowered:
        # Greek and Cyrillic lower-case letters that only their capitals explain, in words that are Latin otherwise
        fix = F.translate("skeleton", "".join(LOWERED), "".join(LOWERED.values()))
        mixed = F.col("skeleton").rlike(r"[a-z]") & F.col("s").rlike(r"[Ͱ-ԯ]")
        greek = F.translate("s", "".join(LOWERED), "".join(LOWERED.values()))
        both = both.withColumn("skeleton", F.when(mixed & (greek != F.col("s")) & ~fix.rlike(r"[Ͱ-ԯ]"), fix).otherwise(F.col("skeleton")))
    return both


def same_looking(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (a, b), a < b, of records whose texts have one skeleton but are different strings.

    Distinct strings of one skeleton are paired first, records join afterwards, so that equal strings never meet.
    """
    rows = one_per_key(docs.select(key, text), key).select(F.col(key).alias("k"), F.col(text).alias("s")).where("k IS NOT NULL AND s IS NOT NULL")
    forms = cut(consistent_forms(rows.select("s")).where("skeleton <> ''").select("s", "skeleton"))
    many = forms.groupBy("skeleton").agg(F.count("*").alias("n")).where("n > 1").select("skeleton")
    forms = forms.join(many, "skeleton", "left_semi")
    strings = forms.alias("x").join(forms.withColumnRenamed("s", "t"), "skeleton").where("s < t").select("s", "t")
    strings = sized(cut(strings))
    left = rows.join(strings, "s").select(F.col("k").alias("x"), F.col("t").alias("s"))
    pairs = left.join(rows, "s").select("x", F.col("k").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
