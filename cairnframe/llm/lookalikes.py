"""Text that reads the same in different characters: one consistent form per class."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairnframe.functions.exec import BROADCAST_ROWS, cut, sized

# Letters of other scripts with the shape of a Latin letter, where fonts agree.
SAME_SHAPE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Һ": "h", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "У": "Y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "ı", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Cherokee
    "օ": "o", "Տ": "S", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "Ꭺ": "A", "Ꭼ": "E", "Ꮇ": "M", "Ꮋ": "H", "Ꮖ": "I",
    "Ꮲ": "P", "Ꮯ": "C", "Ꭲ": "T", "Ꮓ": "Z", "Ꮪ": "S", "Ꮶ": "K", "Ꮮ": "L", "Ꮩ": "V", "Ꭻ": "J", "Ᏼ": "B", "Ꮐ": "G",
}
# Signs with the shape of a hyphen, and characters beside the format characters that show nothing.
HYPHENS = "‐‑﹣－"
NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that show a sign.
SHOWN = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"


#: Scripts (first words of their letters' names) of which every letter counts that Unicode's data of confusable
#: characters gives the shape of a Latin letter; of Cyrillic, Greek and Armenian only SAME_SHAPE counts.
SHAPED_SCRIPTS = (
    "CARIAN", "CHEROKEE", "COPTIC", "DESERET", "ELBASAN", "LISU", "LYCIAN", "MIAO", "OLD", "OSAGE", "RUNIC", "TIFINAGH", "WARANG",
)


def confusables(spark: SparkSession) -> dict[str, str]:
    """The letters of SHAPED_SCRIPTS with the shape of a Latin letter, by the data of the library that Spark's collations use.

    A letter counts if it alone of its script has that shape, as two letters of one script never read the same.
    """
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [c for c in map(chr, range(0x370, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.name(c, "?").split()[0] in SHAPED_SCRIPTS]
    shapes = skeletons.getSkeleton("\n".join(letters)).split("\n")
    latin = {skeletons.getSkeleton(x): x for x in string.ascii_letters if x != "I"}  # I and l are one there
    found: dict[tuple[str, str], list[str]] = {}
    for letter, shape in zip(letters, shapes):
        if shape in latin:
            as_ = "I" if latin[shape] == "l" and unicodedata.category(letter) != "Ll" else latin[shape]
            found.setdefault((unicodedata.name(letter).split()[0], as_), []).append(letter)
    return {c[0]: as_ for (_, as_), c in found.items() if len(c) == 1}


@cache
def table() -> dict[str, str]:
    """Every character that another stands for, and '' for those that show nothing; made by rule from Unicode data, in the
    driver of a running session."""
    out: dict[str, str] = confusables(SparkSession.active())
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" and ch not in SHOWN or ch in NOTHING or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out[ch] = ""
        elif kind == "Cc" and ch not in "\t\n\r\v\f\x85":
            out[ch] = ""
        elif kind == "Zs" and code != 0x1680:
            out[ch] = " "
        elif ch in HYPHENS:
            out[ch] = "-"
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            out[ch] = chr(int(unicodedata.decomposition(ch).split()[1], 16))
    del out[" "]
    shapes = dict(SAME_SHAPE)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # composed letters on a base of the same shape
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in SAME_SHAPE:
            whole = unicodedata.normalize("NFC", SAME_SHAPE[parts[0]] + parts[1:])
            if len(whole) == 1:
                shapes[chr(code)] = whole
    out |= shapes
    return {k: "".join(shapes.get(x, x) for x in v) for k, v in out.items()}


class Translation(dict):
    """A table for str.translate that also holds the characters met that stand for themselves, as a miss costs more."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


@cache
def translation() -> Translation:
    """What every character reads as; what it stands for may itself stand for another."""
    t = table()
    return Translation({ord(k): "".join(t.get(c, c) for c in v) for k, v in t.items()})


def visual_form(text: str | None, t: Translation | None = None) -> str | None:
    """The consistent form of one text: composed, without invisible characters, look-alikes replaced."""
    if text is None or text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(t or translation()))


def visual_form_column(text: Column) -> Column:
    """visual_form in Arrow batches; the table is made once, on the driver, and goes along (about a thousand entries)."""
    t = Translation(translation())

    @F.pandas_udf(StringType())
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: visual_form(x, t), na_action="ignore")

    return form(text)


def reading_key(text: Column) -> Column:
    """The consistent form, for which only texts with other than printable ASCII characters go to Python: equal texts
    read the same."""
    other = text.rlike(r"[^\x20-\x7e]")
    return F.when(other, visual_form_column(F.when(other, text))).otherwise(text)


_CLASSES = """
    WITH classes AS (
        SELECT g, min(t) AS canonical, count(*) AS spellings, min(k) AS least, max(k) AS most
        FROM {members} GROUP BY g, k COLLATE UNICODE
    )
    SELECT m.g, m.t, m.k, c.canonical, c.spellings, c.least = c.most AS exact
    FROM {members} m JOIN classes c ON m.g = c.g AND m.k COLLATE UNICODE = c.least COLLATE UNICODE
"""


def spellings(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, text, canonical, spellings): every text that shares its group with another that reads the same.

    Candidates are found by the hash of their consistent form: of a group's form only the least and the greatest hash of
    its texts are kept, so that longs cross the shuffle and a group with a third of all rows is spread by its forms.
    Where they differ, there are several spellings. The candidates' consistent forms are then grouped
    under the accent-sensitive collation UNICODE in SQL; a class's least text in code point order is canonical, and it
    is joined back to the members with the class's number of texts. As a check, a class whose forms aren't one code
    point for code point (the collation weighs some letters alike) is divided by its forms.
    """
    keyed = rows.select(F.col(group).alias("g"), F.col(text).alias("t")).where(F.col(text).isNotNull() & F.col(group).isNotNull())
    keyed = keyed.withColumn("k", reading_key(F.col("t"))).withColumn("h", F.xxhash64("k"))
    hashes = keyed.select("g", "h", F.xxhash64("t").alias("own")).groupBy("g", "h").agg(F.min("own").alias("least"), F.max("own").alias("most"))
    several = cut(hashes.where(F.col("least") != F.col("most")).select("g", "h"))
    members = cut(keyed.join(sized(several, BROADCAST_ROWS), ["g", "h"]).select("g", "t", "k").distinct())
    found = rows.sparkSession.sql(_CLASSES, members=members)
    parted = found.where("NOT exact").select("g", "t", "k")
    again = parted.groupBy("g", "k").agg(F.min("t").alias("canonical"), F.count(F.lit(1)).alias("spellings")).where(F.col("spellings") > 1)
    parted = parted.join(again, ["g", "k"])
    out = found.where("exact").select("g", "t", "canonical", "spellings").unionByName(parted.select("g", "t", "canonical", "spellings"))
    return out.select(F.col("g").alias(group), F.col("t").alias(text), "canonical", "spellings")


def reading_classes(entries: DataFrame) -> DataFrame:
    """(scan_id, rel_path, canonical, links): the paths that read like others of their scan, with their class and the number
    of others in it. Pairs are those of a class's paths; edges as in same_reading_pairs."""
    return spellings(entries, "scan_id", "rel_path").select("scan_id", "rel_path", "canonical", (F.col("spellings") - 1).alias("links"))


def same_reading_pairs(entries: DataFrame) -> DataFrame:
    """(scan_id, rel_path_a, rel_path_b): different paths of one scan that read the same, a before b by code points.

    Repeated rows count once; NULL scan_id or rel_path have no pairs; an empty path reads as '' only; other columns are
    ignored; an empty table gives no rows. The classes of reading_classes meet themselves; adaptive execution splits a
    large one.
    """
    s = cut(reading_classes(entries))
    a = s.select("scan_id", "canonical", F.col("rel_path").alias("rel_path_a"))
    b = s.select("scan_id", "canonical", F.col("rel_path").alias("rel_path_b"))
    pairs = a.join(b, ["scan_id", "canonical"]).where(F.col("rel_path_a") < F.col("rel_path_b"))
    return pairs.select("scan_id", "rel_path_a", "rel_path_b")


def consistent_paths(entries: DataFrame) -> DataFrame:
    """(scan_id, rel_path, canonical, form): every path with its scan's canonical spelling and its consistent form.

    form is equal for two paths exactly if they read the same, over all scans; canonical is the path itself where the
    scan has no second spelling.
    """
    rows = entries.select("scan_id", "rel_path").distinct()
    members = spellings(entries, "scan_id", "rel_path")
    joined = rows.join(members, ["scan_id", "rel_path"], "left")
    return joined.select(
        "scan_id", "rel_path", F.coalesce("canonical", "rel_path").alias("canonical"), reading_key(F.col("rel_path")).alias("form")
    )
