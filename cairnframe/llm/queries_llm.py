"""Queries of the text problems, and their SQL."""

from __future__ import annotations

import unicodedata

from cairnframe.functions.exec import table
from cairnframe.llm import leakage, lookalikes, sentences, tokens


def p3_found(spark, d):
    return lookalikes.same_reading_pairs(table(spark, d, "entries"))


def p3_classes(spark, d):
    return lookalikes.reading_classes(table(spark, d, "entries"))


def p3_paths(spark, d):
    return lookalikes.consistent_paths(table(spark, d, "entries"))


def p7_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_texts(spark, d):
    return tokens.decode_corpus(p7_ids(spark, d))


def p8_found(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_passages(spark, d):
    return leakage.passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f for f in (p3_found, p3_classes, p3_paths, p7_ids, p7_texts, p8_found, p8_passages, p9_found)
}

# The consistent form in SQL, stated on its own. Letters of other scripts above the Latin letters they look like.
_LETTERS = (
    ("АВЕЅІЈКМНОРСТХУҮһҺԌԚԜӀѴаеѕіјорсухԁԛԝѵӏ", "ABESIJKMHOPCTXYYhhGQWIVaesijopcyxdqwvl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϳϲϹͿ", "ABEZHIKMNOPTYXovıjcCJ"),
    ("օՏՕսհոᎪᎬᎷᎻᏆᏢᏟᎢᏃᏚᏦᏞᏙᎫᏴᏀ", "oSOuhnAEMHIPCTZSKLVJBG"),
    ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))),  # full width
    ("｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ", "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"),
    ("\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000", " " * 15),
    ("\u2010\u2011\ufe63\uff0d", "----"),
)
_INVISIBLE = "\u00ad\u034f\u061c\u180e" + "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)])) + "\ufeff"


def _form_sql() -> str:
    """The consistent form of rel_path in SQL, by translate. As it can't take letters apart, composed ones are listed too."""
    old, new = ("".join(x) for x in zip(*_LETTERS))
    one = dict(zip(old, new))
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        whole = unicodedata.normalize("NFC", one.get(base, base) + "".join(marks))
        if marks and base in one and len(whole) == 1:
            old, new = old + c, new + whole
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    step = lambda x: f"nfc_normalize(translate({x}, {quote(old + _INVISIBLE)}, {quote(new)}))"
    return step(step("nfc_normalize(rel_path)"))


SQL = {
    "p3_found": f"""
        WITH e AS (SELECT DISTINCT scan_id, rel_path, {_form_sql()} AS form FROM entries)
        SELECT scan_id, a.rel_path AS rel_path_a, b.rel_path AS rel_path_b FROM e a JOIN e b USING (scan_id, form)
        WHERE a.rel_path < b.rel_path""",
    "p3_classes": f"""
        WITH e AS (SELECT DISTINCT scan_id, rel_path, {_form_sql()} AS form FROM entries WHERE rel_path IS NOT NULL AND scan_id IS NOT NULL),
        c AS (SELECT scan_id, form, min(rel_path) AS canonical, count(*) - 1 AS links FROM e GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT scan_id, rel_path, canonical, links FROM e JOIN c USING (scan_id, form)""",
    "p3_paths": f"""
        WITH e AS (SELECT DISTINCT scan_id, rel_path, {_form_sql()} AS form FROM entries)
        SELECT scan_id, rel_path, min(rel_path) OVER (PARTITION BY scan_id, form) AS canonical, form FROM e""",
    "p7_texts": "SELECT doc_id, COALESCE(text, '') AS text FROM documents",
}
