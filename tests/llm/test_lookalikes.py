import random
import unicodedata
from collections import defaultdict

import pytest
from cairnframe.llm import lookalikes as la

E = "scan_id long, rel_path string, canonical string"
SAME = [
    ("ａｂ１.txt", "ab1.txt"), ("r\u00e9union", "re\u0301union"), ("a​b", "ab"), ("a­b", "ab"), ("﻿ab", "ab"), ("a b", "a b"), ("a b", "a b"),
    ("a‑b", "a-b"), ("a‐b", "a-b"), ("ledger", "lеdgеr"), ("Ångmåla", "Ångmа̊la"), ("Ёлка", "Ë" + "лка"), ("ｶﾞ", "ガ"), ("\u2126", "\u03a9"), ("ΒΕ", "ВЕ"), ("（x）", "(x)"),
    ("각", "각"),
]
APART = [
    ("Ab", "ab"), ("réunion", "reunion"), ("O1", "01"), ("l", "1"), ("x2", "x²"), ("x3", "x③"), ("fi", "ﬁ"), ("ß", "ss"), ("rn", "m"), ("a b", "ab"), ("a–b", "a-b"),
    ("か", "カ"), ("Ⅳ", "IV"), ("æ", "ae"), ("a  b", "a b"),
]


@pytest.fixture(autouse=True)
def session(spark):
    """The table is made in a running session."""


def pairs(spark, paths, scan=1):
    df = spark.createDataFrame([(scan, p, "clash") for p in paths], E)
    return {(r["rel_path_a"], r["rel_path_b"]) for r in la.same_reading_pairs(df).collect()}


@pytest.mark.parametrize("a,b", SAME)
def test_same_form(a, b):
    assert la.visual_form(a) == la.visual_form(b)


@pytest.mark.parametrize("a,b", APART)
def test_other_form(a, b):
    assert la.visual_form(a) != la.visual_form(b)


def test_pairs(spark):
    paths = sorted({x for p in SAME + APART for x in p})
    got = pairs(spark, paths)
    assert {tuple(sorted(p)) for p in SAME} <= got and not {tuple(sorted(p)) for p in APART} & got
    assert got == {(a, b) for a in paths for b in paths if a < b and la.visual_form(a) == la.visual_form(b)}


def test_pairs_edges(spark):
    df = spark.createDataFrame([(1, "аb", ""), (1, "ab", ""), (1, "ab", ""), (2, "аb", ""), (None, "ab", ""), (1, None, ""), (1, "", ""), (1, "ａｂ", ""), (3, "x" * 50_000, ""), (3, "х" + "x" * 49_999, "")], E)
    got = [tuple(r) for r in la.same_reading_pairs(df).collect()]
    assert len(got) == len(set(got)) == 4 and all(a < b for _, a, b in got) and sum(s == 1 for s, _, _ in got) == 3
    assert la.same_reading_pairs(spark.createDataFrame([], E)).count() == 0


def test_random_against_brute_force(spark):
    rng = random.Random(11)
    letters = list("aеééaаoоο x -‐1１lᅠ‍") + ["ａ", "ｘ"]
    data = [(rng.randint(1, 3), "".join(rng.choice(letters) for _ in range(rng.randint(0, 4))), "") for _ in range(3000)]
    by = defaultdict(set)
    for s, p, _ in data:
        by[s, la.visual_form(p)].add(p)
    want = {(s, a, b) for (s, _), m in by.items() for a in m for b in m if a < b}
    assert {tuple(r) for r in la.same_reading_pairs(spark.createDataFrame(data, E)).collect()} == want


def test_composed_and_combining_letters_meet(spark):
    letters = [x for x in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if unicodedata.normalize("NFD", x) != x]
    data = [(i, p, "") for i, x in enumerate(letters) for p in {x, unicodedata.normalize("NFD", x), unicodedata.normalize("NFC", x)}]
    data += [(9001, p, "") for p in ("\u00ea\u0323", "\u1ec7", "e\u0323\u0302")] + [(9002, p, "") for p in ("\u1ecd\u031b", "\u1ee3")]
    data += [(9003, p, "") for p in ("\u045e", "y\u0306", "\u0443\u0306")] + [(9004, p, "") for p in ("\u1f40", "\u03bf\u0313", "o\u0313")]
    by = defaultdict(set)
    for s, p, _ in data:
        by[s].add(p)
    want = {(s, a, b) for s, m in by.items() for a in m for b in m if a < b}
    df = spark.createDataFrame(data, E)
    assert {tuple(r) for r in la.same_reading_pairs(df).collect()} == want
    got = {(r["scan_id"], r["rel_path"]): r["canonical"] for r in la.consistent_paths(df).collect()}
    assert got == {(s, p): min(m) for s, m in by.items() for p in m}


def test_consistent_paths(spark):
    df = spark.createDataFrame([(1, "аb", ""), (1, "ab", ""), (1, "c", ""), (1, "c", "")], E)
    got = {r["rel_path"]: (r["canonical"], r["form"]) for r in la.consistent_paths(df).collect()}
    assert got == {"аb": ("ab", "ab"), "ab": ("ab", "ab"), "c": ("c", "c")}


def test_table_is_made_by_rule():
    t = la.table()
    assert len(la.SAME_SHAPE) < 200 and t["​"] == "" and t["　"] == " " and t["Ａ"] == "A" and all(len(v) <= 1 for v in t.values())
    assert (t["Ꭰ"], t["ꓮ"], t["Ⲟ"], t["ⲟ"], t["𐐄"], t["ꓲ"]) == ("D", "A", "O", "o", "O", "I") and "ס" not in t and "σ" not in t and "α" not in t
    for script in la.SHAPED_SCRIPTS:  # two letters of one script never read the same
        own = [v for k, v in la.confusables(la.SparkSession.getActiveSession()).items() if unicodedata.name(k).split()[0] == script]
        assert len(own) == len(set(own))


def test_classes_and_links(spark):
    df = spark.createDataFrame([(1, p, "") for p in ("ab", "аb", "ａb", "ab", "c", "ꓮ", "A")] + [(2, "ab", "")], E)
    got = sorted(tuple(r) for r in la.reading_classes(df).collect())
    assert got == sorted([(1, "ab", "ab", 2), (1, "аb", "ab", 2), (1, "ａb", "ab", 2), (1, "ꓮ", "A", 1), (1, "A", "A", 1)])


def test_forms_that_the_collation_weighs_alike(spark):
    # the class is divided by the forms themselves
    m = spark.createDataFrame([(1, p, "") for p in ("x\u0f77", "x\u0f78", "\u1d2c", "A", "ab", "аb")], E)
    got = {tuple(r)[:3] for r in la.reading_classes(m).collect()}
    assert got == {(1, "ab", "ab"), (1, "аb", "ab")}
