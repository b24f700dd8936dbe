import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import paths
from cairnframe.operators import browse, compare
from cairnframe.operators.snapshots_view import side

KEYS = ["k"]
E_DDL = "k int, rel_path string, rel_path_norm string, name string, size long, sha256 string"
NFD = "rêve"
NFC = "rêve"

BASE_A = [("identical.txt", 100, "aaa111"), ("left-only.txt", 200, "bbb222"), ("different.txt", 300, "ccc333"), ("sub/nested.txt", 600, "fff666"), ("sub/only-a.txt", 700, "ggg777"), ("sub/deep/file.txt", 800, "hhh888")]
BASE_B = [("identical.txt", 100, "aaa111"), ("right-only.txt", 400, "ddd444"), ("different.txt", 500, "eee555"), ("sub/nested.txt", 600, "fff666"), ("sub/only-b.txt", 900, "iii999"), ("sub/deep/file.txt", 800, "hhh888")]


def frame(spark, trees):
    rows = [(k, p, None, p.rsplit("/", 1)[-1], s, h) for k, t in trees.items() for p, s, h in t]
    return paths.backfill(spark.createDataFrame(rows, E_DDL))


def compared(spark, left, right, lp="", rp="", noise=False):
    a, b = side(frame(spark, left), KEYS, lp, noise), side(frame(spark, right), KEYS, rp, noise)
    return a, b, compare.compare_by_path(a, b, KEYS)


def kinds(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["kind"]].append(r["rel_path"])
    return {k: sorted(v) for k, v in out.items()}


def test_whole_tree_and_prefixes(spark):
    _, _, rows = compared(spark, {1: BASE_A}, {1: BASE_B})
    assert kinds(rows) == {"identical": ["identical.txt", "sub/deep/file.txt", "sub/nested.txt"], "different": ["different.txt"], "left_only": ["left-only.txt", "sub/only-a.txt"], "right_only": ["right-only.txt", "sub/only-b.txt"]}
    _, _, rows = compared(spark, {1: BASE_A}, {1: BASE_B}, "sub", "/sub\\")
    assert kinds(rows) == {"identical": ["deep/file.txt", "nested.txt"], "left_only": ["only-a.txt"], "right_only": ["only-b.txt"]}
    _, _, rows = compared(spark, {1: BASE_A}, {1: BASE_A})
    assert kinds(rows) == {"identical": sorted(p for p, _, _ in BASE_A)}


@pytest.mark.parametrize(
    "left,right,lp,rp,want",
    [
        ([("Música/shared", 1, "a"), ("Música/diff", 1, "b"), ("Música/l", 1, "d")], [("Éxitos/shared", 1, "a"), ("Éxitos/diff", 1, "c"), ("Éxitos/r", 1, "e")], "Música", "Éxitos", {"identical": ["shared"], "different": ["diff"], "left_only": ["l"], "right_only": ["r"]}),
        ([(f"La Vie de {NFD}/s.flac", 1, "a")], [(f"La Vie de {NFC}/s.flac", 1, "a")], f"La Vie de {NFD}", f"La Vie de {NFC}", {"identical": ["s.flac"]}),
        ([(f"{NFD}/d.flac", 1, "a")], [(f"{NFC}/d.flac", 1, "b")], "", "", {"different": [f"{NFC}/d.flac"]}),
        ([(f"c/{NFD}.txt", 101, "x"), (f"c/{NFC}.txt", 202, "y")], [(f"c/{NFC}.txt", 202, "y")], "", "", {"identical": [f"c/{NFC}.txt"], "left_only": [f"c/{NFD}.txt"]}),
        ([("special[raw]/m", 1, "a"), ("specialr/l", 1, "b")], [("special[raw]/m", 1, "a"), ("specialr/r", 1, "c")], "special[raw]", "special[raw]", {"identical": ["m"]}),
        ([("u", 123, None)], [("u", 123, "")], "", "", {"different": ["u"]}),
        ([("a/.DS_Store", 1, "a"), ("Desktop.ini", 30, "b"), ("@eaDir/t.jpg", 1, "c")], [("THUMBS.DB", 1, "a"), ("Desktop.ini", 40, "c"), ("s/@eaDir/t.jpg", 1, "c")], "", "", {}),
        ([], [], "", "", {}),
    ],
)
def test_scenarios(spark, left, right, lp, rp, want):
    _, _, rows = compared(spark, {1: left}, {1: right}, lp, rp, noise=not want)
    assert kinds(rows) == want


def ancestors_of(p):
    parts = [x for x in p.split("/") if x]
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def literal_compare(left, right):
    """The rules, one row after another."""
    nfc = lambda p: unicodedata.normalize("NFC", p)
    same = lambda a, b: a[0] == b[0] and bool(a[1]) and a[1] == b[1]
    L, R, out = dict((p, (s, h)) for p, s, h in left), dict((p, (s, h)) for p, s, h in right), defaultdict(list)
    for p in sorted(L.keys() & R.keys()):
        out["identical" if same(L[p], R[p]) else "different"].append(p)
    lo, ro = sorted(L.keys() - R.keys()), sorted(R.keys() - L.keys())
    cl, cr = Counter(map(nfc, lo)), Counter(map(nfc, ro))
    by = {nfc(p): p for p in ro}
    for p in lo:
        if cl[nfc(p)] == 1 and cr[nfc(p)] == 1:
            out["identical" if same(L[p], R[by[nfc(p)]]) else "different"].append(nfc(p))
        else:
            out["left_only"].append(p)
    out["right_only"] = [p for p in ro if not (cl[nfc(p)] == 1 and cr[nfc(p)] == 1)]
    return {k: sorted(v) for k, v in out.items() if v}


def literal_compact(only, opposite):
    nfc = lambda p: unicodedata.normalize("NFC", p)
    blocked = {nfc(x) for p in opposite for x in [*ancestors_of(p), p]}
    n = Counter(a for p in only for a in ancestors_of(p))
    out = {}
    for p in sorted(only):
        top = next((a for a in ancestors_of(p) if n[a] >= 2 and nfc(a) not in blocked), None)
        out.setdefault(f"{top}/*" if top else p, n[top] if top else 1)
    return list(out.items())


def literal_excess(present, absent):
    c, seen, out = Counter(h for _, _, h in absent if h), Counter(), []
    for p, _, h in sorted(present):
        if h:
            seen[h] += 1
            if seen[h] > c[h]:
                out.append((0, p))
        else:
            out.append((1, p))
    return sorted(out)


def tree(rng):
    names = ["a", "b", NFD, NFC, "ét", "ét"]
    out = {}
    for _ in range(rng.randint(0, 40)):
        p = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(["", ".x", ".y"])
        out[p] = (p, rng.randint(0, 2), rng.choice(["h1", "h2", "h3", None, ""]))
    return list(out.values())


def test_random_trees_against_the_literal_rules(spark):
    rng = random.Random(5)
    left, right = {k: tree(rng) for k in range(25)}, {k: tree(rng) for k in range(25)}
    a, b, rows = compared(spark, left, right)
    got = defaultdict(lambda: defaultdict(list))
    for r in rows.collect():
        got[r["k"]][r["kind"]].append(r["rel_path"])
    lists = {}
    for which, opposite in (("left", b), ("right", a)):
        c = compare.compact_missing_trees(compare.only_files(rows, which, KEYS), opposite, KEYS)
        lists[which] = c.orderBy("k", "sort_path").collect()
    excess = {"left": compare.content_excess(a, b, KEYS).collect(), "right": compare.content_excess(b, a, KEYS).collect()}
    same = {r["k"]: r["identical"] for r in compare.identical_by_content(a, b, KEYS).collect()}
    collapsed = 0
    for k in range(25):
        want = literal_compare(left[k], right[k])
        assert {x: sorted(v) for x, v in got[k].items()} == want
        for which, opposite, one, two in (("left", right, left, right), ("right", left, right, left)):
            want_c = literal_compact(want.get(f"{which}_only", []), [p for p, _, _ in opposite[k]])
            got_c = [(r["rel_path"], r["file_count"]) for r in lists[which] if r["k"] == k]
            assert got_c == want_c
            collapsed += sum(p.endswith("/*") for p, _ in got_c)
            assert sorted((r["ord"], r["rel_path"]) for r in excess[which] if r["k"] == k) == literal_excess(one[k], two[k])
        cl, cr = Counter(h for _, _, h in left[k] if h), Counter(h for _, _, h in right[k] if h)
        assert same.get(k, 0) == sum(min(cl[h], cr[h]) for h in cl)
    assert collapsed > 5


@pytest.mark.parametrize(
    "only,opposite,want",
    [
        (["missing/a", "missing/deeper/b"], [], [("missing/*", 2)]),
        (["shared/only/a", "shared/only/b"], ["shared/x"], [("shared/only/*", 2)]),
        (["single/only"], [], [("single/only", 1)]),
        (["gone/a", "gone/deeper/b", "keep/solo"], ["keep/k"], [("gone/*", 2), ("keep/solo", 1)]),
        (["mixed/a", "mixed/sub/b"], ["mixed/shared"], [("mixed/a", 1), ("mixed/sub/b", 1)]),
        ([f"{NFD}/a", f"{NFD}/sub/b"], [f"{NFC}/s"], [(f"{NFD}/a", 1), (f"{NFD}/sub/b", 1)]),
        (["conflict/1", "conflict/2"], ["conflict"], [("conflict/1", 1), ("conflict/2", 1)]),
        (["/a/b", "/a/c"], [], [("a/*", 2)]),
    ],
)
def test_compaction(spark, only, opposite, want):
    a, b, rows = compared(spark, {1: [(p, 1, "x") for p in only]}, {1: [(p, 1, "y") for p in opposite]})
    c = compare.compact_missing_trees(compare.only_files(rows, "left", KEYS), b, KEYS).orderBy("sort_path").collect()
    assert [(r["rel_path"], r["file_count"]) for r in c] == want


def test_duplicates(spark, rows):
    t = [("d/large-a", 2048, "L"), ("d/large-b", 2048, "l"), ("d/s-a", 128, "s"), ("d/s-b", 128, "s"), ("n/a", 1, None), ("n/b", 1, ""), ("@eaDir/1", 5, "e"), ("x/@eaDir/2", 5, "e")]
    f = frame(spark, {1: t + t[:1]})
    got = [(r["size"], r["sha256"], r["files"]) for r in browse.duplicate_groups(f.drop("k"), ignore_noise=True).collect()]
    assert got == [(2048, "l", ["d/large-a", "d/large-b"]), (128, "s", ["d/s-a", "d/s-b"])]
    assert len(browse.duplicate_groups(f.drop("k")).collect()) == 3
    assert browse.duplicate_files(f, KEYS, "d").select("rel_path").distinct().count() == 4


def test_plan_shapes(spark):
    f = frame(spark, {1: BASE_A})
    text = side(f.drop("rel_path_norm"), KEYS, "sub")._jdf.queryExecution().toString()
    assert "Python" not in side(spark.createDataFrame([(1, "p", None, "p", 1, "x")], E_DDL), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" in text
    a, b, rows = compared(spark, {1: BASE_A}, {1: BASE_B})
    plan = compare.compact_missing_trees(compare.only_files(rows, "left", KEYS), b, KEYS)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_paths(spark, rows):
    p = [("a/b/c.TXT",), (".gitignore",), ("x.",), ("noext",), ("a//b/c",), ("/k",), ("dir/",), (None,), ("",)]
    df = spark.createDataFrame(p, "p string").select("p", paths.extension(paths.base_name(F.col("p"))).alias("e"), paths.ancestors(F.col("p")).alias("a"))
    got = {r["p"]: (r["e"], r["a"]) for r in df.collect()}
    assert got["a/b/c.TXT"] == (".txt", ["a", "a/b"]) and got[".gitignore"] == (".gitignore", []) and got["x."] == (".", [])
    assert got["noext"] == ("", []) and got["a//b/c"][1] == ["a", "a/b"] and got["/k"][1] == [] and got[""][1] == []
    assert paths.prefix("\\a\\b/") == "a/b/" and paths.prefix("/") == "" and paths.prefix(None) == ""
    n = spark.createDataFrame([(f"x/{NFD}", None), ("ascii", None), (f"y{NFD}", "kept")], "rel_path string, rel_path_norm string")
    once = paths.backfill(n)
    assert rows(once) == rows(paths.backfill(once)) and (f"x/{NFD}", f"x/{NFC}") in rows(once) and ("ascii", None) in rows(once)


def test_scalable_rank(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 7 AS STRING)) AS g", "lpad(CAST(id AS STRING), 6, '0') AS o")
    got = compare.rank_within(df, ["g"], "o").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["rn"], r["o"]))
    for v in by.values():
        v.sort()
        assert [x for x, _ in v] == list(range(1, len(v) + 1)) and [o for _, o in v] == sorted(o for _, o in v)


def test_ranks_with_nulls_ties_and_several_orders(spark):
    from cairnframe.operators.compare import rank_within

    rng = random.Random(2)
    data = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, p string, n long, i int").repartition(5)
    got = {r["i"]: r["place"] for r in rank_within(df, ["g"], [F.desc("n"), "p", "i"], "place").collect()}
    key = lambda r: (r[2] is None, -(r[2] or 0), r[1] is not None, r[1] or "", r[3])
    want = {}
    for g in (1, 2, None):
        want |= {r[3]: k for k, r in enumerate(sorted((r for r in data if r[0] == g), key=key), 1)}
    assert got == want
    assert rank_within(df.limit(0), ["g"], "p").count() == 0


def test_roots_that_overlap(spark, rows):
    from cairnframe.operators.reuse import root_pairs

    data = [("m", "/data"), ("m", "/data/raw"), ("m", "/data/raw-archive"), ("m", "/data/raw/"), ("n", "/data"), ("m", "/"), ("m", None), (None, "/x"), ("m", "/data")]
    got = {tuple(r)[1:] for r in root_pairs(spark.createDataFrame(data, "machine_id string, root string")).collect() if r[0] == "m" and r[1] != r[2]}
    down = {("/", "/data"), ("/", "/data/raw"), ("/", "/data/raw/"), ("/", "/data/raw-archive"), ("/data", "/data/raw"), ("/data", "/data/raw/"), ("/data", "/data/raw-archive")}
    want = {(a, b, "ancestor") for a, b in down} | {(b, a, "descendant") for a, b in down} | {("/data/raw", "/data/raw/", "same"), ("/data/raw/", "/data/raw", "same")}
    assert got == want
