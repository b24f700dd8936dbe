import csv
import io
import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnframe.operators import badrows, drift, reconcile, skew, snapshots

SCANS = "scan_id long, machine_id string, root string, started_at long, status string"
ENTRIES = "scan_id long, rel_path string, size long, mtime_ns long, sha256 string, extra string"
REC = "feed_id long, file_id long, written_at timestamp, loaded_at timestamp, rec_no int, record string"
RAW = "report_id long, line_no int, loaded_at timestamp, raw string"


# ---- snapshots (p4)
def test_snapshot_changes(spark, rows):
    scans = spark.createDataFrame(
        [(9, "m", "/", 1, "complete"), (9, "m", "/", 1, "complete"), (3, "m", "/", 2, "complete"), (4, "m", "/", 3, "failed"), (5, "m", "/", 4, "complete"), (6, "m", "/", 5, "complete"), (7, "n", "/", 1, "complete")],
        SCANS,
    )
    e = [
        (9, "a", 1, 1, "X", ""), (9, "a", 1, 1, "x", ""), (9, "b", 1, 1, None, ""), (9, "c", 1, 1, "", ""), (9, "d", 1, None, "q", ""),
        (3, "a", 1, 1, "x", ""), (3, "b", 1, 1, "", ""), (3, "c", 1, 1, "z", ""), (3, "d", 1, 0, "q", ""), (3, "e", 5, 1, "x", ""),
        (4, "f", 1, 1, "x", ""), (6, "g", 1, 1, "x", ""), (7, "a", 1, 1, "x", ""), (None, "a", 1, 1, "x", ""), (3, None, 1, 1, "x", ""),
    ]
    got = rows(snapshots.snapshot_changes(spark.createDataFrame(e, ENTRIES), scans))
    assert got == sorted([(3, "c", "changed"), (3, "d", "changed"), (3, "e", "added"), *((5, p, "removed") for p in "abcde"), (6, "g", "added")], key=repr)


def test_snapshot_changes_of_nothing(spark):
    none = spark.createDataFrame([], ENTRIES)
    assert snapshots.snapshot_changes(none, spark.createDataFrame([], SCANS)).count() == 0
    assert snapshots.snapshot_changes(none, spark.createDataFrame([(1, "m", "/", 1, "complete"), (2, "m", "/", 2, "complete")], SCANS)).count() == 0


def test_snapshot_plan_has_one_shuffle_of_rows(spark):
    e, s = spark.createDataFrame([(1, "a", 1, 1, "x", "")], ENTRIES), spark.createDataFrame([(1, "m", "/", 1, "complete")], SCANS)
    plan = snapshots.snapshot_changes(e, s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(later_scan_id") == 1 and "Python" not in plan


# ---- skew (p6)
@pytest.mark.parametrize("n", [0, 1, 20_000])
def test_places_against_brute_force(spark, n):
    rng = random.Random(n)
    data = []
    for i in range(n):
        h = rng.choice(["HOT"] * 6 + [f"h{rng.randint(0, 50)}", None, ""])
        data.append((rng.randint(1, 5), f"p{rng.randint(0, n)}", rng.choice([1, 1, 1, None]), 1, rng.choice([h, h and h.lower()]), ""))
    want = defaultdict(set)
    for s, p, size, _, h, _ in data:
        if h:
            want[size, h.lower()].add((s, p))
    got = skew.places_per_content(spark.createDataFrame(data, ENTRIES), 7)
    assert {(r["size"], r["sha256"]): r["places"] for r in got.collect()} == {k: len(v) for k, v in want.items()}
    few = skew.crowded_contents(spark.createDataFrame(data, ENTRIES), 25).collect()
    assert {tuple(r) for r in few} == {k for k, v in want.items() if len(v) >= 25}


def test_hot_content_is_split(spark):
    df = spark.range(40_000).selectExpr("1L AS scan_id", "CAST(id AS STRING) AS rel_path", "1L AS size", "'hot' AS sha256")
    ranged = df.repartitionByRange(8, "size", "sha256", "scan_id", "rel_path")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    assert skew.places_per_content(df).first()["places"] == 40_000


# ---- copies (p5)
def brute_differences(entries, pairs):
    at = defaultdict(dict)
    for s, p, size, _, h, _ in entries:
        if s is not None and p is not None:
            at[s][p] = (size, (h or "").lower())
    out = set()
    for pair, a, b in pairs:
        left, right = at[a], at[b]
        out |= {(pair, p, "only_left") for p in left.keys() - right.keys()} | {(pair, p, "only_right") for p in right.keys() - left.keys()}
        for p in left.keys() & right.keys():
            out |= {(pair, p, f) for f, x, y in (("size", left[p][0], right[p][0]), ("sha256", left[p][1], right[p][1])) if x != y}
    return out


@pytest.mark.parametrize("share", [0, 0.02, 0.9])
def test_copies_against_brute_force(spark, share):
    rng = random.Random(7)
    entries = []
    for i in range(6000):
        row = (1, f"dir/é {i}", i, 1, rng.choice([f"AB{i}", None, ""]), "")
        entries += [row] * rng.choice([1, 1, 1, 2, 3])
        if rng.random() >= share:
            entries += [(2, row[1], row[2], 5, row[4] and row[4].lower(), "")] * rng.choice([1, 1, 2])
        elif rng.random() < 0.6:
            entries.append((2, row[1], row[2] + rng.randint(0, 1), 5, rng.choice([row[4], "other", None]), ""))
    entries += [(2, None, 1, 1, "x", ""), (None, "a", 1, 1, "x", ""), (3, "a", None, 1, "x", ""), (4, "a", None, 1, "X", ""), (4, "b", 0, 1, "x", "")]
    pairs = [(10, 1, 2), (11, 3, 4), (12, 1, 1), (13, 5, 6)]
    got = reconcile.copy_differences(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(pairs + pairs[:1], "pair_id long, left_scan_id long, right_scan_id long"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_differences(entries, pairs)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_rows_repeated_any_number_of_times(spark, monkeypatch, bound):
    monkeypatch.setattr(reconcile, "CELLS", 6)
    monkeypatch.setattr(reconcile, "BUCKET_ROWS", 40)
    monkeypatch.setattr(reconcile, "BROADCAST_ROWS", bound)
    rng = random.Random(11)
    entries = []
    for i in range(3000):
        kind = rng.random()
        for scan in (1, 2):
            if kind < 0.05 and scan == 2 or 0.05 <= kind < 0.1 and scan == 1:
                continue
            size = i + (scan if 0.1 <= kind < 0.15 else 0)
            entries += [(scan, f"p{i}", size, 1, f"h{i}", "")] * rng.randint(1, 4)
    pairs = [(1, 1, 2)]
    got = reconcile.copy_differences(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(pairs, "pair_id long, left_scan_id long, right_scan_id long"))
    assert {tuple(r) for r in got.collect()} == brute_differences(entries, pairs)


def test_tables_open_whatever_the_repeats():
    rng, cells = np.random.default_rng(5), []
    rows = [(int(k), int(h), int(n)) for k, h, n in zip(rng.integers(-(2**63), 2**63, 12), rng.integers(-(2**63), 2**63, 12), [2, -2, 1, -1, 3, -3, 4, -4, 2, 2, -2, 1])]
    for k, h, n in rows:
        c = int(reconcile.xxhash64_longs(np.array([k]), np.array([h]))[0])
        for t in range(3):
            at = t * reconcile.CELLS + (c >> 20 * t) % reconcile.CELLS
            cells.append((1, 0, at, n, *(n * x for v in (k, h, c) for x in (v >> 32, v & 0xFFFFFFFF))))
    df = pd.DataFrame(cells, columns=["pair_id", "bucket", "cell", *reconcile.SUMS]).groupby(["pair_id", "bucket", "cell"], as_index=False).sum()
    assert sorted(reconcile.open_tables(df)["k"].tolist()) == sorted(k for k, _, _ in rows)


def test_copies_of_nothing(spark):
    p = spark.createDataFrame([], "pair_id long, left_scan_id long, right_scan_id long")
    assert reconcile.copy_differences(spark.createDataFrame([], ENTRIES), p).count() == 0


def test_hash_is_sparks(spark):
    v = [(1, 2), (-5, 0), (2**62, -(2**62)), (0, -1)]
    got = [r[0] for r in spark.createDataFrame(v, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    a, b = (np.array(x, np.int64) for x in zip(*v))
    assert reconcile.xxhash64_longs(a, b).tolist() == got


# ---- drift (p1)
def feed(spark, *files, feed_id=1):
    t0, out = datetime(2024, 1, 30), []
    for i, records in enumerate(files):
        for n, r in enumerate(records, 1):
            out.append((feed_id, 100 - i, t0 + timedelta(hours=13 * i), t0, n, r if isinstance(r, (str, type(None))) else json.dumps(r)))
    return spark.createDataFrame(out, REC)


def changes(df):
    return sorted((r["file_id"], r["field"], r["change"]) for r in drift.schema_changes(df).collect())


def test_every_kind_of_change(spark):
    df = feed(
        spark,
        [{"Key": "k", "ErrorCode": "KeyGone", "HTTPStatusCode": 200, "OwnerTag": "x"}, {"Key": "k", "Late": None}],
        [{"Key": "k", "Fehlercode": ["KeyGone"], "HTTPStatusCode": 200.0, "Late": 1}],
        [{"Key": "k", "Fehlercode": None, "StatusCode": 200.0, "Parts": [1]}],
        [{"Key": "k", "Fehlercode": "A", "StatusCode": {"code": 200}, "parts": [1], "n": True}],
    )
    assert changes(df) == sorted(
        [(99, "Fehlercode", "renamed"), (99, "Fehlercode", "retyped"), (99, "HTTPStatusCode", "retyped"), (99, "OwnerTag", "removed"),
         (98, "StatusCode", "renamed"), (98, "Late", "removed"), (98, "Parts", "added"),
         (97, "StatusCode", "retyped"), (97, "parts", "renamed"), (97, "n", "added")]
    )
    log = {(r["file_id"], r["field"], r["change"]): r for r in drift.schema_changes(df).collect()}
    assert log[99, "HTTPStatusCode", "retyped"]["promoted"] == "decimal number" and log[99, "Fehlercode", "renamed"]["old_field"] == "ErrorCode"


def test_unknown_names_are_told_by_their_values(spark):
    df = feed(spark, [{"HTTPStatusCode": 404}, {"HTTPStatusCode": 200}], [{"Antwort": "200 "}], [{"Antwort": 5}])
    assert changes(df) == sorted([(99, "Antwort", "renamed"), (99, "Antwort", "retyped"), (98, "Antwort", "retyped")])


def test_drift_edges(spark):
    df = feed(spark, [{"a": 1}, {"a": 1}], [None, "", "[1]", "{broken", '{"a": 1}'], ["nothing"], [{"a": None}], ['{"x":' + "[" * 50 + "]" * 50 + "}"])
    assert changes(df) == [(96, "a", "removed"), (96, "x", "added")]
    assert changes(spark.createDataFrame([], REC)) == []
    assert changes(df.unionByName(df).withColumn("field", F.lit("clash"))) == changes(df)


def test_order_is_written_at_over_months(spark):
    t = [datetime(2024, 1, 1), datetime(2024, 3, 1), datetime(2024, 2, 1), datetime(2023, 12, 31)]
    rows = [(7, i, x, x, 1, json.dumps({f"f{i}": 1, "k": 1})) for i, x in enumerate(t)]
    assert changes(spark.createDataFrame(rows, REC)) == sorted([(0, "f0", "added"), (0, "f3", "removed"), (2, "f2", "added"), (2, "f0", "removed"), (1, "f1", "added"), (1, "f2", "removed")])


def test_unified_table(spark):
    df = feed(spark, [{"Key": "k", "http": {"code": 404}, "ErrCode": ["A"], "Result": {"note": "x"}, "Parts": [1]}, "bad"], [{"Key": "k", "HTTPStatusCode": "200 ", "errcode": 1005, "Message": ["m"]}, {"HttpStatus": 500.0}])
    got = {(r["file_id"], r["rec_no"]): r for r in drift.unified_records(df.unionByName(df)).collect()}
    a, b = got[100, 1], got[99, 1]
    assert (a["http_status_code"], a["error_code"], a["result_message"], a["extra"]) == (404, "A", '{"note":"x"}', '{"Parts":[1]}')
    assert (b["http_status_code"], b["error_code"], b["result_message"]) == (200, "1005", "m") and got[99, 2]["http_status_code"] == 500
    assert got[100, 2]["err"] and len(got) == 4


def test_unified_table_drops_nothing(spark):
    code = {"code": "SlowLane", "class": "A"}
    df = feed(
        spark,
        [{"ErrorCode": code, "HTTPStatusCode": "503 Slow Down"}, {"ErrorCode": [code], "HTTPStatusCode": 404.5}, {"ErrorCode": {"code": "A"}, "http": {"code": "x", "n": 1}},
         {"Message": [{"code": "A", "note": "x"}], "http": {"code": "404", "n": 1}}, {"ErrorCode": None, "http": [None]}, {"ErrorCode": [], "http": 1e30, "status": "200"}, {"http": True, "Message": {"code": 1, "n": 2}}],
    )
    got = {r["rec_no"]: (r["error_code"], r["http_status_code"], r["result_message"], json.loads(r["extra"])) for r in drift.unified_records(df).collect()}
    assert got == {
        1: ("SlowLane", None, None, {"ErrorCode": code, "HTTPStatusCode": "503 Slow Down"}),
        2: ("SlowLane", None, None, {"ErrorCode": [code], "HTTPStatusCode": 404.5}),
        3: ("A", None, None, {"http": {"code": "x", "n": 1}}),
        4: (None, 404, "A", {"Message": [{"code": "A", "note": "x"}], "http": {"code": "404", "n": 1}}),
        5: (None, None, None, {"http": [None]}),
        6: ("[]", None, None, {"http": 1e30, "status": "200"}),
        7: (None, None, '{"code":1,"n":2}', {"http": True}),
    }


@pytest.mark.parametrize(
    "kinds,want",
    [(["decimal number", "integer"], "decimal number"), (["boolean", "integer"], "string"), (["array"], "array"), (["array", "object"], "string"), ([], None)],
)
def test_lattice(spark, kinds, want):
    df = spark.createDataFrame([(kinds,)], "kinds array<string>")
    assert df.select(F.expr(drift.promote("kinds"))).first()[0] == want


def test_files_are_cast_to_the_union_of_all(spark):
    df = feed(spark, [{"Size": 1, "Tag": "a", "Flag": True}], [{"size": 2.5, "tag": 5, "Flag": None}], [{"Size": 3, "Tag": {"x": [1]}}])
    schema = {r["meaning"]: (r["field"], r["kind"], r["files"], r["spellings"]) for r in drift.union_schema(df).collect()}
    assert schema == {"size": ("Size", "decimal number", 3, 2), "tag": ("Tag", "string", 3, 2), "flag": ("Flag", "boolean", 2, 1)}
    extra = {r["file_id"]: json.loads(r["extra"]) for r in drift.unified_records(df).collect()}
    assert extra == {100: {"Size": 1, "Tag": "a", "Flag": True}, 99: {"size": 2.5, "tag": "5"}, 98: {"Size": 3, "Tag": '{"x":[1]}'}}


def test_names_that_say_nothing_land_in_the_column_of_their_values(spark):
    df = feed(spark, [{"ErrorCode": "KeyGone", "http": 404}, {"ErrorCode": "SlowLane", "http": 200}], [{"c7": "AclBlocked", "http": 404, "ms": 300}, {"c7": "KeyGone", "http": 500, "ms": 200}])
    assert changes(df) == sorted([(99, "c7", "renamed"), (99, "ms", "added")])
    got = sorted((r["file_id"], r["rec_no"], r["error_code"], r["http_status_code"], r["extra"]) for r in drift.unified_records(df).collect())
    assert got == [(99, 1, "AclBlocked", 404, '{"ms":300}'), (99, 2, "KeyGone", 500, '{"ms":200}'), (100, 1, "KeyGone", 404, "{}"), (100, 2, "SlowLane", 200, "{}")]


def test_records_that_are_hard_to_read(spark):
    texts = ['{"a":1} x', '{"a":1},"b":2}', '{"a":1,"a":2}', '{"a":NaN}', "{'a':1}", '{"a":' + "[" * 5000 + "]" * 5000 + "}", '{"a":12345678901234567890}', ' {"a": 1} \n', "{}", '{"a\'b.c$[0]": 1}']
    got = {r["rec_no"]: (r["err"], r["extra"]) for r in drift.unified_records(feed(spark, texts)).collect()}
    bad = ("not a JSON object", "{}")
    assert {i: x for i, x in got.items() if i != 6} == {
        1: bad, 2: bad, 3: (None, '{"a":2}'), 4: bad, 5: bad, 7: (None, '{"a":12345678901234567890}'), 8: (None, '{"a":1}'), 9: (None, "{}"), 10: (None, '{"a\'b.c$[0]":1}'),
    }
    assert drift.unified_records(spark.createDataFrame([], REC)).count() == drift.union_schema(spark.createDataFrame([], REC)).count() == 0


# ---- rows that fail to parse (p2)
OK = '{""a"": 1}'
CASES = [
    (f'b,k,,SUCCEEDED,200,,"{OK}"', None), ('b,k,,failed,E,404,text', None), (' b, k, , Failed, , 409, " x, ""y"""', None),
    ("Bucket,Key,VersionId,TaskStatus,HTTPStatusCode,ErrorCode,ResultMessage", "header"), ('"bucket",KEY,a,b,c,d,resultmessage', "header"),
    ('b,"k,,failed,,,x', "quoting"), ('b,k"q,,failed,,,x', "quoting"), ('b,"k"x,,failed,,,x', "quoting"), ('b,"k" ,,failed,,,x', "quoting"),
    ("b,k,,failed,,", "column_count"), ("b,k,,failed,,,x,", "column_count"), ("", "column_count"), (None, "column_count"), ("a\tb", "column_count"),
    ("b,k,,,,,x", "task_status"), ("b,k,,succeeded ,,,{}", "task_status"), ("b,k,,сucceeded,,,{}", "task_status"),
    ("b,k,,succeeded,,,{}", None), ("b,k,,succeeded,,,", "result_message"), ("b,k,,succeeded,,,[]", "result_message"), ("b,k,,succeeded,,,done", "result_message"),
    ('b,k,,succeeded,,,"{""a"": NaN}"', "result_message"), ('b,k,,succeeded,,,"{""a"": 1,}"', "result_message"), ('b,k,,succeeded,,,"{""a"": 01}"', "result_message"),
    ("b,k,,succeeded,,,\"{'a': 1}\"", "result_message"), ('b,k,,succeeded,,,"{""a"": 1} ok"', "result_message"), ('b,k,,succeeded,,,"{\n ""a"": ""x\ny""}"', "result_message"),
    ('b,k,,succeeded,,,"\n{""a"":\n 1}\n"', None), ("b,k\n2,,failed,,,x", None), ('b,"k\n,2",,failed,,,x', None), ('b,k,,failed,,,"' + 'x""' * 40_000 + '"', None),
    ("b,k,,failed,,," + "y" * 200_000, None), ('b,k,,succeeded,,,"' + '{""a"":' * 3000 + "1" + "}" * 3000 + '"', None), ('b,k,,succeeded,,,"' + '{""a"":' * 3000 + "1" + "}" * 2999 + '"', "result_message"),
]


def test_reasons(spark):
    data = [(1, i, datetime(2024, 1, 1), raw) for i, (raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(data + data[:3], RAW).withColumn("reason", F.lit("clash"))
    got = {r["line_no"]: r["reason"] for r in badrows.read_lines(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]
    failed = badrows.failed_lines(df).collect()
    assert sorted(r["line_no"] for r in failed) == [i for i, (_, w) in enumerate(CASES) if w not in (None, "header")]
    assert badrows.failed_lines(spark.createDataFrame([], RAW)).count() == 0


def test_fields_are_those_of_a_csv_reader(spark):
    data = [(1, i, datetime(2024, 1, 1), raw) for i, (raw, w) in enumerate(CASES) if w is None and len(raw) < 1000]
    for r in badrows.read_lines(spark.createDataFrame(data, RAW)).collect():
        raw = data[[d[1] for d in data].index(r["line_no"])][3]
        want = next(csv.reader(io.StringIO(raw, newline=""), skipinitialspace=True, strict=True)) if "\n" not in raw.replace('"', "") or '"' in raw else None
        if want:
            assert [r[f"f{i}"] for i in range(7)] == want


def test_records_that_only_look_odd(spark):
    long = '"' + 'a""' * 300_000 + '",k,,failed,E,404,t'
    cases = [
        ('b,k,,succeeded,200,,"{""a"":1,""a"":2}"', None, None), ('b,k,,succeeded,200,,"{""a"":1} x"', "result_message", None),
        ('b,k,,succeeded,200,,"{""a"":1},""b"":0}"', "result_message", None), ("," * 30_000, "column_count", None), ('"' + "," * 30_000 + '",k,,failed,E,404,t', None, "," * 30_000),
        (long, None, 'a"' * 300_000), ("\x0bb,k,,failed,E,404,t", None, "\x0bb"), ('"a\nb\r\nc",k,,failed,E,404,t\r\n', None, "a\nb\r\nc"), ("\nb,k,,failed,E,404,t", None, "\nb"),
        ('b,k,,succeeded,200,,' + '"' + '{""a"":' + "[" * 3000 + "]" * 3000 + '}"', None, "b"), (long[:-19], "quoting", None), ('b,k,,succeeded,200,,"{""a"":NaN}"', "result_message", None),
    ]
    df = spark.createDataFrame([(1, i, None, raw) for i, (raw, _, _) in enumerate(cases)], RAW)
    for r in badrows.read_lines(df).collect():
        _, reason, first = cases[r["line_no"]]
        assert r["reason"] == reason, r["line_no"]
        assert first is None or r["f0"] == first


def test_strict_json_scan_agrees_with_the_parser():
    rng = random.Random(3)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"\\u00e9"', '"\\x"', "1", "-0.5e3", "01", "true", "nul", "null", " ", "\n"]
    for _ in range(20_000):
        text = "{" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert badrows._strict_deep(text) == badrows.strict_object(text), text


def test_stream_of_lines(spark, tmp_path):
    from cairnframe.streaming import reports

    data = [(1, i, datetime(2024, 1, 1), raw) for i, (raw, _) in enumerate(CASES[:14])]
    spark.createDataFrame(data + data, RAW).write.parquet(str(tmp_path / "in"))
    stream = reports.failed_rows(reports.judged_lines(reports.line_stream(spark, str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("failed_lines").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["line_no"], r["reason"]) for r in spark.table("failed_lines").collect()}
    assert got == {(i, w) for i, (_, w) in enumerate(CASES[:14]) if w not in (None, "header")}
