import hashlib
import os

import pytest

from cairnframe import schemas
from cairnframe.functions.hashing import fingerprint, hash_file, hash_twice
from cairnframe.operators.reuse import overlap_candidates, reuse_hashes
from cairnframe.plans.consolidate import current_only, last_wins, merge, upsert, without_machines
from cairnframe.plans.s3import import inventory_manifest, lookup_table, timestamp_ns, with_metadata
from pyspark.sql import functions as F

C = "rel_path string, size long, mtime_ns long, fingerprint string, sha256 string"


def test_reuse_tiers(spark, rows):
    walked = spark.createDataFrame([("agree", 1, 1), ("conflict", 1, 1), ("overlap", 1, 1), ("odd", 1, 1), ("new", 1, 1), ("moved", 1, 2), ("nulls", 1, 1)], "rel_path string, size long, mtime_ns long")
    exact = spark.createDataFrame([("agree", 1, 1, "f", "s"), ("agree", 1, 1, "f", "s"), ("conflict", 1, 1, "f", "s"), ("conflict", 1, 1, "f", "t"), ("moved", 1, 1, "f", "s"), ("nulls", 1, 1, None, None), ("nulls", 1, 1, "", "")], C)
    overlap = spark.createDataFrame([("conflict", 1, 1, "f", "s"), ("overlap", 1, 1, "f", "o"), ("odd", 1, 1, "f", "a"), ("odd", 1, 1, "f", "b")], C)
    got = {r["rel_path"]: (r["reused"], r["sha256"]) for r in reuse_hashes(walked, exact, overlap).collect()}
    assert got == {"agree": (True, "s"), "conflict": (False, None), "overlap": (True, "o"), "odd": (False, None), "new": (False, None), "moved": (False, None), "nulls": (True, None)}
    assert not any(r["reused"] for r in reuse_hashes(walked, exact.limit(0)).collect())


def test_overlapping_roots_rebase(spark, rows):
    src = spark.createDataFrame(
        [("/data", "raw/a", "ok"), ("/data", "raw-archive/z", "ok"), ("/data/raw/x", "b", "reused"), ("/data/raw-archive", "q", "ok"), ("/data/raw/x", "c", "error")],
        "root string, rel_path string, state string",
    ).withColumns({"size": F.lit(1), "mtime_ns": F.lit(1), "fingerprint": F.lit("f"), "sha256": F.lit("s")})
    got = [r["rel_path"] for r in overlap_candidates("/data/raw", src).orderBy("rel_path").collect()]
    assert got == ["a", "x/b"]


@pytest.mark.parametrize("n", [0, 1, 65535, 65536, 65537, 131072, 300000])
def test_fingerprint(spark, tmp_path, n):
    data = bytes(i % 251 for i in range(n))
    want = hashlib.sha256(data[:65536] + data[-65536:] + n.to_bytes(8, "little")).hexdigest()
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(fingerprint(F.col("c"))).first()[0] == want
    p = tmp_path / "f"
    p.write_bytes(data)
    s = os.stat(p)
    assert hash_file(str(p), s.st_size, s.st_mtime_ns) == ("ok", want, hashlib.sha256(data).hexdigest(), None)
    assert hash_file(str(p), s.st_size + 1, s.st_mtime_ns)[0] == "unstable"
    assert hash_twice(str(p), s.st_size + 1, s.st_mtime_ns)[0] == "ok"
    assert hash_file(str(p) + "x", 0, 0)[0] == "vanished"


def test_merge_and_delete(spark, rows):
    def store(machine, scan, size):
        return {
            "roots": spark.createDataFrame([(machine, "/d", scan)], schemas.ROOTS),
            "scans": schemas.upgrade(spark.createDataFrame([(scan, "/d", 1, "complete"), (scan + 1, "/d", 1, "failed")], "scan_id long, root string, started_at long, status string"), "scans", machine, machine),
            "entries": schemas.upgrade(spark.createDataFrame([(scan, "a", size), (scan + 1, "b", size)], "scan_id long, rel_path string, size long"), "entries"),
        }

    t = merge(store("m", 1, 10), store("m", 11, 20))
    assert rows(t["roots"]) == [("m", "/d", 11)]
    assert rows(t["entries"].select("scan_id", "size")) == [(11, 20)]
    t = merge(store("m", 1, 10), store("n", 11, 20))
    assert rows(t["entries"].select("scan_id")) == [(1,), (11,), (2,)]
    t = without_machines(t, ["m", "", "m"])
    assert rows(t["roots"]) == [("n", "/d", 11)] and rows(t["entries"].select("scan_id")) == [(11,)]
    assert rows(current_only(store("m", 1, 1))["entries"].select("scan_id")) == [(1,)]
    tagged = spark.createDataFrame([("m", "aaa", 1), ("m", "bbb", 2)], "k string, f string, v int")
    assert rows(last_wins(tagged, ["k"], "f")) == [("m", "bbb", 2)]
    assert rows(upsert(tagged, spark.createDataFrame([("m", "c", 3)], tagged.schema), ["k"])) == [("m", "c", 3)]
    assert schemas.is_compatible({n: set(s.names) for n, s in schemas.TABLES.items()}) and not schemas.is_compatible({})


def test_inventory_lookup_and_times(spark, rows, tmp_path):
    o = spark.createDataFrame([("b", "k", "v1", 1, 1, 1), ("b", "k", "v1", 2, 2, 2), ("b", "k", "v2", 3, 3, 3), ("b", "n", "v", 0, 9, 4), ("b", "n", "", 0, 5, 5), ("b", "n", "", 0, 6, 6)], "bucket string, key string, version string, size long, mtime_ns long, ord int")
    r = spark.createDataFrame([("b", "k", "v1"), ("b", "k", None), ("b", "k", "other"), ("b", "n", None), ("b", "x", None)], "bucket string, object_key string, version_id string")
    got = rows(with_metadata(r, lookup_table(o)))
    assert got == sorted([("b", "k", "v1", 2, 2, True), ("b", "k", None, 1, 1, True), ("b", "k", "other", 1, 1, True), ("b", "n", None, 0, 6, True), ("b", "x", None, None, None, False)], key=repr)
    t = [("2026-05-04T14:15:16.000Z", 1777904116 * 10**9), ("2026-05-04T14:15:16.123456789Z", 1777904116123456789), ("2026-05-04 14:15:16", 1777904116 * 10**9), ("2026-05-04T14:15:16+02:00", 1777896916 * 10**9), ("x", 0), ("", 0), (None, 0)]
    df = spark.createDataFrame(t, "t string, w long").select(timestamp_ns(F.col("t")).alias("g"), "w")
    assert all(x["g"] == x["w"] for x in df.collect())
    (tmp_path / "i.json").write_text('{"fileFormat": "ORC", "fileSchema": "Bucket"}')
    with pytest.raises(ValueError):
        inventory_manifest(str(tmp_path / "i.json"))


def test_records_of_lines(spark, tmp_path):
    import gzip

    from cairnframe.plans.s3import import _records, number_rows

    (tmp_path / "a b.csv").write_bytes(b'a,"x\ny",b\r\n\nc,d\n"open\nto the end')
    (tmp_path / "ä.csv").write_bytes(b'1,2\n3,"4"\n')
    with gzip.open(tmp_path / "z.csv.gz", "wb") as f:
        f.write(b"5\n6\n")
    files = [str(tmp_path / n) for n in ("ä.csv", "z.csv.gz", "a b.csv")]
    got = [r["raw"] for r in number_rows(_records(spark, files)).orderBy("row_index").collect()]
    assert got == ["1,2", '3,"4"', "5", "6", 'a,"x\ny",b\r', "c,d", '"open\nto the end']


def test_a_report_of_many_blocks_keeps_its_order(spark, tmp_path):
    from cairnframe.plans.s3import import _records, number_rows

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for n in (0, 1):
            (tmp_path / f"{n}.csv").write_text("".join(f"{n},{i}\n" for i in range(5000)))
        records = _records(spark, [str(tmp_path / f"{n}.csv") for n in (1, 0)])
        assert records.select("file_no", "block").distinct().count() > 4
        rows = number_rows(records)
        assert [r["raw"] for r in rows.orderBy("row_index").collect()] == [f"{n},{i}" for n in (1, 0) for i in range(5000)]
        assert {r["row_index"] for r in rows.collect()} == set(range(1, 10_001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inventory_and_files_that_are_unsound(spark, tmp_path):
    from cairnframe.plans.s3import import find_file, read_inventory

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "i.json").write_text('{"fileFormat": "csv", "fileSchema": "Bucket, Key, Size", "files": [{"key": "x/i.csv"}]}')
    for text in ("b,k,\n", "b,k,1.5\n", "b,k\n", 'b,"k"x,1\n', "b,%zz,1\n"):
        (tmp_path / "m" / "i.csv").write_text("b,ok,9223372036854775807\n" + text)
        with pytest.raises(Exception):  # noqa: B017
            read_inventory(spark, inventory_manifest(str(tmp_path / "m" / "i.json"))).collect()
    (tmp_path / "m" / "i.csv").write_text("b,ok%20x, 9223372036854775807\n")
    (r,) = read_inventory(spark, inventory_manifest(str(tmp_path / "m" / "i.json"))).collect()
    assert (r["key"], r["size"]) == ("ok x", 2**63 - 1)
    (tmp_path / "i.csv").write_text("b,ok,1\n")
    with pytest.raises(ValueError, match="ambiguous"):
        inventory_manifest(str(tmp_path / "m" / "i.json"))
    with pytest.raises(FileNotFoundError):
        find_file("none.csv", [str(tmp_path)])
