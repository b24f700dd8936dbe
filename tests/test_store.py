import gzip
import json
import os

import pytest

from cairnframe.plans import inventory as inv
from cairnframe.plans.store import Overlap, SnapshotGone, Store, local_identity, new_store_name, remote_names
from cairnframe.sources.tree import read_tree

ME = ("m1", "host-1")


def put(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def states(store, scan):
    return {r["rel_path"]: r["state"] for r in store.entries(scan).collect()}


def test_tree_source(spark, tmp_path):
    put(tmp_path, a="1", b__c="22", b__d__e="333", skip__x="4")
    (tmp_path / ".hidden.TXT").write_text("h")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = {r["rel_path"]: r for r in read_tree(spark, str(tmp_path), ["skip/", "e"]).collect()}
    assert set(got) == {"a", "b/c", ".hidden.TXT"}
    assert got[".hidden.TXT"]["ext"] == ".txt"
    assert got["a"]["mtime_ns"] == os.stat(tmp_path / "a").st_mtime_ns
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        read_tree(spark, str(tmp_path), ["a/b"])


def test_inventory_reuses_and_replaces(spark, tmp_path):
    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    put(tree, hello="x", sub__deep__file="yy")
    first = inv.inventory(store, str(tree), identity=ME)
    assert states(store, first) == {"hello": "ok", "sub/deep/file": "ok"}
    put(tree, hello="changed")
    from pyspark.sql import Observation

    seen = Observation("scan")
    second = inv.inventory(store, str(tree), identity=ME, progress=seen)
    assert seen.get == {"discovered": 2, "reused": 1, "hashed": 1, "failed": 0}
    assert states(store, second) == {"hello": "ok", "sub/deep/file": "reused"}
    assert [s["scan_id"] for s in store.manifest()["scans"]] == [second]
    store.vacuum(0)  # replaced files stay for a while for the readers of older versions
    assert not os.path.exists(os.path.join(store.path, "entries", f"scan_id={first}"))


def test_overlapping_roots_are_reused(spark, tmp_path):
    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    put(tree, top="t", raw__photo="p", raw__nested__f="f", **{"raw-archive__z": "z"})
    inv.inventory(store, str(tree / "raw"), identity=ME)
    parent = inv.inventory(store, str(tree), identity=ME)
    assert states(store, parent) == {"top": "ok", "raw/photo": "reused", "raw/nested/f": "reused", "raw-archive/z": "ok"}
    child = inv.inventory(store, str(tree / "raw" / "nested"), identity=ME)
    assert states(store, child) == {"f": "reused"}


def test_failed_scan_is_kept_for_reuse(spark, tmp_path):
    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    put(tree, a="1", b="2")
    done = inv.inventory(store, str(tree), identity=ME)
    rows = store.entries(done)
    rows.cache().count()
    lost = store.create_scan(*ME, str(tree))
    store.write_entries(lost, rows.where("rel_path = 'a'"))
    store.commit(lambda m: m.update(roots=[], scans=[s for s in m["scans"] if s["scan_id"] == lost]))
    again = inv.inventory(store, str(tree), identity=ME)  # adopts the scan that nobody works on any more
    assert states(store, again) == {"a": "reused", "b": "ok"}
    assert store.adopt_orphans(ME[0], str(tree)) == 0


def test_only_a_roots_own_scans_are_adopted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for machine, root in (("m1", "/a"), ("m1", "/b"), ("m2", "/a")):
        store.create_scan(machine, "h", root)
    assert store.adopt_orphans("m1", "/a") == 1
    assert [s["status"] for s in store.manifest()["scans"]] == ["failed", "running", "running"]


def test_readers_of_an_older_version(spark, tmp_path):
    from cairnframe.plans.api import Browser

    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    put(tree, a="1", b="2")
    inv.inventory(store, str(tree), identity=ME)
    browser, at = Browser(store), (ME[0], str(tree))
    put(tree, c="3")
    inv.inventory(store, str(tree), identity=ME)
    assert browser.summary(*at)["files"] == 2 and Browser(store).summary(*at)["files"] == 3
    store.vacuum(0)
    assert store.manifest()["retired"] == []
    with pytest.raises(SnapshotGone):
        browser.summary(*at)
    assert Browser(store).summary(*at)["files"] == 3
    with pytest.raises(SnapshotGone):
        store.entries(10**6)


def test_names_that_are_not_utf8(spark, tmp_path):
    put(tmp_path, a="1")
    os.mkdir(os.fsencode(tmp_path) + b"/d\xff")
    for name in (b"/x\xfe.txt", b"/d\xff/y"):
        with open(os.fsencode(tmp_path) + name, "w") as f:
            f.write("1")
    got = {(r["rel_path"], r["state"]) for r in read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a", "pending"), ("x\\xfe.txt", "error"), ("d\\xff/y", "error")}


def test_anything_wrong_leaves_a_failed_scan(spark, tmp_path, monkeypatch):
    tree, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    put(tree, a="1")
    monkeypatch.setattr(inv, "hash_rows", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        inv.inventory(store, str(tree), identity=ME)
    assert [s["status"] for s in store.manifest()["scans"]] == ["failed"] and not store.manifest()["roots"]


def test_root_lock(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with store.root_lock("m", "/data/raw"):
        for root in ("/data/raw", "/data", "/data/raw/x"):
            with pytest.raises(Overlap), store.root_lock("m", root):
                pass
        with store.root_lock("m", "/data/raw-archive"), store.root_lock("n", "/data"):
            pass
    with store.root_lock("m", "/data"):
        pass


def bundle(folder, rows, inventory=None):
    os.makedirs(folder)
    with open(f"{folder}/r.csv", "w") as f:
        f.write("Bucket,Key,VersionId,TaskStatus,ErrorCode,HTTPStatusCode,ResultMessage\n")
        for bucket, key, status, kind in rows:
            message = json.dumps({"checksumAlgorithm": "SHA256", "checksumType": kind, "checksum_hex": "AB" * 32}).replace('"', '""')
            f.write(f'{bucket},{key},null,{status},200,,"{message}"\n')
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump({"ReportSchema": "S", "Results": [{"Key": "job/results/r.csv"}]}, f)
    if inventory:
        with gzip.open(f"{folder}/i.csv.gz", "wt") as f:
            f.write(inventory)
        with open(f"{folder}/inventory.json", "w") as f:
            json.dump({"fileFormat": "CSV", "fileSchema": "Bucket, Key, VersionId, Size, LastModifiedDate", "files": [{"key": "data/i.csv.gz"}]}, f)
    return f"{folder}/manifest.json"


def test_report_import(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    m = bundle(
        str(tmp_path / "one"),
        [("b1", "a.txt", "succeeded", "FULL_OBJECT"), ("b1", "c.txt", "succeeded", "COMPOSITE"), ("b2", "x", "succeeded", "FULL_OBJECT"),
         ("b1", "dir/", "succeeded", "FULL_OBJECT"), ("b3", "f", "failed", "FULL_OBJECT")],
    )
    s = store.import_s3(m)
    want = {"rows_total": 5, "rows_succeeded": 4, "rows_usable": 2, "rows_failed": 1, "rows_unsupported": 1, "rows_folder_markers": 1, "rows_with_size": 0}
    assert want.items() <= s.items()
    roots = {r["root"]: r["current_scan_id"] for r in store.manifest()["roots"]}
    assert set(roots) == {"s3://b1", "s3://b2", "s3://b3"}
    assert store.entries(roots["s3://b3"]).count() == 0
    assert [r["row_index"] for r in store.table("s3_report_rows").orderBy("row_index").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="usable rows"):
        store.import_s3(bundle(str(tmp_path / "two"), [("b1", "a", "succeeded", "FULL_OBJECT")] * 2))
    inventory = 'b1,photos%2Fa+space.jpg,,12345,2026-05-04T14:15:16.000Z\n'
    m = bundle(str(tmp_path / "three"), [("b1", "photos%2Fa+space.jpg", "succeeded", "FULL_OBJECT")], inventory)
    s = store.import_s3(m, str(tmp_path / "three" / "inventory.json"))
    assert s["rows_with_size"] == 1
    new = {r["root"]: r["current_scan_id"] for r in store.manifest()["roots"]}
    assert new["s3://b2"] == roots["s3://b2"] and new["s3://b1"] != roots["s3://b1"]
    (e,) = store.entries(new["s3://b1"]).collect()
    assert (e["rel_path"], e["ext"], e["size"], e["mtime_ns"], e["sha256"]) == ("photos/a space.jpg", ".jpg", 12345, 1777904116 * 10**9, "ab" * 32)


def fragment(spark, folder, machine, root, size):
    store = Store(spark, folder)
    n = store.create_scan(machine, machine + "-host", root)
    store.write_entries(n, spark.createDataFrame([("a", size)], "rel_path string, size long").selectExpr("rel_path", "'a' AS name", "'' AS ext", "size", "0L AS mtime_ns"))
    store.publish(n)
    return store


def test_consolidation(spark, tmp_path):
    folder = str(tmp_path / "stores")
    fragment(spark, f"{folder}/aaa", "m1", "/data", 1)
    fragment(spark, f"{folder}/bbb", "m1", "/data", 2)
    fragment(spark, f"{tmp_path}/far/zzz", "m2", "/far", 3)
    with open(f"{folder}/remotes", "w") as f:
        f.write("# remotes\nfar\n")
    transport = inv.LocalTransport({"far": f"{tmp_path}/far"})
    out = Store(spark, inv.consolidate(spark, folder, transport, ME))
    got = {r["machine_id"]: [e["size"] for e in out.entries(r["current_scan_id"]).collect()] for r in out.manifest()["roots"]}
    assert got == {"m1": [2], "m2": [3]}
    assert inv.stores_in(folder) == [out.path]
    with open(f"{folder}/remotes", "w"):
        pass
    out = Store(spark, inv.consolidate(spark, folder, transport, ME))
    assert [r["machine_id"] for r in out.manifest()["roots"]] == ["m1"]
    assert inv.consolidate(spark, folder, transport, ME) == out.path
    broken = fragment(spark, f"{folder}/zzz", "m3", "/x", 4)
    with open(f"{broken.path}/manifest.json", "w") as f:
        f.write("{")
    with pytest.raises(ValueError):
        inv.consolidate(spark, folder, transport, ME)
    assert len(inv.stores_in(folder)) == 2


def test_delete_machine_and_names(spark, tmp_path):
    store = fragment(spark, str(tmp_path / "s"), "m1", "/data", 1)
    store.delete_machines(["", "m1"])
    assert store.manifest()["roots"] == store.manifest()["scans"] == [] and store.table("entries").count() == 0
    assert remote_names("# c\nnas\n\nbox\nnas") == ["nas", "box"]
    for bad in ("-x", "a/b", "a b"):
        with pytest.raises(ValueError):
            remote_names(bad)
    a = local_identity(str(tmp_path / "id"))
    assert a == local_identity(str(tmp_path / "id"))
    (tmp_path / "id" / "machine-id").write_text("")
    with pytest.raises(ValueError):
        local_identity(str(tmp_path / "id"))
    assert len(new_store_name()) >= 10 and new_store_name().isalnum()


def database(path, scans, entries, old=False):
    import sqlite3

    c = sqlite3.connect(path)
    who = "" if old else "machine_id TEXT, hostname TEXT, "
    c.execute(f"CREATE TABLE scans (scan_id INTEGER PRIMARY KEY, {who}root TEXT, started_at INTEGER, finished_at INTEGER, status TEXT)")
    c.execute(f"CREATE TABLE roots ({'' if old else 'machine_id TEXT, '}root TEXT, current_scan_id INTEGER)")
    c.execute("CREATE TABLE entries (scan_id INTEGER, rel_path TEXT, name TEXT, ext TEXT, size INTEGER, mtime_ns INTEGER, sha256 TEXT, PRIMARY KEY (scan_id, rel_path))")
    for n, machine, root, current in scans:
        c.execute(f"INSERT INTO scans VALUES (?, {'' if old else '?, ?, '}?, 1, 2, 'complete')", (n, *(() if old else (machine, "h")), root))
        if current:
            c.execute(f"INSERT INTO roots VALUES ({'' if old else '?, '}?, ?)", (*(() if old else (machine,)), root, n))
    c.executemany("INSERT INTO entries VALUES (?, ?, 'n', '', ?, 0, 'AB')", entries)
    c.commit()
    c.close()


def test_a_database_is_taken_over(spark, tmp_path):
    path, decomposed = str(tmp_path / "a b.db"), "re\u0301union"
    many = [(1, f"f{i}", i) for i in range(25_000)]
    database(path, [(1, "m1", "/a", True), (2, "m1", "/b", False), (3, "m2", "/a", True)], [*many, (2, "x", 1), (3, decomposed, 7)])
    store = Store(spark, str(tmp_path / "store"))
    fragment(spark, str(tmp_path / "store"), "m2", "/a", 1)
    assert store.import_database(path, "me", "here") == ["m1", "m2"]
    current = {(r["machine_id"], r["root"]): r["current_scan_id"] for r in store.manifest()["roots"]}
    assert set(current) == {("m1", "/a"), ("m2", "/a")}
    assert store.entries(current["m1", "/a"]).count() == 25_000
    (e,) = store.entries(current["m2", "/a"]).collect()
    assert (e["rel_path"], e["rel_path_norm"], e["size"], e["sha256"]) == (decomposed, "r\u00e9union", 7, "AB")


def test_an_older_database_and_none(spark, tmp_path):
    import sqlite3

    database(str(tmp_path / "old.db"), [(5, None, "/a", True)], [(5, "x", 1)], old=True)
    store = Store(spark, str(tmp_path / "store"))
    assert store.import_database(str(tmp_path / "old.db"), "me", "here") == ["me"]
    (s,) = store.manifest()["scans"]
    assert (s["machine_id"], s["hostname"], s["root"], s["status"]) == ("me", "here", "/a", "complete")
    assert [r["rel_path"] for r in store.entries(s["scan_id"]).collect()] == ["x"]
    sqlite3.connect(tmp_path / "none.db").close()
    (tmp_path / "text.db").write_text("no database at all" * 100)
    for name in ("none.db", "text.db"):
        with pytest.raises((ValueError, OSError, sqlite3.DatabaseError)):
            store.import_database(str(tmp_path / name), "me", "here")
