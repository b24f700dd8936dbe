"""A store of snapshots: Parquet by scan, and a manifest whose replacement is the commit.

Readers see one manifest version; a writer stages a scan's partition first and names it in the next version. Locks
are advisory file locks of the driver, so the folder has to be on a file system that drivers share.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import secrets
import shutil
import socket
import string
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.exec import ship_package, sized
from cairnframe.schemas import ENTRIES, S3_IMPORTS, S3_REPORT_ROWS, SCANS, TABLES, upgrade

EMPTY = {"retired": [], "version": 0, "next_scan_id": 1, "next_import_id": 1, "metadata": {}, "roots": [], "scans": [], "s3_imports": []}


class Overlap(RuntimeError):
    """Another scan of the same machine works on an overlapping root."""


class SnapshotGone(LookupError):
    """The scan was replaced and its files were removed; open the store anew."""


#: Seconds that the files of a replaced scan stay for readers of an older manifest.
RETAIN_SECONDS = 24 * 3600


class Store:
    def __init__(self, spark: SparkSession, path: str, retain_seconds: float = RETAIN_SECONDS):
        self.spark, self.path, self.retain_seconds = spark, os.path.abspath(path), retain_seconds
        ship_package(spark)
        os.makedirs(os.path.join(self.path, "locks"), exist_ok=True)

    # ---- manifest
    def manifest(self) -> dict:
        try:
            with open(os.path.join(self.path, "manifest.json"), encoding="utf-8") as f:
                return json.loads(json.dumps(EMPTY)) | json.load(f)
        except FileNotFoundError:
            return json.loads(json.dumps(EMPTY))

    def commit(self, change: Callable[[dict], object]) -> object:
        """Apply a change to the newest manifest under the commit lock and replace it in one step."""
        with self._locked("commit", exclusive=True):
            m = self.manifest()
            out = change(m)
            m["version"] += 1
            tmp = os.path.join(self.path, f".manifest-{uuid.uuid4().hex}")
            with open(tmp, "w", encoding="utf-8") as f:
                json.dump(m, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(tmp, os.path.join(self.path, "manifest.json"))
            return out

    # ---- tables
    def table(self, name: str) -> DataFrame:
        """A table of the manifest's newest version."""
        m = self.manifest()
        if name == "entries":
            return self._parquet("entries", "scan_id", m["scans"], ENTRIES)
        if name == "s3_report_rows":
            return self._parquet("s3_report_rows", "import_id", m["s3_imports"], S3_REPORT_ROWS)
        if name == "metadata":
            return self.spark.createDataFrame(list(m["metadata"].items()), TABLES["metadata"])
        schema = TABLES[name]
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in m[name]], schema)

    def entries(self, scan_id: int, manifest: dict | None = None) -> DataFrame:
        """One scan of a manifest (the newest one): the id is a literal of the path, so no other partition is listed.

        SnapshotGone if the manifest doesn't know the scan, or names files of it that aren't there any more.
        """
        found = [s for s in (manifest or self.manifest())["scans"] if s["scan_id"] == scan_id]
        if not found:
            raise SnapshotGone(f"scan {scan_id} isn't in the manifest")
        return self._parquet("entries", "scan_id", found, ENTRIES)

    def _folder(self, name: str, key: str, number: int) -> str:
        return os.path.join(self.path, name, f"{key}={number}")

    def _parquet(self, name: str, key: str, owners: list[dict], schema) -> DataFrame:
        """Rows of the owners (scans or imports); those without `stored` may have no files."""
        paths = []
        for o in owners:
            path = self._folder(name, key, o[key])
            if os.path.isdir(path):
                paths.append(path)
            elif o.get("stored"):
                raise SnapshotGone(f"the files of {key} {o[key]} were removed")
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", os.path.join(self.path, name)).parquet(*paths)
        return read.select(*schema.names)

    def _write(self, name: str, key: str, number: int, rows: DataFrame, sort: str) -> None:
        rows.drop(key).sortWithinPartitions(sort).write.mode("overwrite").parquet(self._folder(name, key, number))

    # ---- life of a scan
    def create_scan(self, machine_id: str, hostname: str, root: str, **facts) -> int:
        def change(m: dict) -> int:
            n = m["next_scan_id"]
            m["next_scan_id"] += 1
            row = dict.fromkeys(SCANS.names) | facts
            m["scans"].append(row | {"scan_id": n, "machine_id": machine_id, "hostname": hostname, "root": root, "started_at": time.time_ns(), "status": "running"})
            return n

        return self.commit(change)

    def write_entries(self, scan_id: int, rows: DataFrame) -> None:
        self._write("entries", "scan_id", scan_id, upgrade(rows.withColumn("scan_id", F.lit(scan_id)), "entries"), "rel_path")

    def publish(self, scan_id: int) -> None:
        """The scan becomes its root's authority and the root's other scans go; their files stay for a while."""

        def change(m: dict) -> None:
            s = next(s for s in m["scans"] if s["scan_id"] == scan_id)
            m["scans"].remove(s)
            self._replace(m, [s | {"status": "complete", "finished_at": time.time_ns()}])

        self.commit(change)
        self.vacuum()

    def fail(self, scan_id: int) -> None:
        """Keep what was staged; it may be reused."""
        self._end(lambda s: s["scan_id"] == scan_id)

    def adopt_orphans(self, machine_id: str, root: str) -> int:
        """The running scans of a root that nobody works on any more become failed; the caller has to hold its root_lock.

        A finished_at that is there stays. Their number.
        """
        return self._end(lambda s: s["machine_id"] == machine_id and s["root"] == root)

    def _end(self, which: Callable[[dict], bool]) -> int:
        def change(m: dict) -> int:
            found = [s for s in m["scans"] if s["status"] == "running" and which(s)]
            for s in found:
                s |= {"status": "failed", "finished_at": s["finished_at"] or time.time_ns(), "stored": self._stored(s)}
            return len(found)

        return self.commit(change)

    def _stored(self, scan: dict) -> bool:
        return os.path.isdir(self._folder("entries", "scan_id", scan["scan_id"]))

    def vacuum(self, retain_seconds: float | None = None) -> None:
        """Remove the files of scans that were replaced at least so many seconds ago (the store's retain_seconds)."""
        before = time.time() - (self.retain_seconds if retain_seconds is None else retain_seconds)
        old = [r for r in self.manifest()["retired"] if r["at"] <= before]
        for r in old:
            shutil.rmtree(self._folder("entries", "scan_id", r["scan_id"]), ignore_errors=True)
        if old:
            self.commit(lambda m: m.update(retired=[r for r in m["retired"] if r not in old]))

    @staticmethod
    def _retire(m: dict, scans: list[dict]) -> None:
        m["retired"] += [{"scan_id": s["scan_id"], "at": time.time()} for s in scans]

    def delete_machines(self, machines: list[str]) -> None:
        ids = {x for x in machines if x}

        def change(m: dict) -> None:
            self._retire(m, [s for s in m["scans"] if s["machine_id"] in ids])
            m["scans"] = [s for s in m["scans"] if s["machine_id"] not in ids]
            m["roots"] = [r for r in m["roots"] if r["machine_id"] not in ids]

        self.commit(change)
        self.vacuum()

    def set_metadata(self, **values: str) -> None:
        self.commit(lambda m: m["metadata"].update(values))

    def _write_scans(self, rows: DataFrame, ids: DataFrame, on: str) -> None:
        """Stage the entries of many scans in one job: ids maps `on` to their new scan_id. Nobody sees them before a commit."""
        moved = rows.join(sized(ids.withColumnRenamed("scan_id", "__new")), on).withColumn("scan_id", F.col("__new"))
        shaped = upgrade(moved, "entries")
        sorted_ = shaped.repartition("scan_id", F.pmod(F.xxhash64("rel_path"), F.lit(8))).sortWithinPartitions("scan_id", "rel_path")
        sorted_.write.mode("append").partitionBy("scan_id").parquet(os.path.join(self.path, "entries"))

    def import_from(self, other: "Store") -> list[str]:
        """Take over the other store's current scans under new ids; equal (machine, root) are replaced. Its machine ids."""
        theirs = other.manifest()
        live = {(r["machine_id"], r["root"], r["current_scan_id"]) for r in theirs["roots"]}
        taken = [s for s in theirs["scans"] if (s["machine_id"], s["root"], s["scan_id"]) in live]
        if taken:
            self._take(taken, other._parquet("entries", "scan_id", taken, ENTRIES))
        return sorted({m for m, _, _ in live}) if taken else []

    def import_database(self, path: str, machine_id: str, hostname: str) -> list[str]:
        """Take over the current scans of an inventory in a SQLite file, also one of an older layout; its machine ids.

        machine_id and hostname are those of scans that name none. ValueError for a file that is no inventory.
        """
        from cairnframe.schemas import is_compatible
        from cairnframe.sources.sqlite import columns_of, read_sqlite, rows_of

        if not is_compatible({t: set(c) for t, c in columns_of(path).items()}):
            raise ValueError(f"{path} holds no inventory")
        own = {"machine_id": machine_id, "hostname": hostname}
        live = {(r.get("machine_id", machine_id), r["root"], r["current_scan_id"]) for r in rows_of(path, "roots")}
        scans = [dict.fromkeys(SCANS.names) | own | r for r in rows_of(path, "scans")]
        taken = [{k: s[k] for k in SCANS.names} for s in scans if (s["machine_id"], s["root"], s["scan_id"]) in live]
        if taken:
            rows = read_sqlite(self.spark, path, "entries", ENTRIES)
            self._take(taken, upgrade(rows, "entries"))
        return sorted({s["machine_id"] for s in taken})

    def _take(self, taken: list[dict], rows: DataFrame) -> None:
        """One job stages the entries of all scans under new ids, one commit shows them."""
        from cairnframe.functions.paths import backfill

        first = self.commit(lambda m: m.update(next_scan_id=m["next_scan_id"] + len(taken)) or m["next_scan_id"] - len(taken))
        new = {s["scan_id"]: first + i for i, s in enumerate(taken)}
        ids = self.spark.createDataFrame(list(new.items()), "old long, scan_id long")
        self._write_scans(backfill(rows.withColumnRenamed("scan_id", "old")), ids, "old")
        self.commit(lambda m: self._replace(m, [s | {"scan_id": new[s["scan_id"]]} for s in taken]))
        self.vacuum()

    def _replace(self, m: dict, scans: list[dict]) -> None:
        """Put complete scans in place of all others of their roots."""
        roots = {(s["machine_id"], s["root"]) for s in scans}
        of = lambda s: (s["machine_id"], s["root"]) in roots
        self._retire(m, [s for s in m["scans"] if of(s)])
        m["scans"] = [s for s in m["scans"] if not of(s)] + [s | {"stored": self._stored(s)} for s in scans]
        m["roots"] = [r for r in m["roots"] if (r["machine_id"], r["root"]) not in roots]
        m["roots"] += [{"machine_id": s["machine_id"], "root": s["root"], "current_scan_id": s["scan_id"]} for s in scans]

    def import_s3(self, manifest: str, inventory: str | None = None, machine_id: str = "s3") -> dict[str, int]:
        """Import a checksum report as one commit: everything is staged and checked first, then all buckets change at once."""
        from cairnframe.plans.s3import import import_report

        found = import_report(self.spark, manifest, inventory)

        def reserve(m: dict) -> tuple[int, int]:
            i, n = m["next_import_id"], m["next_scan_id"]
            m["next_import_id"] += 1
            m["next_scan_id"] += len(found.buckets)
            return i, n

        number, first = self.commit(reserve)
        now = time.time_ns()
        self._write("s3_report_rows", "import_id", number, upgrade(found.rows.withColumn("import_id", F.lit(number)), "s3_report_rows"), "row_index")
        ids = {b: first + i for i, b in enumerate(found.buckets)}
        mapped = self.spark.createDataFrame(list(ids.items()), "bucket string, scan_id long")
        self._write_scans(found.entries, mapped, "bucket")

        def change(m: dict) -> None:
            scans = [
                dict.fromkeys(SCANS.names)
                | {"scan_id": i, "machine_id": machine_id, "hostname": machine_id, "root": f"s3://{b}", "started_at": now, "finished_at": time.time_ns(), "status": "complete"}
                for b, i in sorted(ids.items())
            ]
            self._replace(m, scans)
            m["s3_imports"].append({f.name: None for f in S3_IMPORTS.fields} | found.summary | {"import_id": number, "manifest_path": manifest, "report_schema": found.report_schema, "imported_at": now})

        self.commit(change)
        self.vacuum()
        return found.summary

    # ---- locks
    @contextmanager
    def _locked(self, name: str, exclusive: bool, wait: bool = True) -> Iterator[None]:
        with open(os.path.join(self.path, "locks", name + ".lock"), "a+") as f:
            fcntl.flock(f, (fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH) | (0 if wait else fcntl.LOCK_NB))
            yield

    def guard(self, exclusive: bool = False, wait: bool = False):
        """Shared for scans, exclusive for consolidation; BlockingIOError if it isn't free."""
        return self._locked("guard", exclusive, wait)

    @contextmanager
    def root_lock(self, machine_id: str, root: str) -> Iterator[None]:
        """Hold a root; Overlap if a living scan of the machine holds it, or one above or below it."""
        folder = os.path.join(self.path, "locks", "roots")
        os.makedirs(folder, exist_ok=True)
        name = hashlib.sha256(f"{machine_id}\0{root}".encode()).hexdigest()[:24]
        mine = os.path.join(folder, name)
        with self._locked("roots", exclusive=True):
            for other in os.listdir(folder):
                with open(os.path.join(folder, other), "a+") as f:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        continue  # its owner is gone
                    except BlockingIOError:
                        f.seek(0)
                        held = json.loads(f.read() or "{}")
                if held.get("machine_id") == machine_id and overlapping(held.get("root", ""), root):
                    raise Overlap(f"{held['root']} is being scanned, which overlaps {root}")
            f = open(mine, "w")  # noqa: SIM115
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write(json.dumps({"machine_id": machine_id, "root": root}))
            f.flush()
        try:
            yield
        finally:
            os.unlink(mine)
            f.close()


def overlapping(a: str, b: str) -> bool:
    """Same root, or one above the other, by whole components."""
    x, y = a.rstrip("/") + "/", b.rstrip("/") + "/"
    return x.startswith(y) or y.startswith(x)


def new_store_name(length: int = 12) -> str:
    """A random name of at least ten letters and digits."""
    return "".join(secrets.choice(string.ascii_lowercase + string.digits) for _ in range(max(10, length)))


def local_identity(folder: str) -> tuple[str, str]:
    """(machine id, hostname): the id in the file machine-id of the folder, made once; an empty file is an error."""
    path = os.path.join(folder, "machine-id")
    try:
        with open(path, encoding="utf-8") as f:
            found = f.read().strip()
        if not found:
            raise ValueError(f"{path} is empty")
    except FileNotFoundError:
        found = str(uuid.uuid4())
        os.makedirs(folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(found + "\n")
    return found, socket.gethostname() or "unknown-host"


def remote_names(text: str) -> list[str]:
    """Names of a remotes file: one token a line, `#` comments; options and paths are refused, repeats dropped."""
    out: list[str] = []
    for i, line in enumerate(text.splitlines(), 1):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if len(words) != 1 or words[0].startswith("-") or re.search(r"[/\\]", words[0]):
            raise ValueError(f"line {i}: {line.strip()!r} isn't the name of a remote")
        if words[0] not in out:
            out.append(words[0])
    return out
