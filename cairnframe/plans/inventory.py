"""Inventory of a tree into a store, and consolidation of many stores."""

from __future__ import annotations

import json
import os
import platform
import shutil
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnframe.functions.exec import cut
from cairnframe.functions.hashing import hash_twice
from cairnframe.functions.paths import sparse_nfc
from cairnframe.operators.reuse import exact_candidates, overlap_candidates, reuse_hashes
from cairnframe.plans.store import Store, local_identity, new_store_name, overlapping, remote_names
from cairnframe.sources.tree import read_tree, volume_facts

_HASHED = "rel_path string, name string, ext string, size long, mtime_ns long, state string, fingerprint string, sha256 string, err string"


def hash_rows(pending: DataFrame, root: str, parallelism: int | None = None) -> DataFrame:
    """Read and hash the files of pending rows on the executors, streaming, in `parallelism` tasks.

    Rows are spread by their paths, four tasks for each core unless told otherwise, so that a single folder with all
    files isn't one task; few tasks spare slow disks.
    """
    pending = pending.repartition(parallelism or 4 * pending.sparkSession.sparkContext.defaultParallelism, "rel_path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rel, name, ext, size, at in zip(*(pdf[c] for c in ("rel_path", "name", "ext", "size", "mtime_ns"))):
                state, ends, full, err, size, at = hash_twice(os.path.join(root, rel), int(size), int(at))
                rows.append((rel, name, ext, size, at, state, ends, full, err))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _HASHED.split(", ")])

    return pending.select("rel_path", "name", "ext", "size", "mtime_ns").mapInPandas(run, _HASHED)


def inventory(
    store: Store, root: str, exclude: list[str] | None = None, identity: tuple[str, str] | None = None, trusted_only: bool = False, parallelism: int | None = None,
    progress: Observation | None = None,
) -> int:
    """Scan a tree and publish its snapshot; the scan id.

    Unchanged files take the hashes of the root's own scans (newest failed one: trusted rows; authority: any, or trusted
    ones only) or of overlapping roots of the machine; all others are hashed. Anything that goes wrong leaves
    a failed scan whose files can be reused, and its Spark jobs are cancelled. A missing root raises. progress, an
    Observation, counts files discovered, reused, hashed and failed while they are written.
    """
    root = os.path.realpath(root)
    walked = read_tree(store.spark, root, exclude, skip=[store.path])
    machine, host = identity or local_identity(store.path)
    with store.guard(), store.root_lock(machine, root):
        store.adopt_orphans(machine, root)  # whose owner is gone, as the root is free
        m = store.manifest()
        scans = {s["scan_id"]: s for s in m["scans"] if s["machine_id"] == machine}
        current = {r["root"]: r["current_scan_id"] for r in m["roots"] if r["machine_id"] == machine}
        failed = max((i for i, s in scans.items() if s["root"] == root and s["status"] == "failed"), default=None)
        cols = ["rel_path", "size", "mtime_ns", "fingerprint", "sha256"]
        exact = store.spark.createDataFrame([], "rel_path string, size long, mtime_ns long, fingerprint string, sha256 string")
        if root in current:
            exact = exact.unionByName(exact_candidates(store.entries(current[root], m), trusted_only).select(*cols))
        if failed is not None:
            exact = exact.unionByName(exact_candidates(store.entries(failed, m), True).select(*cols))
        overlap = None
        for r, i in current.items():
            if r != root and overlapping(r, root):
                rows = overlap_candidates(root, store.entries(i, m).withColumn("root", F.lit(r))).select(*cols)
                overlap = rows if overlap is None else overlap.unionByName(rows)
        kind, case = volume_facts(root)
        facts = {"goos": platform.system().lower(), "goarch": platform.machine(), "fs_type": kind, "case_sensitive": case}
        scan = store.create_scan(machine, host, root, **facts)
        context, group = store.spark.sparkContext, f"scan-{scan}"
        context.setJobGroup(group, f"inventory of {root}", True)
        try:
            walked = cut(walked)  # one walk, which all branches below read
            looked = cut(reuse_hashes(walked.where("state = 'pending'"), exact, overlap))
            kept = looked.where("reused").withColumn("state", F.lit("reused")).drop("reused")
            fresh = hash_rows(looked.where(~F.col("reused")), root, parallelism)
            errors = walked.where("state = 'error'").withColumns({"fingerprint": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")})
            names = [c.split()[0] for c in _HASHED.split(", ")]
            rows = kept.select(*names).unionByName(fresh.select(*names)).unionByName(errors.select(*names))
            if progress is not None:
                counts = {"reused": ("reused",), "hashed": ("ok", "unstable"), "failed": ("error", "vanished")}
                rows = rows.observe(progress, F.count(F.lit(1)).alias("discovered"), *(F.count_if(F.col("state").isin(*v)).alias(k) for k, v in counts.items()))
            store.write_entries(scan, rows.withColumn("rel_path_norm", sparse_nfc(F.col("rel_path"))))
            store.publish(scan)
        except BaseException:
            context.cancelJobGroup(group)
            store.fail(scan)
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
    return scan


class SnapshotTransport(Protocol):
    def fetch(self, remote: str, into: str) -> str | None:
        """Copy the newest store of a remote below `into`; its path, or None if the remote can't be reached."""


class LocalTransport:
    """Remotes are folders of stores."""

    def __init__(self, folders: dict[str, str]):
        self.folders = folders

    def fetch(self, remote: str, into: str) -> str | None:
        base = self.folders.get(remote)
        found = stores_in(base) if base and os.path.isdir(base) else []
        if not found:
            return None
        newest = max(found, key=lambda p: os.stat(os.path.join(p, "manifest.json")).st_mtime_ns)
        return shutil.copytree(newest, os.path.join(into, f".fetch-{new_store_name()}"))


def stores_in(folder: str) -> list[str]:
    """Stores of a folder in the order of their names; names that begin with a dot are temporary."""
    paths = [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if not n.startswith(".")]
    return [p for p in paths if os.path.isfile(os.path.join(p, "manifest.json"))]


def consolidate(spark: SparkSession, folder: str, transport: SnapshotTransport | None = None, identity: tuple[str, str] | None = None) -> str:
    """Merge all stores of a folder and its remotes into one; its path.

    Local stores come in the order of their names and the last one wins, whatever its time. Then machines of remotes that
    are no longer named go, then the remotes' stores come, then machines that a remote no longer reports go. The
    result is published by a rename; only then are the inputs removed. An error leaves the inputs as they are.
    """
    os.makedirs(folder, exist_ok=True)
    remotes_file, state_file = os.path.join(folder, "remotes"), os.path.join(folder, "remotes-state.json")
    remotes = remote_names(open(remotes_file, encoding="utf-8").read()) if os.path.exists(remotes_file) else []
    state: dict[str, list[str]] = json.load(open(state_file, encoding="utf-8")) if os.path.exists(state_file) else {}
    fetched: dict[str, str] = {}
    target = os.path.join(folder, f".build-{new_store_name()}")
    try:
        for r in remotes:
            if transport is not None and (path := transport.fetch(r, folder)):
                fetched[r] = path
        local = stores_in(folder)
        named = {m for r in remotes for m in state.get(r, [])}
        removed = sorted({m for a, ids in state.items() if a not in remotes for m in ids} - named)
        if not local and not fetched:
            path = os.path.join(folder, new_store_name())
            Store(spark, path).commit(lambda m: None)
            return path
        if len(local) == 1 and not fetched and not removed:
            return local[0]
        store = Store(spark, target)
        machine, host = identity or local_identity(folder)
        store.set_metadata(local_machine_id=machine, local_hostname=host)
        for path in local:
            store.import_from(Store(spark, path))
        store.delete_machines(removed)
        for r, path in fetched.items():
            ids = store.import_from(Store(spark, path))
            store.delete_machines(sorted(set(state.get(r, [])) - set(ids)))
            state[r] = ids
        state = {a: sorted(set(ids)) for a, ids in state.items() if a in remotes}
        final = os.path.join(folder, new_store_name())
        os.rename(target, final)
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise
    finally:
        for path in fetched.values():
            shutil.rmtree(path, ignore_errors=True)
    for path in local:
        shutil.rmtree(path, ignore_errors=True)
    with open(state_file + ".tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, indent=2, sort_keys=True)
    os.replace(state_file + ".tmp", state_file)
    return final
