"""Roots, directories, summaries and duplicate files of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.paths import ancestors, is_noise, prefix, trimmed, under
from cairnframe.functions.values import known_hash

#: States whose hashes can be trusted.
TRUSTED = ("ok", "reused")


def current_scans(roots: DataFrame, scans: DataFrame) -> DataFrame:
    """Roots whose current scan exists, with that scan's columns; ordered by hostname and root."""
    s = scans.drop("machine_id", "root").distinct()
    return roots.distinct().join(s, roots["current_scan_id"] == s["scan_id"]).drop("scan_id").orderBy("hostname", "root")


def current_scan_id(roots: DataFrame, machine_id: str, root: str) -> int:
    """The scan a root points to, for use as a literal that prunes partitions; LookupError where there is none."""
    row = roots.where((F.col("machine_id") == machine_id) & (F.col("root") == root)).select("current_scan_id").first()
    if row is None or row[0] is None:
        raise LookupError(f"no scan for {machine_id}:{root}")
    return row[0]


def directories(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dir): every distinct directory above the files."""
    return entries.select(*keys, F.explode(ancestors(F.col("rel_path"))).alias("dir")).distinct()


def scan_summary(entries: DataFrame) -> DataFrame:
    """(scan_id, state, files): files by state, each path once; NULL and '' states are `unknown` together."""
    state = F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit("unknown"))
    return entries.select("scan_id", "rel_path", state.alias("state")).distinct().groupBy("scan_id", "state").agg(F.count(F.lit(1)).alias("files"))


def interrupted_scans(scans: DataFrame, entries: DataFrame) -> DataFrame:
    """(machine_id, root, scan_id, reusable): the newest failed scan of every root and its rows that can be reused."""
    last = scans.where(F.col("status") == "failed").groupBy("machine_id", "root").agg(F.max("scan_id").alias("scan_id"))
    good = entries.where(F.col("state").isin(*TRUSTED) & known_hash("sha256").isNotNull()).select("scan_id", "rel_path").distinct()
    n = good.groupBy("scan_id").agg(F.count(F.lit(1)).alias("reusable"))
    return last.join(n, "scan_id", "left").select("machine_id", "root", "scan_id", F.coalesce("reusable", F.lit(0)).cast("long").alias("reusable"))


def duplicate_files(entries: DataFrame, keys: list[str], under_prefix: str = "", ignore_noise: bool = False) -> DataFrame:
    """(keys, size, sha256, rel_path) of the files that share size and known hash with another; paths trimmed.

    Groups with one row are dropped by an aggregation of the small (size, sha256) pairs before any path is shuffled.
    """
    p = prefix(under_prefix)
    rows = entries.where(under(F.col("rel_path"), p)) if p else entries
    if ignore_noise:
        rows = rows.where(~is_noise(F.col("name"), F.col("rel_path")))
    rows = rows.select(*keys, "size", known_hash("sha256").alias("sha256"), trimmed(F.col("rel_path"), p).alias("rel_path"))
    rows = rows.where(F.col("sha256").isNotNull()).distinct()
    groups = rows.groupBy(*keys, "size", "sha256").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).drop("n")
    return rows.join(groups, [*keys, "size", "sha256"], "left_semi").select(*keys, "size", "sha256", "rel_path")


def duplicate_groups(entries: DataFrame, **options) -> DataFrame:
    """(size, sha256, files) of one snapshot, largest first, for display; a group's files are one array."""
    rows = duplicate_files(entries, [], **options)
    groups = rows.groupBy("size", "sha256").agg(F.array_sort(F.collect_list("rel_path")).alias("files"))
    return groups.orderBy(F.desc("size"), "sha256")
