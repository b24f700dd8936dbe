"""Merging snapshots of many stores and machines into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(tagged: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: that of the last fragment by `order` (ties: the largest row). Time plays no part."""
    rest = [c for c in tagged.columns if c not in key]
    best = tagged.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("s"))
    return best.select(*key, *(F.col(f"s.{c}").alias(c) for c in rest))


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target with the rows of source in place of those with the same key."""
    return target.join(source, key, "left_anti").unionByName(source.select(*target.columns))


def current_only(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a merge takes over of a store: roots whose scan exists, those scans, their entries."""
    roots = tables["roots"].distinct()
    scans = tables["scans"].distinct()
    ids = roots.withColumnRenamed("current_scan_id", "scan_id")
    kept = scans.join(ids, ["machine_id", "root", "scan_id"], "left_semi")
    live = ids.join(kept.select("scan_id"), "scan_id", "left_semi").withColumnRenamed("scan_id", "current_scan_id")
    entries = tables["entries"].join(kept.select("scan_id").distinct(), "scan_id", "left_semi")
    return {"roots": live.select(*roots.columns), "scans": kept.select(*scans.columns), "entries": entries}


def renumber(tables: dict[str, DataFrame], offset: int) -> dict[str, DataFrame]:
    """tables with every scan id raised by offset, so that a merge can't clash."""
    move = lambda df, c: df.withColumn(c, F.col(c) + offset)
    return {"roots": move(tables["roots"], "current_scan_id"), "scans": move(tables["scans"], "scan_id"), "entries": move(tables["entries"], "scan_id")}


def merge(target: dict[str, DataFrame], source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """target after importing source's current scans: equal (machine_id, root) are replaced as a whole.

    Scan ids of source have to be free in target (renumber).
    """
    source = current_only(source)
    keys = source["roots"].select("machine_id", "root")
    old = target["scans"].join(keys, ["machine_id", "root"], "left_semi").select("scan_id")
    union = lambda n, kept: kept.unionByName(source[n].select(*kept.columns))
    return {
        "roots": union("roots", target["roots"].join(keys, ["machine_id", "root"], "left_anti").select(*target["roots"].columns)),
        "scans": union("scans", target["scans"].join(keys, ["machine_id", "root"], "left_anti").select(*target["scans"].columns)),
        "entries": union("entries", target["entries"].join(old, "scan_id", "left_anti").select(*target["entries"].columns)),
    }


def without_machines(tables: dict[str, DataFrame], machines: list[str]) -> dict[str, DataFrame]:
    """tables without the roots, scans and entries of some machines; empty ids are passed over."""
    ids = [m for m in dict.fromkeys(machines) if m]
    gone = F.col("machine_id").isin(ids)
    scans = tables["scans"].where(gone).select("scan_id").distinct()
    return {
        "roots": tables["roots"].where(~gone),
        "scans": tables["scans"].where(~gone),
        "entries": tables["entries"].join(scans, "scan_id", "left_anti"),
    }
