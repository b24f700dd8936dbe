"""Changes between consecutive full snapshots of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnframe.functions.exec import sized
from cairnframe.functions.values import known_hash, row_hash


def snapshot_steps(scans: DataFrame, complete: str = "complete") -> DataFrame:
    """(later_scan_id, scan_id, side): which scan stands on which side of which step.

    Only scans of status `complete` count; repeated scan rows count once (the largest started_at wins where they
    disagree). Order is started_at, then scan_id; a NULL started_at comes first. Scans without machine or root form
    the chain of their NULL. First scans have no step.
    """
    once = (
        scans.where(F.col("status") == complete)
        .where(F.col("scan_id").isNotNull())
        .groupBy("scan_id")
        .agg(F.max(F.struct("started_at", "machine_id", "root")).alias("s"))
        .select("scan_id", "s.*")
    )
    w = Window.partitionBy("machine_id", "root").orderBy("started_at", "scan_id")
    steps = once.select("scan_id", F.lag("scan_id").over(w).alias("before")).where(F.col("before").isNotNull())
    return steps.select(
        F.col("scan_id").alias("later_scan_id"),
        F.explode(
            F.array(
                F.struct(F.col("scan_id").alias("scan_id"), F.lit(True).alias("is_new")),
                F.struct(F.col("before").alias("scan_id"), F.lit(False).alias("is_new")),
            )
        ).alias("x"),
    ).select("later_scan_id", "x.*")


def snapshot_changes(entries: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, rel_path, change): paths added, removed or changed against the complete scan before.

    Both snapshots of a step are tagged by side, united and grouped by (step, path) once; a path's change follows from
    the two row hashes over (mtime_ns, sha256). Hashes compare in lower case, unknown equals unknown. Only longs and
    the path cross the one shuffle, and map-side aggregation folds repeated rows before it. The tag is a join with the
    steps, broadcast only if their counted size allows it; a root or scan that holds a third of all rows is spread by
    its paths, so no key is hot. Where repeated rows of one key disagree, the largest hash stands for the side, so
    the result is deterministic. Rows with a NULL scan_id or rel_path are no entries and are left out; extra columns
    are ignored; empty tables give no rows.
    """
    steps = snapshot_steps(scans)
    rows = entries.where(F.col("rel_path").isNotNull()).select(
        "scan_id", "rel_path", row_hash(F.col("mtime_ns"), known_hash("sha256")).alias("h")
    )
    tagged = rows.join(sized(steps), "scan_id")
    sides = tagged.groupBy("later_scan_id", "rel_path").agg(
        F.max(F.when(F.col("is_new"), F.col("h"))).alias("new"), F.max(F.when(~F.col("is_new"), F.col("h"))).alias("old")
    )
    change = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNull(), F.lit("removed"))
        .when(F.col("old") != F.col("new"), F.lit("changed"))
    )
    return sides.select(F.col("later_scan_id").alias("scan_id"), "rel_path", change.alias("change")).where(
        F.col("change").isNotNull()
    )
