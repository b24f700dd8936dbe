"""Per-content counts with an even load however few contents hold the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.values import known_hash


def places_per_content(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """(size, sha256, places): the number of different (scan_id, rel_path) of every content with a known hash.

    The rows are range partitioned by the composite key (size, sha256) and the secondary order (scan_id, rel_path);
    Spark draws the split points from sampled quantiles of that composite, so a content with a third of all rows is
    cut into as many partitions as its share. Equal rows always meet in one partition, which makes the distinct of
    places local (RangePartitioning on all four columns satisfies it without another exchange). Each partition then
    has one partial count per content; the partial counts of the contents that cross a boundary are stitched in a
    last aggregation of at most (contents + partitions) rows.

    Digests compare in lower case; NULL and '' hashes are unknown and have no content. A NULL size is a content of its
    own, so is a NULL scan_id or rel_path a place. Extra columns are ignored; an empty table gives no rows.
    """
    rows = entries.select(
        "size", known_hash("sha256").alias("sha256"), "scan_id", "rel_path"
    ).where(F.col("sha256").isNotNull())
    order = ["size", "sha256", "scan_id", "rel_path"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return ranged.distinct().groupBy("size", "sha256").agg(F.count(F.lit(1)).alias("places"))


def crowded_contents(entries: DataFrame, at_least: int = 25) -> DataFrame:
    """(size, sha256) of the contents that stand in at least `at_least` different places."""
    return places_per_content(entries).where(F.col("places") >= at_least).select("size", "sha256")
