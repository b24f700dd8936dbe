"""Snapshots as both sides of comparisons see them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.paths import compare_path, is_noise, prefix, trimmed, under
from cairnframe.functions.values import known_hash


def side(entries: DataFrame, keys: list[str], p: str = "", ignore_noise: bool = False, once: bool = True, cmp: bool = True) -> DataFrame:
    """(keys, rel_path, cmp, size, sha256): the rows of one side under a prefix, trimmed, each once.

    once=False leaves repeated rows to an operator that groups by path anyway, which saves a shuffle. cmp=False leaves
    out the composed path, which comparisons by content don't need.

    Filters see the untrimmed path. cmp is trimmed by the length of the prefix's composed form. Hashes are known ones.
    """
    p = prefix(p)
    rows = entries.where(F.col("rel_path").isNotNull() & under(F.col("rel_path"), p) if p else F.col("rel_path").isNotNull())
    if ignore_noise:
        rows = rows.where(~is_noise(F.col("name"), F.col("rel_path")))
    rows = rows.select(
        *keys,
        trimmed(F.col("rel_path"), p).alias("rel_path"),
        *([trimmed(compare_path(entries), unicodedata.normalize("NFC", p)).alias("cmp")] if cmp else []),
        "size",
        known_hash("sha256").alias("sha256"),
    )
    return rows.distinct() if once else rows


def paired(entries: DataFrame, pairs: DataFrame, scan: str) -> DataFrame:
    """entries of the scans in column `scan` of pairs, with pair_id.

    The pairs are broadcast if Spark's own estimate of their size is below its threshold; else rows meet by scan, and
    adaptive execution splits a scan that is too large.
    """
    one = pairs.select("pair_id", F.col(scan).alias("scan_id")).dropna().distinct()
    return entries.join(one, "scan_id").drop("scan_id")
