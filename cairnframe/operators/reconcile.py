"""Differences between two copies of a tree by invertible Bloom lookup tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.exec import BROADCAST_ROWS, cut, sized
from cairnframe.functions.values import known_hash, row_hash

#: Rows of the larger side that share one table of 3 x CELLS cells; a table of that size opens up to about 100
#: differing rows, and a bucket beyond that is compared row by row.
BUCKET_ROWS, CELLS = 1024, 48
#: Cells that one task opens at a time: 32 bytes each.
GROUP_CELLS = 300_000

_P1, _P2, _P3, _P4, _P5 = (  # fixed values: the primes of XXH64
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64_longs(*cols: np.ndarray) -> np.ndarray:
    """The value of Spark's xxhash64 over non-null long columns."""
    with np.errstate(over="ignore"):
        seed = np.full(len(cols[0]), 42, np.uint64)
        for c in cols:
            h = seed + _P5 + np.uint64(8)
            h ^= _rot(c.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
            h = _rot(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
            seed = h
    return seed.view(np.int64)


def _cell(check: Column, table: int) -> Column:
    return F.pmod(F.shiftright(check, 20 * table), F.lit(CELLS)).cast("int") + F.lit(table * CELLS)


#: Sums of a cell: signed rows, and the signed sums of both halves of the key, of the row hash and of the check.
SUMS = ("n", "k1", "k0", "h1", "h0", "c1", "c0")


def _halves(name: str) -> list[Column]:
    """Signed halves of a long, so that sums of many can't overflow."""
    high, low = F.shiftright(name, 32), F.col(name).bitwiseAND(0xFFFFFFFF)
    return [(F.col("sign") * high).alias(name + "1"), (F.col("sign") * low).alias(name + "0")]


def _whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.view(np.uint64) << np.uint64(32) | low.view(np.uint64)).view(np.int64)


def open_tables(cells: pd.DataFrame) -> pd.DataFrame:
    """Peel the subtracted tables of many buckets at once: (pair_id, bucket, k), k NULL for a bucket that stays shut.

    Columns: pair_id, bucket, cell and SUMS. A cell is pure if all its rows are copies of one, so that its sums are n
    times those of that row; however often a row is repeated on either side, its cells open alike.
    """
    key = cells["pair_id"].astype(str) + ":" + cells["bucket"].astype(str)
    code, first = pd.factorize(key)
    at = code * (3 * CELLS) + cells["cell"].to_numpy()
    sums = np.zeros((len(SUMS), len(first) * 3 * CELLS), np.int64)
    for target, name in zip(sums, SUMS):
        target[at] = cells[name].to_numpy()
    found_at, found_k = [], []
    look = np.flatnonzero(sums[0])
    for _ in range(sums.shape[1]):  # each round opens a row, else it is the last
        n = sums[0, look]
        one, rest = np.divmod(sums[1:, look], n)
        sound = (rest == 0).all(axis=0)
        for high, low in ((0, 1), (2, 3), (4, 5)):
            sound &= (one[low] >= 0) & (one[low] < 1 << 32) & (one[high] >= -(1 << 31)) & (one[high] < 1 << 31)
        look, n, one = look[sound], n[sound], one[:, sound]
        k, h, c = (_whole(one[i], one[i + 1]) for i in (0, 2, 4))
        pure = xxhash64_longs(k, h) == c
        look, n, k, h, c, one = look[pure], n[pure], k[pure], h[pure], c[pure], one[:, pure]
        if not len(look):
            break
        item = pd.DataFrame({"b": look // (3 * CELLS), "k": k, "h": h}).drop_duplicates()
        b, i = item["b"].to_numpy(), item.index.to_numpy()
        found_at.append(b)
        found_k.append(k[i])
        touched = []
        parts = np.concatenate([np.ones((1, len(i)), np.int64), one[:, i]]) * n[i]
        for t in range(3):
            cell = b * (3 * CELLS) + t * CELLS + np.mod(c[i] >> np.int64(20 * t), CELLS)
            for target, v in zip(sums, parts):
                np.subtract.at(target, cell, v)
            touched.append(cell)
        look = np.unique(np.concatenate(touched))
        look = look[sums[0, look] != 0]
    shut = np.unique(np.flatnonzero(sums.any(axis=0)) // (3 * CELLS))
    one = cells[["pair_id", "bucket"]].iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
    b = np.concatenate([*found_at, shut]).astype(np.int64) if found_at else shut
    opened = np.concatenate(found_k) if found_k else np.zeros(0, np.int64)
    out = one.iloc[b].reset_index(drop=True)
    k = np.concatenate([opened, np.zeros(len(shut), np.int64)])
    out["k"] = pd.arrays.IntegerArray(k, np.arange(len(k)) >= len(opened))
    return out.drop_duplicates()


def copy_differences(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, rel_path, difference) of the scans named in pairs (pair_id, left_scan_id, right_scan_id).

    Every row becomes an item (path hash, row hash) of the bucket its path hash falls into; a bucket's table holds
    signed counts and sums, +1 for the left and -1 for the right, so that uniting both sides in one
    aggregation subtracts the tables and equal rows vanish. What crosses the shuffle is cells, folded map-side, not
    rows. Peeling gives the path hashes of differing rows; those rows alone are fetched and compared field by field.
    Sums, unlike exclusive ors, don't lose a row that stands twice. A row repeated on one side alone is opened, and
    the comparison finds it equal; a bucket that can't be opened is compared whole, so the result is exact up to
    64-bit hash equality of differing rows.

    Opened keys are broadcast if there are at most BROADCAST_ROWS; else the rows are shuffled once, by (pair, path
    hash), which the comparison shares.

    size compares as a value (NULL equals NULL), sha256 in lower case with NULL and '' as unknown. Where repeated rows
    of one path disagree, the largest value stands for the side. Rows without scan_id or rel_path and pairs with a
    NULL id are left out; a pair of a scan with itself has no differences; repeated pair rows count once.
    """
    spark = entries.sparkSession
    pairs = pairs.select("pair_id", "left_scan_id", "right_scan_id").dropna().distinct()
    side = lambda c, sign: pairs.select("pair_id", F.col(c).alias("scan_id"), F.lit(sign).cast("long").alias("sign"))
    sides = side("left_scan_id", 1).unionByName(side("right_scan_id", -1))
    rows = entries.where(F.col("rel_path").isNotNull() & F.col("scan_id").isNotNull())
    per_scan = rows.groupBy("scan_id").count()
    buckets = (
        sides.join(per_scan, "scan_id")
        .groupBy("pair_id")
        .agg(F.ceil(F.max("count") / BUCKET_ROWS).cast("long").alias("buckets"))
    )
    sides = cut(sides.join(buckets, "pair_id"))
    total = sides.agg(F.coalesce(F.sum("buckets"), F.lit(0)).alias("n")).first()["n"] // 2
    sides = sized(sides, BROADCAST_ROWS)
    k = F.xxhash64("rel_path")

    def tagged(*more: Column) -> DataFrame:
        x = rows.select("scan_id", k.alias("k"), *more).join(sides, "scan_id")
        return x.withColumn("bucket", F.pmod(F.shiftright("k", 7), F.col("buckets")))

    digest = known_hash("sha256").alias("sha256")
    items = tagged(row_hash(F.col("size"), known_hash("sha256")).alias("h")).withColumn("c", F.xxhash64("k", "h"))
    items = items.select("pair_id", "bucket", "sign", "c", *_halves("k"), *_halves("h"), *_halves("c"))
    cells = (
        items.withColumn("cell", F.explode(F.array(*(_cell(F.col("c"), t) for t in range(3)))))
        .groupBy("pair_id", "bucket", "cell")
        .agg(F.sum("sign").alias("n"), *(F.sum(x).alias(x) for x in SUMS[1:]))
        .where(" OR ".join(f"{x} <> 0" for x in SUMS))
    )
    groups = max(1, min(100_000, int(total) * 3 * CELLS // GROUP_CELLS + 1), spark.sparkContext.defaultParallelism)
    opened = cut(
        cells.withColumn("g", F.pmod(F.xxhash64("pair_id", "bucket"), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(lambda pdf: open_tables(pdf), "pair_id long, bucket long, k long")
    )
    keys = opened.where(F.col("k").isNotNull()).select("pair_id", "k").distinct()
    shut = opened.where(F.col("k").isNull()).select("pair_id", "bucket").distinct()
    data = tagged(F.col("rel_path"), F.col("size"), digest)
    fetched = data.join(sized(keys, BROADCAST_ROWS), ["pair_id", "k"], "left_semi")
    if shut.limit(1).count():
        fetched = fetched.unionByName(data.join(sized(shut, BROADCAST_ROWS), ["pair_id", "bucket"], "left_semi"))
    left, right = F.col("sign") == 1, F.col("sign") == -1
    both = fetched.groupBy("pair_id", "k", "rel_path").agg(
        F.max(left).alias("in_left"),
        F.max(right).alias("in_right"),
        *(
            F.max(F.when(s, F.col(c))).alias(f"{p}_{c}")
            for p, s in (("l", left), ("r", right))
            for c in ("size", "sha256")
        ),
    )
    differs = lambda c: ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    found = (
        F.when(~F.col("in_right"), F.array(F.lit("only_left")))
        .when(~F.col("in_left"), F.array(F.lit("only_right")))
        .otherwise(
            F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in ("size", "sha256"))))
        )
    )
    return both.select("pair_id", "rel_path", F.explode(found).alias("difference"))
