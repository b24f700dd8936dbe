"""Comparison of two snapshots by path or by content, of many pairs of them at once.

Both sides carry the key columns of the comparison (such as a pair_id; none for a single one), so that one plan answers
any number of pairs and a large pair is spread by its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnframe.functions.exec import cut, sized
from cairnframe.functions.paths import ancestors


def _fields(c: str) -> Column:
    return F.struct(F.col("cmp"), F.col("size"), F.col("sha256")).alias(c)


def _identical(a: str, b: str) -> Column:
    """Sizes equal and both hashes known and equal; anything unknown is a difference."""
    same = (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.sha256") == F.col(f"{b}.sha256"))
    return F.coalesce(same, F.lit(False))


def compare_by_path(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, rel_path, cmp, left_size, left_sha256, right_size, right_sha256) from two `side` frames.

    kind is identical, different, left_only or right_only. Raw paths match first. What is left matches by its composed
    path, if that path is unique in both remainders; such a row is labelled by the composed path, all others by their
    raw one. The first step is one aggregation of both sides united and tagged (no join), whose exchange the matched rows and the
    remainder share, the second one window over the remainder; repeated rows of a side that disagree are represented by their largest.
    """
    tag = lambda df, is_left: df.select(*keys, "rel_path", _fields("x"), F.lit(is_left).alias("is_left"))
    sides = (
        tag(left, True)
        .unionByName(tag(right, False))
        .groupBy(*keys, "rel_path")
        .agg(F.max(F.when(F.col("is_left"), F.col("x"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("x"))).alias("r"))
    )
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    matched = sides.where(both).withColumn("kind", F.when(_identical("l", "r"), "identical").otherwise("different"))
    rest = sides.where(~both).withColumn("cmp", F.coalesce("l.cmp", "r.cmp"))
    w = Window.partitionBy(*keys, "cmp")
    rest = rest.select(
        "*",
        F.count("l").over(w).alias("nl"),
        F.count("r").over(w).alias("nr"),
        F.max("l").over(w).alias("ll"),
        F.max("r").over(w).alias("rr"),
    )
    pair = (F.col("nl") == 1) & (F.col("nr") == 1)
    composed = rest.where(pair & F.col("l").isNotNull()).select(
        *keys, F.col("cmp").alias("rel_path"), F.col("ll").alias("l"), F.col("rr").alias("r"),
        F.when(_identical("ll", "rr"), "identical").otherwise("different").alias("kind"),
    )
    only = rest.where(~pair).select(
        *keys, "rel_path", "l", "r", F.when(F.col("l").isNotNull(), "left_only").otherwise("right_only").alias("kind")
    )
    rows = matched.select(*keys, "rel_path", "l", "r", "kind").unionByName(composed).unionByName(only)
    return rows.select(
        *keys, "kind", "rel_path", F.coalesce("l.cmp", "r.cmp").alias("cmp"),
        F.col("l.size").alias("left_size"), F.col("l.sha256").alias("left_sha256"),
        F.col("r.size").alias("right_size"), F.col("r.sha256").alias("right_sha256"),
    )


def only_files(rows: DataFrame, which: str, keys: list[str]) -> DataFrame:
    """(keys, rel_path, size, sha256) of one side alone, from a comparison by path; which is left or right."""
    return rows.where(F.col("kind") == f"{which}_only").select(
        *keys, "rel_path", "cmp", F.col(f"{which}_size").alias("size"), F.col(f"{which}_sha256").alias("sha256")
    )


def compact_missing_trees(only: DataFrame, opposite: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rel_path, file_count, collapsed, size, sha256, sort_path): missing files with whole missing trees collapsed.

    A directory with at least two of the missing files is collapsed into `dir/*` if the opposite side (all its filtered
    rows, matched ones too) has nothing of that composed name, neither as a file nor as a directory. Each file goes into
    its topmost such directory; others stay as they are. Rows show in the order of sort_path, the first path of each.
    """
    only = cut(only)  # read three times below, and small beside the snapshots
    at = only.select(*keys, "rel_path", F.posexplode(F.arrays_zip(ancestors(F.col("rel_path")).alias("dir"), ancestors(F.col("cmp")).alias("cdir"))).alias("depth", "d"))
    at = at.select(*keys, "rel_path", "depth", "d.dir", "d.cdir")
    dirs = cut(at.groupBy(*keys, "dir", "cdir").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2))
    nodes = opposite.select(*keys, F.explode(F.array_append(ancestors(F.col("cmp")), F.col("cmp"))).alias("cdir"))
    # of the opposite side's names only those of such directories are shuffled, if these are few enough to go along
    nodes = nodes.join(sized(dirs.select(*keys, "cdir").distinct(), texts=True), [*keys, "cdir"], "left_semi").distinct()
    free = dirs.join(nodes, [*keys, "cdir"], "left_anti").select(*keys, "dir", "n")
    top = (
        at.join(free, [*keys, "dir"])
        .groupBy(*keys, "rel_path")
        .agg(F.min(F.struct("depth", "dir", "n")).alias("t"))
        .select(*keys, "rel_path", "t.dir", "t.n")
    )
    rows = only.join(top, [*keys, "rel_path"], "left")
    collapsed = (
        rows.where(F.col("dir").isNotNull())
        .groupBy(*keys, "dir")
        .agg(F.max("n").alias("file_count"), F.min("rel_path").alias("sort_path"))
        .select(
            *keys, F.concat("dir", F.lit("/*")).alias("rel_path"), "file_count", F.lit(True).alias("collapsed"),
            F.lit(0).cast("long").alias("size"), F.lit("").alias("sha256"), "sort_path",
        )
    )
    single = rows.where(F.col("dir").isNull()).select(
        *keys, "rel_path", F.lit(1).cast("long").alias("file_count"), F.lit(False).alias("collapsed"), "size",
        F.coalesce("sha256", F.lit("")).alias("sha256"), F.col("rel_path").alias("sort_path"),
    )
    return collapsed.unionByName(single)


def content_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sha256, nl, nr): copies of every known content on either side, in one aggregation."""
    tag = lambda df, n: df.where(F.col("sha256").isNotNull()).select(*keys, "sha256", F.lit(n).alias("is_left"))
    return (
        tag(left, True)
        .unionByName(tag(right, False))
        .groupBy(*keys, "sha256")
        .agg(F.count_if("is_left").alias("nl"), F.count_if(~F.col("is_left")).alias("nr"))
    )


def identical_by_content(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, identical): copies that both sides have, whatever their paths; a comparison without any has no row."""
    m = content_matches(left, right, keys)
    return m.groupBy(*keys).agg(F.sum(F.least("nl", "nr")).alias("identical")).where(F.col("identical") > 0)


def rank_within(rows: DataFrame, group: list[str], order: str | Column | list[str | Column], out: str = "rn") -> DataFrame:
    """row_number in groups of any size: rows are range partitioned, so a large group is numbered in several tasks.

    The partitions are numbered in the order of the ranges, so the second step needs no more than the number of rows that
    each group has in the partitions before.
    """
    orders = order if isinstance(order, list) else [order]
    ranged = cut(rows.repartitionByRange(*group, *orders).withColumn("__p", F.spark_partition_id()))
    parts = ranged.groupBy(*group, "__p").count()
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(*group, "__p").orderBy(*orders))
    numbered = ranged.withColumn("__rn", within)
    joined = numbered.alias("r").join(parts.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*group, "__p"]])
    return joined.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), (F.col("r.__rn") + F.col("p.__base")).alias(out))


def content_excess(present: DataFrame, absent: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rel_path, size, sha256, ord): rows of one side beyond what the other side has of their content.

    Of a content's copies the last ones by path are in excess. Rows of unknown hash follow (ord 1); each ord shows in
    the order of its paths.
    """
    m = content_matches(present, absent, keys)
    known = present.where(F.col("sha256").isNotNull()).join(m.where(F.col("nl") > F.col("nr")), [*keys, "sha256"])
    whole = known.where(F.col("nr") == 0)
    part = rank_within(known.where(F.col("nr") > 0), [*keys, "sha256"], "rel_path").where(F.col("rn") > F.col("nr"))
    cols = [*keys, "rel_path", "size", "sha256"]
    rows = whole.select(*cols).unionByName(part.select(*cols)).withColumn("ord", F.lit(0))
    unknown = present.where(F.col("sha256").isNull()).select(*keys, "rel_path", "size", F.lit("").alias("sha256"), F.lit(1).alias("ord"))
    return rows.unionByName(unknown)


def overlap_stats(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_rows, right_rows, exact_matches) by raw path."""
    tag = lambda df, n: df.select(*keys, "rel_path", F.lit(n).alias("s"))
    both = tag(left, 1).unionByName(tag(right, 2)).groupBy(*keys, "rel_path").agg(F.bit_or("s").alias("s"))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("s").bitwiseAND(1) > 0).alias("left_rows"),
        F.count_if(F.col("s").bitwiseAND(2) > 0).alias("right_rows"),
        F.count_if(F.col("s") == 3).alias("exact_matches"),
    )
