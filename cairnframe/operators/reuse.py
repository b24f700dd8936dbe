"""Reuse of known hashes for files that haven't changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnframe.functions.paths import roots_overlap
from cairnframe.functions.values import known_hash
from cairnframe.operators.browse import TRUSTED

_KEY = ["rel_path", "size", "mtime_ns"]


def agreed(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rel_path, size, mtime_ns, agree, fingerprint, sha256): whether all candidates of a file name one content."""
    hashes = F.struct(F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("sha256", F.lit("")).alias("sha256"))
    g = candidates.select(*keys, *_KEY, hashes.alias("h")).groupBy(*keys, *_KEY).agg(F.min("h").alias("a"), F.max("h").alias("b"))
    return g.select(
        *keys, *_KEY, (F.col("a") == F.col("b")).alias("agree"), F.nullif("a.fingerprint", F.lit("")).alias("fingerprint"),
        F.nullif("a.sha256", F.lit("")).alias("sha256"),
    )


def reuse_hashes(walked: DataFrame, exact: DataFrame, overlap: DataFrame | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """walked with reused, fingerprint and sha256.

    A file takes the hashes of the exact candidates (same path, size and mtime) if they agree. Exact candidates that
    disagree are a miss for good; only without any do the overlapping roots' candidates count, if they agree.
    """
    e = agreed(exact, keys).select(*keys, *_KEY, F.struct("agree", "fingerprint", "sha256").alias("e"))
    rows = walked.drop("fingerprint", "sha256").join(e, [*keys, *_KEY], "left")
    hit = F.when(F.col("e.agree"), F.col("e"))
    if overlap is not None:
        o = agreed(overlap, keys).select(*keys, *_KEY, F.struct("agree", "fingerprint", "sha256").alias("o"))
        rows = rows.join(o, [*keys, *_KEY], "left")
        hit = F.when(F.col("e").isNotNull(), hit).otherwise(F.when(F.col("o.agree"), F.col("o")))
    rows = rows.withColumn("hit", hit)
    return rows.select(
        *walked.drop("fingerprint", "sha256").columns, F.col("hit").isNotNull().alias("reused"),
        F.col("hit.fingerprint").alias("fingerprint"), F.col("hit.sha256").alias("sha256"),
    )


def exact_candidates(entries: DataFrame, trusted_only: bool = False) -> DataFrame:
    """Candidates from scans of the same root. The authoritative scan counts in any state;
    trusted_only keeps to ok and reused rows, as is always done for failed scans."""
    return entries.where(F.col("state").isin(*TRUSTED)) if trusted_only else entries


def root_pairs(roots: DataFrame, machine: str = "machine_id") -> DataFrame:
    """(machine, root, other, how): which roots of a machine are the same as, an ancestor or a descendant of which others.

    Roots meet by equal paths: each root's own path and those of all directories above it are matched with the roots, so
    the rows that meet are those that overlap. Slashes at the end don't count; root and other are different rows' spellings.
    """
    plain = F.when(F.rtrim("root", F.lit("/")) == "", F.lit("")).otherwise(F.rtrim("root", F.lit("/")))
    rows = roots.select(machine, "root").where(F.col("root").isNotNull()).distinct().withColumn("__at", plain)
    parts = F.split("__at", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    low = rows.select(machine, F.col("root").alias("__low"), "__at", F.explode(above).alias("__above"))
    high = rows.select(machine, F.col("root").alias("__high"), F.col("__at").alias("__above"))
    met = low.join(high, [machine, "__above"]).withColumn("__same", F.col("__at") == F.col("__above"))
    up = met.select(machine, F.col("__high").alias("root"), F.col("__low").alias("other"), F.when(F.col("__same"), "same").otherwise("ancestor").alias("how"))
    down = met.where(~F.col("__same")).select(machine, F.col("__low").alias("root"), F.col("__high").alias("other"), F.lit("descendant").alias("how"))
    return up.unionByName(down)


def rebased(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates for many roots at once: (keys, target, rel_path, size, mtime_ns, fingerprint, sha256).

    sources (keys, root, rel_path, size, mtime_ns, state, fingerprint, sha256) are entries of roots, targets (keys, target,
    root, how) says which root lies how to which target. Paths are those in the target; only trusted rows with both
    hashes count, and those that lie in the target.
    """
    good = sources.where(F.col("state").isin(*TRUSTED) & known_hash("sha256").isNotNull() & known_hash("fingerprint").isNotNull())
    rows = good.join(targets.where(F.col("how") != "same"), [*keys, "root"])
    slash = lambda c: F.concat(F.rtrim(c, F.lit("/")), F.lit("/"))
    whole = F.concat(slash("root"), "rel_path")
    return rows.where(F.startswith(whole, slash("target"))).select(
        *keys, "target", F.substring(whole, F.length(slash("target")) + 1, F.length(whole)).alias("rel_path"), "size", "mtime_ns", "fingerprint", "sha256"
    )


def overlap_candidates(target_root: str, sources: DataFrame) -> DataFrame:
    """Candidates for target_root from `sources` (root, rel_path, size, mtime_ns, state, fingerprint, sha256) of roots above
    or below it, with paths rebased; only trusted rows with both hashes."""
    rows = sources.withColumns({"__k": F.lit(0), "how": roots_overlap(F.col("root"), F.lit(target_root)), "target": F.lit(target_root)})
    named = rows.select("__k", "root", "target", "how").where(F.col("how").isNotNull()).distinct()
    return rebased(rows.drop("how", "target"), named, ["__k"]).drop("__k", "target")
