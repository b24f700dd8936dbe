"""Path semantics: prefixes, names, ancestors, noise, composed form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Files and directories that operating systems leave in trees.
NOISE_NAMES = (".ds_store", "thumbs.db", "ehthumbs.db", "desktop.ini", ".directory")
NOISE_DIRS = ("@eadir",)


def prefix(text: str | None) -> str:
    """A directory prefix: forward slashes, none at either end but one at the end; '' is the whole tree."""
    p = (text or "").replace("\\", "/").strip("/")
    return p + "/" if p else ""


def under(path: Column, p: str) -> Column:
    """Whether a path is under prefix p, literally (pushed down as StringStartsWith)."""
    return path.startswith(p) if p else F.lit(True)


def trimmed(path: Column, p: str) -> Column:
    return F.substring(path, len(p) + 1, 2**31 - 1) if p else path


def extension(name: Column) -> Column:
    """Lower case from the last dot on: `.gitignore` is its own extension, `x.` has `.`, `x` has ''."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    """Last component; slashes at the end don't count."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def components(path: Column) -> Column:
    """Components without empty ones (`a//b` is `a/b`)."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def ancestors(path: Column) -> Column:
    """All directories above a path, topmost first; [] for a path of one component."""
    parts = components(path)
    n = F.size(parts) - 1
    return F.when(
        n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def is_noise(name: Column, rel_path: Column) -> Column:
    """Files of the operating system: by the name column, or by a directory anywhere in the untrimmed path."""
    low = F.lower(rel_path)
    found = F.lower(name).isin(*NOISE_NAMES)
    for d in NOISE_DIRS:
        found = found | low.startswith(d + "/") | low.contains(f"/{d}/")
    return F.coalesce(found, F.lit(False))


def excluded(rel_path: Column, patterns: list[str]) -> Column:
    """Scan-time exclusion after the fact: `name` matches files by their exact name, `name/` directories at any depth."""
    files, dirs = split_patterns(patterns)
    parts = components(rel_path)
    found = F.lit(False)
    if files:
        found = found | F.element_at(parts, -1).isin(*files)
    if dirs:
        found = found | F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, dirs)))
    return F.coalesce(found, F.lit(False))


def split_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(file names, directory names); refuses empty patterns and path separators."""
    files, dirs = [], []
    for p in patterns:
        name = p[:-1] if p.endswith("/") else p
        if not name or "/" in name or "\\" in name:
            raise ValueError(f"exclude pattern {p!r} has to be one name, with a slash at its end for directories")
        (dirs if p.endswith("/") else files).append(name)
    return files, dirs


def roots_overlap(a: Column, b: Column) -> Column:
    """same, ancestor (a above b), descendant (a below b) or NULL; components count, so raw and raw-archive are apart."""
    slash = lambda x: F.concat(F.rtrim(x, F.lit("/")), F.lit("/"))
    return (
        F.when(slash(a) == slash(b), F.lit("same"))
        .when(slash(b).startswith(slash(a)), F.lit("ancestor"))
        .when(slash(a).startswith(slash(b)), F.lit("descendant"))
    )


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed form; only for writing and backfilling, so that comparisons stay in the JVM."""
    return texts.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def sparse_nfc(path: Column) -> Column:
    """NULL unless the composed form differs from the path."""
    return F.nullif(nfc(path), path)


def compare_path(df: DataFrame) -> Column:
    """The key of comparisons: the stored composed form where there is one, else the path."""
    if "rel_path_norm" not in df.columns:
        return F.col("rel_path")
    return F.coalesce(F.nullif(F.col("rel_path_norm"), F.lit("")), F.col("rel_path"))


def backfill(entries: DataFrame) -> DataFrame:
    """entries with rel_path_norm filled wherever it is missing and the composed form differs. Running it twice changes nothing."""
    have = F.nullif(F.col("rel_path_norm"), F.lit("")) if "rel_path_norm" in entries.columns else F.lit(None).cast("string")
    return entries.withColumn("rel_path_norm", F.coalesce(have, sparse_nfc(F.col("rel_path"))))
