"""Expressions for the values of inventory rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_hash(c: Column | str) -> Column:
    """Lower-case digest; NULL and '' both mean unknown and become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.nullif(c, F.lit("")))


def row_hash(*cols: Column) -> Column:
    """64-bit hash of a row's values in which a NULL differs from every value.

    xxhash64 skips NULLs, so each value is preceded by its null flag.
    """
    parts: list[Column] = []
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)
