"""Ordered look-back within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, group: str, time: str, tie: str, payload: str, out: str) -> DataFrame:
    """Add `out`: the payload of the row before in its group by (time, tie); NULL for a group's first row.

    A group may hold any share of the rows, so the look-back has two levels: within months, and then over one row per
    group and month, which a first row of a month takes its predecessor from. No task sorts more than one month of a
    group, or its list of months.
    """
    month = F.coalesce(F.date_trunc("month", time), F.timestamp_micros(F.lit(-(2**55))))
    rows = df.withColumn("__month", month)
    within = Window.partitionBy(group, "__month").orderBy(time, tie)
    rows = rows.withColumn("__lag", F.lag(payload).over(within)).withColumn("__rn", F.row_number().over(within))
    last = rows.groupBy(group, "__month").agg(F.max_by(payload, F.struct(time, tie)).alias("__last"))
    carried = last.select(
        F.col(group).alias("__g"),
        F.col("__month").alias("__m"),
        F.lag("__last").over(Window.partitionBy(group).orderBy("__month")).alias("__carried"),
    )
    joined = rows.join(carried, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__month") == F.col("__m")), "left")
    value = F.when(F.col("__rn") == 1, F.col("__carried")).otherwise(F.col("__lag"))
    return joined.select(*df.columns, value.alias(out))
