"""JSON text as variants: strict reading, kinds of values, and their text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairnframe.functions.exec import once


def with_strict(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the variant of the one JSON object that a text is; NULL for anything else, also for objects in which a name
    stands twice or that nest too deeply.

    The parser ignores what follows a value, so the text is read as the first of an array whose second member is the
    text's own hash: that's only there if the text ended where its value did. The steps are columns of their own, as an
    expression that is named twice is computed twice.
    """
    object_ = F.when(F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")), text)
    df = df.withColumn("__t", object_).withColumn("__h", F.hex(F.xxhash64("__t")))
    df = df.withColumn("__a", F.try_parse_json(F.concat(F.lit("["), F.col("__t"), F.lit(',"'), F.col("__h"), F.lit('"]'))))
    ended = F.try_variant_get("__a", "$[1]", "string") == F.col("__h")
    kept = [c for c in df.columns if c not in ("__t", "__h", "__a", out)]
    return once(df, *kept, F.when(ended, F.try_variant_get("__a", "$[0]", "variant")).alias(out))


def _refuse(name: str) -> None:
    raise ValueError(name)


@F.pandas_udf(StringType())
def _last_names(texts: pd.Series) -> pd.Series:
    """Objects in which a name stands twice, with its last value; NULL for what isn't strict JSON."""

    def one(text: str) -> str | None:
        try:
            value = json.loads(text, parse_constant=_refuse)
            return json.dumps(value) if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore")


def with_object(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the variant of the JSON object in a column; NULL where it isn't one.

    Only texts that the JVM's parser refuses go to Python, which tells objects with repeated names from broken ones.
    """
    df = with_strict(df, F.col(text), "__m")
    df = df.withColumn("__again", _last_names(F.when(F.col("__m").isNull(), F.col(text))))
    df = with_strict(df, F.col("__again"), "__n")
    kept = [c for c in df.columns if c not in ("__m", "__again", "__n", out)]
    return once(df, *kept, F.coalesce("__m", "__n").alias(out))


def kind_of(x: Column, schema: Column | None = None) -> Column:
    """string, integer, decimal number, boolean, array or object; NULL for null. An integer of more than 38 digits counts
    as a decimal number, a number of 19 or more digits without a fraction as an integer. schema is schema_of_variant of x where that's a column already."""
    s = F.schema_of_variant(x) if schema is None else schema
    return (
        F.when(s == "VOID", F.lit(None))
        .when(s == "STRING", "string")
        .when(s == "BIGINT", "integer")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), "integer")
        .otherwise("decimal number")
    )


def exploded(df: DataFrame, x: str, name: str, value: str) -> DataFrame:
    """df with a row for every member of the object x, instead of x; an object without members keeps one row of NULLs."""
    rows = df.where(F.col(x).isNotNull()).lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col(x).outer()))
    return rows.select(*(c for c in df.columns if c != x), F.col("key").alias(name), F.col("value").alias(value))


def get(x: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(x, path, kind)


def text_of(x: Column) -> Column:
    """A string as it is, another value as JSON text; NULL for null."""
    return F.coalesce(get(x, "$", "string"), F.when(~F.is_variant_null(x), F.to_json(x)))
