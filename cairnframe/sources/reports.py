"""Checksum report rows: from the seven text fields of a record to a typed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Names of the members of a result message, the first one found counts.
MEMBERS = {
    "etag": ("etag", "ETag"),
    "base64": ("checksum_base64", "checksumBase64", "ChecksumBase64"),
    "hex": ("checksum_hex", "checksumHex", "ChecksumHex"),
    "algorithm": ("checksumAlgorithm", "checksum_algorithm", "ChecksumAlgorithm"),
    "type": ("checksumType", "checksum_type", "ChecksumType"),
}


def text_or_null(c: Column) -> Column:
    """Trimmed text; blank or `null` in any case is NULL."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "null"), t)


def decoded_key(c: Column) -> Column:
    """URL query unescaping; a key that isn't validly escaped stays as it is."""
    return F.coalesce(F.try_url_decode(c), c)


def json_text(v: Column, *names: str) -> Column:
    """The first of the named members that is a JSON string, trimmed; other kinds of value don't count."""
    found = [
        F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.trim(F.try_variant_get(v, f"$.{n}", "string")))
        for n in names
    ]
    return F.nullif(F.coalesce(*found, F.lit("")), F.lit(""))


def base64_hex(c: Column) -> Column:
    """Lower-case hex of padded base64; NULL for anything else."""
    return F.when(F.length(c) % 4 == 0, F.lower(F.hex(F.try_to_binary(c, F.lit("base64")))))


def whole_number(c: Column) -> Column:
    """A field that is a 64-bit integer; blanks around it are dropped."""
    return F.trim(c).try_cast("bigint")


def report_rows(fields: DataFrame, keep: list[str]) -> DataFrame:
    """Typed report rows of the sound rows of `fields` (f0 .. f6, reason NULL), keeping the columns `keep`.

    bucket, object_key (unescaped), version_id, task_status, error_code, http_status_code, result_message, etag,
    checksum_base64, checksum_hex, checksum_algorithm, checksum_type, usable, err. If column 5 is an integer it is the
    HTTP status and column 6 the error code, else the other way round. A row is usable if it succeeded with a full-object
    SHA-256 of 64 hex digits; otherwise err says why not.
    """
    c = lambda i: F.col(f"f{i}")
    swapped = whole_number(c(4)).isNotNull()
    rows = fields.where(F.col("reason").isNull()).withColumn("v", F.when(F.lower(F.trim(c(3))) == "succeeded", F.try_parse_json("f6")))
    rows = rows.select(
        *keep,
        F.trim(c(0)).alias("bucket"),
        decoded_key(c(1)).alias("object_key"),
        text_or_null(c(2)).alias("version_id"),
        F.trim(c(3)).alias("task_status"),
        text_or_null(F.when(swapped, c(5)).otherwise(c(4))).alias("error_code"),
        F.when(swapped, whole_number(c(4))).otherwise(whole_number(c(5))).alias("http_status_code"),
        text_or_null(c(6)).alias("result_message"),
        json_text(F.col("v"), *MEMBERS["etag"]).alias("etag"),
        json_text(F.col("v"), *MEMBERS["base64"]).alias("checksum_base64"),
        F.lower(json_text(F.col("v"), *MEMBERS["hex"])).alias("hex"),
        F.upper(json_text(F.col("v"), *MEMBERS["algorithm"])).alias("checksum_algorithm"),
        F.upper(json_text(F.col("v"), *MEMBERS["type"])).alias("checksum_type"),
    )
    rows = rows.withColumn("checksum_hex", F.coalesce("hex", base64_hex(F.col("checksum_base64")))).drop("hex")
    err = (
        F.when(F.lower("task_status") != "succeeded", F.lit("task did not succeed"))
        .when(F.coalesce("checksum_algorithm", F.lit("")) != "SHA256", F.lit("unsupported checksum algorithm"))
        .when(F.coalesce("checksum_type", F.lit("")) != "FULL_OBJECT", F.lit("unsupported checksum type"))
        .when(~F.coalesce(F.col("checksum_hex").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("no SHA-256 checksum"))
    )
    return rows.withColumn("err", err).withColumn("usable", F.col("err").isNull().cast("int"))
