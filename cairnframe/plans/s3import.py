"""Import of checksum reports of object stores, with sizes from an inventory."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnframe.functions.paths import base_name, extension, sparse_nfc
from cairnframe.operators.badrows import judged, sound_quotes, split_record, without_end
from cairnframe.sources.reports import report_rows


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def find_file(name: str, roots: list[str]) -> str:
    """The one file of that base name below any of the roots; FileNotFoundError for none, ValueError for several."""
    base = os.path.basename(name.replace("\\", "/"))
    found = {os.path.realpath(os.path.join(folder, base)) for root in roots for folder, _, files in os.walk(root) if base in files}
    if not found:
        raise FileNotFoundError(f"{base} isn't below {roots}")
    if len(found) > 1:
        raise ValueError(f"{base} is ambiguous: {sorted(found)}")
    return found.pop()


def report_files(manifest: str) -> tuple[str | None, list[str]]:
    """(report schema, local CSV files in manifest order, each once) of a checksum report."""
    m = load_json(manifest)
    keys = [r["Key"] for r in m.get("Results") or [] if r.get("Key")]
    if not keys:
        raise ValueError(f"{manifest} names no result files")
    return m.get("ReportSchema"), list(dict.fromkeys(find_file(k, [os.path.dirname(manifest) or "."]) for k in keys))


@dataclass(frozen=True)
class InventoryManifest:
    files: list[str]
    columns: dict[str, int]


def inventory_manifest(path: str) -> InventoryManifest:
    """Files and column places of an object inventory; only CSV with Bucket, Key and Size will do."""
    m = load_json(path)
    if str(m.get("fileFormat", "")).lower() != "csv":
        raise ValueError(f"inventory format {m.get('fileFormat')!r} isn't CSV")
    names = [x.strip().lower() for x in str(m.get("fileSchema", "")).split(",")]
    columns = {n: i for i, n in reversed(list(enumerate(names)))}
    if missing := {"bucket", "key", "size"} - set(columns):
        raise ValueError(f"inventory lacks {sorted(missing)}")
    here = os.path.dirname(os.path.abspath(path))
    roots = list(dict.fromkeys([here, os.path.dirname(here), os.path.dirname(os.path.dirname(here))]))
    keys = [f["key"] for f in m.get("files") or [] if f.get("key")]
    return InventoryManifest(list(dict.fromkeys(find_file(k, roots) for k in keys)), columns)


def _records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file_no, block, line, raw) of CSV files, .gz included; (block, line) is a record's order in its file.

    Files are read as lines by Spark's own reader, which splits large ones. Only files in which a line has an odd
    number of quotes have records of several lines; those are stitched, file by file. Empty records are passed over.
    """
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")  # file:/x and file:///x are one
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    uris = []
    for f in files:
        p = path(f)
        uris.append(p.getFileSystem(conf).makeQualified(p).toUri().toString())
    numbers = spark.createDataFrame([(u, i) for i, u in enumerate(uris)], "__uri string, file_no int").withColumn("__uri", plain("__uri"))
    lines = spark.read.option("lineSep", "\n").text(files)
    lines = lines.select(plain("_metadata.file_path").alias("__uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))
    lines = lines.join(numbers, "__uri").drop("__uri")
    odd = (F.length("raw") - F.length(F.replace("raw", F.lit('"'), F.lit("")))) % 2
    broken = [r["file_no"] for r in lines.where(odd == 1).select("file_no").distinct().collect()]  # numbers of files
    records = lines
    if broken:
        at = Window.partitionBy("file_no").orderBy("block", "line")
        inside = F.coalesce(F.sum(odd).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
        own = lines.where(F.col("file_no").isin(broken)).withColumn("__start", 1 - inside)
        own = own.withColumn("__record", F.sum("__start").over(at.rowsBetween(Window.unboundedPreceding, 0)))
        parts = own.groupBy("file_no", "__record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "raw"))).alias("x"))
        own = parts.select("file_no", F.col("x")[0]["block"].alias("block"), F.col("x")[0]["line"].alias("line"), F.array_join("x.raw", "\n").alias("raw"))
        records = lines.where(~F.col("file_no").isin(broken)).unionByName(own.select(*lines.columns))
    return records.where(without_end(F.col("raw")) != "")


def _raise_unless(sound, message: str, record):
    return F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.substring(record, 1, 200))).cast("boolean"))


def read_report(spark: SparkSession, files: list[str]) -> DataFrame:
    """Typed report rows (row_index 1-based over all files, headers left out) of CSV files.

    A record that isn't seven soundly quoted columns raises; a status or message that is unsound only makes its row unusable.
    """
    rows = judged(_records(spark, files), ["file_no", "block", "line", "raw"])
    sound = F.coalesce(~F.col("reason").isin("quoting", "column_count"), F.lit(True))
    rows = rows.where(_raise_unless(sound, "not a row of seven columns", F.col("raw"))).where(F.col("reason").isNull() | (F.col("reason") != "header"))
    return number_rows(report_rows(rows.withColumn("reason", F.lit(None).cast("string")), ["file_no", "block", "line"]))


def number_rows(rows: DataFrame) -> DataFrame:
    """row_index over (file_no, block, line): numbered inside the blocks of files, plus the rows of the blocks before."""
    inside = F.row_number().over(Window.partitionBy("file_no", "block").orderBy("line"))
    sizes = rows.groupBy("file_no", "block").count()  # a row for each block of a file
    before = F.coalesce(F.sum("count").over(Window.orderBy("file_no", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("file_no", "block", before.alias("__base"))
    joined = rows.withColumn("__i", inside).join(base, ["file_no", "block"])
    return joined.withColumn("row_index", (F.col("__i") + F.col("__base")).cast("int")).drop("__i", "__base", "file_no", "block", "line")


def read_inventory(spark: SparkSession, manifest: InventoryManifest) -> DataFrame:
    """(bucket, key, version, size, mtime_ns, ord) of an object inventory; keys unescaped.

    Broken quoting, too few columns, a size that is no integer or an unsound escape raises.
    """
    c = manifest.columns
    width = max(c[n] for n in ("bucket", "key", "size")) + 1
    rows = _records(spark, manifest.files).withColumn("r", without_end(F.col("raw")))
    rows = rows.withColumn("f", F.when(sound_quotes(F.col("r")), split_record(F.col("r"))))
    rows = rows.where(_raise_unless(F.coalesce(F.size("f") >= width, F.lit(False)), "not an inventory record", F.col("r")))
    at = lambda n: F.get("f", F.lit(c[n])) if n in c else F.lit(None).cast("string")
    size = F.trim(at("size")).try_cast("bigint")
    size = F.coalesce(size, F.raise_error(F.concat(F.lit("inventory size isn't a number: "), at("size"))).cast("long"))
    key = F.coalesce(F.try_url_decode(at("key")), F.raise_error(F.concat(F.lit("bad key escape: "), at("key"))).cast("string"))
    return rows.select(
        at("bucket").alias("bucket"), key.alias("key"), F.coalesce(at("versionid"), F.lit("")).alias("version"), size.alias("size"),
        timestamp_ns(at("lastmodifieddate")).alias("mtime_ns"), F.struct("file_no", "block", "line").alias("ord"),
    )


def timestamp_ns(c):
    """Nanoseconds since 1970 of an ISO time (`T` or a blank, fractions, Z or an offset, else UTC); 0 for anything else."""
    t = F.trim(c)
    sound = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?$")
    digits = F.rpad(F.regexp_extract(t, r"\.(\d{1,9})", 1), 9, "0")
    plain = F.regexp_replace(F.regexp_replace(t, r"\.\d+", ""), r"([+-]\d\d)(\d\d)$", "$1:$2")
    zoned = F.when(plain.rlike(r"(Z|[+-]\d\d:\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    seconds = F.unix_seconds(F.try_to_timestamp(F.when(sound, F.regexp_replace(zoned, " ", "T"))))
    return F.coalesce(seconds * 1_000_000_000 + F.coalesce(F.try_to_number(digits, F.lit("999999999")).cast("long"), F.lit(0)), F.lit(0))


def lookup_table(objects: DataFrame) -> DataFrame:
    """(bucket, key, version, size, mtime_ns), one row per key: the last of equal versions; and for the version '' the last
    row without a version, or else the first of all."""
    value = F.struct("size", "mtime_ns")
    exact = objects.where(F.col("version") != "").groupBy("bucket", "key", "version").agg(F.max_by(value, "ord").alias("v"))
    none = objects.groupBy("bucket", "key").agg(
        F.coalesce(
            F.max_by(value, F.when(F.col("version") == "", F.col("ord"))), F.min_by(value, F.when(F.col("version") != "", F.col("ord")))
        ).alias("v")
    )
    rows = exact.unionByName(none.withColumn("version", F.lit("")))
    return rows.select("bucket", "key", "version", "v.size", "v.mtime_ns")


def with_metadata(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows with size, mtime_ns and sized from the lookup: by (bucket, key, version), then without the version.

    Both are left joins on a presence flag, as a size of 0 is a hit.
    """
    v = lookup.where(F.col("version") != "").select(
        F.col("bucket"), F.col("key").alias("object_key"), F.col("version").alias("version_id"), F.struct("size", "mtime_ns").alias("__v")
    )
    n = lookup.where(F.col("version") == "").select("bucket", F.col("key").alias("object_key"), F.struct("size", "mtime_ns").alias("__n"))
    hit = F.coalesce("__v", "__n")
    joined = rows.join(v, ["bucket", "object_key", "version_id"], "left").join(n, ["bucket", "object_key"], "left")
    return joined.select(*rows.columns, hit["size"].alias("size"), hit["mtime_ns"].alias("mtime_ns"), hit.isNotNull().alias("sized"))


def with_markers(rows: DataFrame) -> DataFrame:
    """rows (of with_metadata) with marker: a usable row that only stands for a folder, as its key ends in a slash and
    its size is 0 or unknown. It was sized, if it was, but isn't usable any more; only usable rows count as sized."""
    marker = (F.col("usable") == 1) & F.endswith("object_key", F.lit("/")) & (F.coalesce("size", F.lit(0)) == 0)
    return (
        rows.withColumn("marker", marker)
        .withColumn("sized", F.col("sized") & (F.col("usable") == 1))
        .withColumn("err", F.when(F.col("marker"), "marks a folder").otherwise(F.col("err")))
        .withColumn("usable", F.when(F.col("marker"), 0).otherwise(F.col("usable")))
    )


def _counts() -> list:
    done = F.coalesce(F.lower("task_status"), F.lit("")) == "succeeded"
    return [
        F.count(F.lit(1)).alias("rows_total"), F.count_if(done).alias("rows_succeeded"), F.count_if(F.col("usable") == 1).alias("rows_usable"),
        F.count_if(~done).alias("rows_failed"), F.count_if(done & (F.col("usable") == 0) & ~F.col("marker")).alias("rows_unsupported"),
        F.count_if("sized").alias("rows_with_size"), F.count_if("marker").alias("rows_folder_markers"),
    ]


def counters(rows: DataFrame) -> DataFrame:
    """(import_id, buckets, rows_total, rows_succeeded, rows_usable, rows_failed, rows_unsupported, rows_with_size,
    rows_folder_markers) of rows of with_markers, in one pass; repeated rows have to be taken out before."""
    return rows.groupBy("import_id").agg(*_counts(), F.count_distinct("bucket").alias("buckets"))


def bucket_summaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, root, entries) of rows of with_markers: every bucket seen, also without entries, in the order of root."""
    g = rows.groupBy(*keys, "bucket").agg(F.count_if(F.col("usable") == 1).alias("entries"))
    return g.select(*keys, "bucket", F.concat(F.lit("s3://"), "bucket").alias("root"), "entries").orderBy(*keys, "root")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, object_key, copies): objects with more than one usable row, which an import refuses."""
    g = rows.distinct().where(F.col("usable") == 1).groupBy(*keys, "bucket", "object_key")
    return g.agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def entries_of(rows: DataFrame) -> DataFrame:
    """(import_id, bucket, rel_path, name, ext, sha256) of the usable rows."""
    name = base_name(F.col("object_key"))
    return rows.where(F.col("usable") == 1).select(
        "import_id", "bucket", F.col("object_key").alias("rel_path"), name.alias("name"), extension(name).alias("ext"),
        F.lower("checksum_hex").alias("sha256"),
    ).distinct()


@dataclass
class S3Import:
    rows: DataFrame
    entries: DataFrame
    buckets: list[str]
    summary: dict[str, int]
    report_schema: str | None
    per_bucket: list[dict]  # bucket, root, entries, in the order of root


def import_report(spark: SparkSession, manifest: str, inventory: str | None = None) -> S3Import:
    """Everything of a report, checked before anything is stored.

    Folder markers (a key that ends in a slash, of size 0 or unknown) are sized first and then left out. Every
    bucket seen gets a snapshot, also an empty one. A blank bucket or an object with two usable rows raises.
    """
    from cairnframe.functions.exec import cut

    schema, files = report_files(manifest)
    rows = read_report(spark, files)
    if inventory:
        rows = with_metadata(rows, lookup_table(read_inventory(spark, inventory_manifest(inventory))))
    else:
        rows = rows.withColumns({"size": F.lit(0).cast("long"), "mtime_ns": F.lit(0).cast("long"), "sized": F.lit(False)})
    size = F.coalesce("size", F.lit(0))
    rows = cut(with_markers(rows))
    s = rows.agg(*_counts()).first().asDict()
    per_bucket = [r.asDict() for r in bucket_summaries(rows, []).collect()]  # a row for each bucket
    buckets = sorted(r["bucket"] or "" for r in per_bucket)
    if not all(b and b.strip() for b in buckets):
        raise ValueError("a report row has no bucket")
    if (twice := duplicate_keys(rows, []).first()) is not None:
        raise ValueError(f"s3://{twice['bucket']}/{twice['object_key']} has {twice['copies']} usable rows")
    name = base_name(F.col("object_key"))
    entries = rows.where(F.col("usable") == 1).select(
        "bucket", F.col("object_key").alias("rel_path"), sparse_nfc(F.col("object_key")).alias("rel_path_norm"), name.alias("name"),
        extension(name).alias("ext"), size.alias("size"), F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"),
        F.lit(None).cast("string").alias("fingerprint"), F.col("checksum_hex").alias("sha256"), F.lit("ok").alias("state"),
        F.lit(None).cast("string").alias("err"),
    )
    return S3Import(rows.drop("size", "mtime_ns", "sized", "marker"), entries, buckets, s | {"buckets": len(buckets)}, schema, per_bucket)


