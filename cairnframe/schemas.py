"""Schemas of the stored tables, and what older layouts lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


METADATA = _schema(("key", _S, False), ("value", _S, False))
ROOTS = _schema(("machine_id", _S, False), ("root", _S, False), ("current_scan_id", _L, True))
SCANS = _schema(
    ("scan_id", _L, False), ("machine_id", _S, False), ("hostname", _S, False), ("root", _S, False),
    ("started_at", _L, False), ("finished_at", _L, True), ("status", _S, False), ("goos", _S, True),
    ("goarch", _S, True), ("fs_type", _S, True), ("case_sensitive", _I, True),
)
ENTRIES = _schema(
    ("scan_id", _L, False), ("rel_path", _S, False), ("rel_path_norm", _S, True), ("name", _S, False),
    ("ext", _S, False), ("size", _L, False), ("mtime_ns", _L, False), ("fingerprint", _S, True), ("sha256", _S, True),
    ("state", _S, True), ("err", _S, True),
)
S3_IMPORTS = _schema(
    ("import_id", _L, False), ("manifest_path", _S, False), ("report_schema", _S, True), ("imported_at", _L, False),
    ("buckets", _I, False), ("rows_total", _I, False), ("rows_succeeded", _I, False), ("rows_usable", _I, False),
    ("rows_failed", _I, False), ("rows_unsupported", _I, False), ("rows_with_size", _I, False),
    ("rows_folder_markers", _I, False),
)
S3_REPORT_ROWS = _schema(
    ("import_id", _L, False), ("row_index", _I, False), ("bucket", _S, False), ("object_key", _S, False),
    ("version_id", _S, True), ("task_status", _S, True), ("error_code", _S, True), ("http_status_code", _L, True),
    ("result_message", _S, True), ("etag", _S, True), ("checksum_base64", _S, True), ("checksum_hex", _S, True),
    ("checksum_algorithm", _S, True), ("checksum_type", _S, True), ("usable", _I, False), ("err", _S, True),
)
TABLES = {
    "metadata": METADATA, "roots": ROOTS, "scans": SCANS, "entries": ENTRIES, "s3_imports": S3_IMPORTS,
    "s3_report_rows": S3_REPORT_ROWS,
}
STATUSES = ("running", "complete", "failed")


def upgrade(df: DataFrame, name: str, machine_id: str = "", hostname: str = "") -> DataFrame:
    """df with the columns of table `name`, in order and type.

    Missing columns of older layouts come out as NULL; a missing machine_id or hostname is the given one, missing
    counters are 0. Other columns are dropped.
    """
    given = {"machine_id": F.lit(machine_id), "hostname": F.lit(hostname)}
    cols = []
    for f in TABLES[name].fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name in given:
            c = given[f.name]
        elif name == "s3_imports" and isinstance(f.dataType, T.IntegerType):
            c = F.lit(0)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def is_compatible(columns: dict[str, set[str]]) -> bool:
    """Whether a set of tables (name: columns) is an inventory: roots, scans and entries with their keys."""
    need = {"roots": {"root", "current_scan_id"}, "scans": {"scan_id", "root", "status"}, "entries": {"scan_id", "rel_path", "size", "mtime_ns"}}
    return all(cols <= columns.get(t, set()) for t, cols in need.items())
