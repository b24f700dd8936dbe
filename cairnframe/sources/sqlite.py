"""Tables of SQLite files as a Spark data source, so that inventories kept in such a file can be taken over."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows that a reader hands on at a time.
CHUNK = 10_000


def connect(path: str) -> sqlite3.Connection:
    """Open a file read-only; text that isn't UTF-8 shows its odd bytes escaped."""
    for mode in ("mode=ro", "mode=ro&immutable=1"):  # the second for folders that can't be written to
        c = sqlite3.connect(f"file:{quote(path)}?{mode}", uri=True)
        try:
            c.execute("SELECT count(*) FROM sqlite_master").fetchone()
        except sqlite3.OperationalError:
            c.close()
            continue
        c.text_factory = lambda b: b.decode("utf-8", "backslashreplace")
        return c
    raise OSError(f"{path} can't be opened as a database")


def columns_of(path: str) -> dict[str, list[str]]:
    """The tables of a file with their columns."""
    with closing(connect(path)) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: [r[1] for r in c.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}


def rows_of(path: str, name: str) -> list[dict]:
    """All rows of a small table (roots, scans, metadata)."""
    with closing(connect(path)) as c:
        c.row_factory = sqlite3.Row
        return [dict(r) for r in c.execute(f"SELECT * FROM {_quoted(name)}")]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.wanted = int(options.get("partitions", "32"))

    def partitions(self) -> list[InputPartition]:
        """Equal ranges of row numbers."""
        with closing(connect(self.path)) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(1, 0)]
        step = -(-(high - low + 1) // self.wanted)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        target = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema.fields])
        cols = ", ".join(_quoted(f.name) for f in self.schema.fields)
        with closing(connect(self.path)) as c:
            at = c.execute(f"SELECT {cols} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while rows := at.fetchmany(CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), target.types)], schema=target)


class SqliteSource(DataSource):
    """format("cairn_sqlite"): options path, table, partitions; a schema of longs, ints and strings. Executors have to see the path."""

    @classmethod
    def name(cls) -> str:
        return "cairn_sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType, partitions: int = 32) -> DataFrame:
    """The columns of a table that both the schema and the file have."""
    spark.dataSource.register(SqliteSource)
    have = set(columns_of(path)[table])
    own = StructType([f for f in schema.fields if f.name in have])
    return spark.read.format("cairn_sqlite").schema(own).options(path=path, table=table, partitions=str(partitions)).load()
