"""Execution helpers: cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (a few longs and short strings) that may be broadcast: about 50 MB at most.
BROADCAST_ROWS = 500_000
#: Characters, as JSON, of a table of longer texts that may be broadcast.
BROADCAST_BYTES = 64 << 20


def _temporary() -> str:
    """A folder of the driver that goes when it ends."""
    folder = tempfile.mkdtemp(prefix="cairnframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they import it wherever they run.

    The archive is written on the driver alone; Spark serves it to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cairnframe_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if package.endswith(".zip" + os.sep + "cairnframe"):
        return
    archive = os.path.join(_temporary(), "cairnframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._cairnframe_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is configured (local tests) fall back to a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _temporary()
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later reads survive lost executors.

    The files go with the frame if the session cleans checkpoints (spark.cleaner.referenceTracking.cleanCheckpoints); else
    they stay until the folder is cleared, in local runs until the driver ends.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """df.select(*cols), computed once: later filters and columns don't repeat the expressions, as nothing is pushed
    through a generator. For expressions that cost more than a copy of the row."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, texts: bool = False) -> DataFrame:
    """Hint a broadcast only if df really has at most max_rows rows; beyond, the join shuffles.

    texts says that its columns have no bound of their own (paths, names, maps): then its rows also have to have at most
    BROADCAST_BYTES as JSON. df is counted, so it should be cheap to compute or already cut.
    """
    few = df.limit(max_rows + 1)
    size = F.sum(F.length(F.to_json(F.struct("*")))) if texts else F.lit(0)
    n, size = few.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
