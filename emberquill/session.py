"""Session set-up, shared-folder materialisation and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables materialised by this process.
_WRITTEN: list[str] = []


def build_session(app_name: str = "emberquill", master: str | None = None, cpus: int = 8) -> SparkSession:
    """A session with the settings the operators assume; local unless a master is given.

    The number of shuffle partitions is the cores' only on a local master; a cluster keeps its own.
    """
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    if (master or "local").startswith("local") and not (master or "").startswith("local-cluster"):
        builder = builder.config("spark.sql.shuffle.partitions", str(cpus))
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMBERQUILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_emberquill_shipped", False):
        return
    sc._emberquill_shipped = True
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="emberquill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/emberquill.zip", "w") as out:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(f"{folder}/emberquill.zip")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A driver table by name."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it must be set (RuntimeError).  On a local
    master without it a folder of this machine is made once and set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="emberquill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors; columns unread later aren't decoded.  The
    table stays until ``discard`` or ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/emberquill-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._emberquill_path = path
    return written


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        if (path := getattr(df, "_emberquill_path", None)) in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def count_at_most(df: DataFrame, bound: int) -> int:
    """Rows of ``df``, counting no further than ``bound`` + 1: the size check before a broadcast."""
    return df.limit(bound + 1).count()


def release(spark: SparkSession) -> int:
    """Deletes the tables materialised so far, for long-lived sessions; results not yet read are lost.  Returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def in_blocks(df: DataFrame, key: str, size: int) -> Iterator[list[Row]]:
    """The rows of ``df`` in lists of about ``size``; one job if they fit in one list."""
    first = df.limit(size + 1).collect()
    if len(first) <= size:
        yield first
        return
    blocks = -(-df.count() // size)
    for b in range(blocks):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()


def local(df: DataFrame, most: int) -> DataFrame:
    """A small table held by the driver; raises if it has more than ``most`` rows."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


__all__ = ["build_session", "count_at_most", "discard", "in_blocks", "local", "materialise", "release", "shared_folder", "ship", "table"]
