"""Session settings, lineage cuts and size checks shared by every plan."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Defaults for a session this package builds itself. A cluster passes its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "cladeframe", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # One JVM is driver and executors at once.
            builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it.

    A temporary folder is used only in local mode, where driver and executors
    are one process on one machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative plans")
    folder = tempfile.mkdtemp(prefix="cladeframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives lost executors and carries the real
    file size. A checkpoint would keep estimated sizes, which multiply with
    every join of a loop. ``compression`` is for tables of long texts; without
    it the session's codec is used.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for tables in _scratch.values():
        tables.append(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.table_path = path
    return written


BROADCAST_MOST = 1 << 13  # bytes of a written table that joins may still broadcast


def cut_apart(df: DataFrame) -> DataFrame:
    """:func:`cut`, and a table beyond a fixed size is joined by shuffles only.

    A broadcast passes through the driver. A plan with a hundred joins would
    send it a hundred tables of up to the session's threshold, all growing
    with the input; here each is bounded by ``BROADCAST_MOST``. The bound is
    a few small files, as a hash table of several key columns takes a whole
    memory page of the driver (tens of MB), however few its rows.
    """
    written = cut(df)
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(written.table_path)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if size <= BROADCAST_MOST:
        return written
    apart = written.hint("merge")
    apart.table_path = written.table_path
    return apart


_scratch: dict[str, list[str]] = {}  # tables written while a scope is open, by its name
_left: dict[str, list[str]] = {}  # tables of closed scopes


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` returned, once all that reads them is written itself."""
    for table in tables:
        path = getattr(table, "table_path", None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def scratch(name: str) -> Iterator[None]:
    """Tables that :func:`cut` writes inside belong to ``name`` and stay until it is swept."""
    _scratch[name] = []
    try:
        yield
    finally:
        _left.setdefault(name, []).extend(_scratch.pop(name))


def sweep(spark: SparkSession, name: str, keep: DataFrame) -> None:
    """Delete the tables left by ``name``, but for those that ``keep`` still reads."""
    paths = _left.pop(name, [])
    if not paths:
        return
    folders = {file.rsplit("/", 2)[-2] for file in keep.inputFiles()}
    for path in paths:
        if path.rsplit("/", 1)[-1] in folders:
            _left.setdefault(name, []).append(path)
        else:
            _delete(spark, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cladeframe-")) / "cladeframe.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
