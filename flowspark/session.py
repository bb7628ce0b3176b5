"""Session settings and lineage cuts."""

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings apply."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("flowspark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python tasks import this package wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="flowspark-"), "flowspark_tasks.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later jobs see one fixed result.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session without it
    (a test, a laptop) gets a temporary one.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


SHUFFLE_CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Like :func:`cut_lineage`, as compressed Parquet: a wide table takes a fraction of a checkpoint's disk.

    Neither the order of the rows nor their tasks stay, and the shuffles of the writing job go at its end. ``keep`` spares the table when :func:`passing_tables` ends.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, "table")
    if _passing and not keep:
        _passing[-1].append(path)
    cleaning = spark.conf.get(SHUFFLE_CLEANING, None)
    spark.conf.set(SHUFFLE_CLEANING, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANING) if cleaning is None else spark.conf.set(SHUFFLE_CLEANING, cleaning)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are :func:`stored` in here at the end; for what only leads to a table that is stored itself."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowspark-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
