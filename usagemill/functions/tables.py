"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str | None] = ContextVar("folder of written tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only in a local session without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """An unused path in the shared folder, or in that of `tables_in`."""
    return f"{(_folder.get() or shared_dir(spark)).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """As `written`, bucketed by a column: a join by it leaves the rows where they are. A task writes a file for each bucket that it has rows of."""
    spark = df.sparkSession
    name, path = f"bucketed_{uuid.uuid4().hex}", path or new_path(spark)
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: its files are in the shared folder
    return found


@contextmanager
def tables_in(folder: str) -> Iterator[str]:
    """Inside, `written` writes to a folder, so that all tables of a job can be removed together once its result is written."""
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Inside, tables are written to a folder that is removed at the end, an action's shuffle files are removed once it ends, and Parquet is written
    with the codec that makes it small. For jobs that leave nothing behind but what they commit elsewhere.
    """
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    was, folder = {k: spark.conf.get(k, None) for k in settings}, new_path(spark, "scratch")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        with tables_in(folder):
            yield folder
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        removed(spark, folder)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of tables."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
