"""Several tables of a live store, read at one moment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Changed(RuntimeError):
    """A table has changed since it was listed."""


def _files(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """The data files under a folder, with their size and time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = fs.listFiles(where, True), {}
    while found.hasNext():
        file = found.next()
        if not file.getPath().getName().startswith(("_", ".")):
            out[file.getPath().toString()] = (file.getLen(), file.getModificationTime())
    return out


@dataclass(frozen=True)
class Snapshot:
    """Tables whose files were listed together, and are read from these lists only."""

    spark: SparkSession
    folders: tuple[str, ...]
    listed: tuple[dict[str, tuple[int, int]], ...]
    frames: tuple[DataFrame, ...]

    def check(self) -> None:
        """Raises Changed if a table's files aren't those that were listed."""
        for folder, files in zip(self.folders, self.listed, strict=True):
            if _files(self.spark, folder) != files:
                raise Changed(f"{folder} has changed while it was read")


def snapshot(spark: SparkSession, *folders: str) -> Snapshot:
    """Parquet tables at one moment: all are listed, then listed again, so that what is read existed together."""
    listed = tuple(_files(spark, f) for f in folders)
    if any(not files for files in listed):
        raise FileNotFoundError(f"no files in one of {folders}")
    out = Snapshot(spark, folders, listed, tuple(spark.read.parquet(*sorted(files)) for files in listed))
    out.check()
    return out
