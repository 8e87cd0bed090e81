"""Streaming ingestion of landing zones in which log files arrive whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagemill.ledger import Ledger
from usagemill.sources.lines import lines


def stream_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, value) of files as they arrive."""
    found = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("file"), "value")


def ingest(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls apply with the complete lines of each micro-batch until all files that are there are read. apply appends by key, so that a batch
    that is delivered twice changes nothing; late copies of a log need no watermark for the same reason."""
    query = stream_lines(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(lambda batch, n: apply(lines(batch), n)).start()


def sync_stream(spark: SparkSession, ledger: Ledger, source: str, folder: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Syncs a source's landing folder into a ledger, one commit for each micro-batch of new files.

    The commit carries the stream's name and the batch's number, so that a batch that is delivered again commits nothing, and one that was
    killed before its commit is done anew: its evidence is what the ledger's manifest lacks.
    """
    from usagemill import sync

    found = stream_lines(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return found.foreachBatch(lambda batch, n: sync.sync(spark, ledger, source, [folder], (name or source, n))).start()
