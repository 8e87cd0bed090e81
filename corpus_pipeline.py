"""From raw documents to packed sequences: quality rules, quality classifier, near duplicates, personal data, packing.

Each stage is one operator over all rows that the stage before kept, written as Parquet and read again. A stage's own tables are removed
when the next stage begins, as what that one reads is written by then; `run` removes the last stage's, and each stage's result once the
next one's is written.

Defined results, as the operators define them: null text counts as empty; such documents, and those with few words, fail the rules. Null
lang and source are groups of their own. Without labels the classifier keeps every document. Of near duplicates the row with the least
doc_id stays (ids before nulls, then by content); rows that share an id but not a text both stay, repeated rows don't. Extra columns pass
through all stages but packing. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.tables import new_path, removed, tables_in
from usagemill.llm import cotrain, near_copies, packing, pii, quality_rules
from usagemill.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The tables of this thread's last stage; each thread's pipeline has its own.
_tables: ContextVar[str | None] = ContextVar("tables of the last stage", default=None)
#: The setting that holds the key of pseudonyms.
KEY = "spark.usagemill.pseudonym.key"


def _end_stage(spark: SparkSession) -> None:
    if (folder := _tables.get()) is not None:
        removed(spark, folder)
        _tables.set(None)


def _stage(of: Stage) -> Stage:
    @wraps(of)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _end_stage(spark)
        _tables.set(folder := new_path(spark, "stage"))
        with tables_in(folder):
            return of(spark, docs, sf_dir)

    return stage


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept(docs)


@_stage
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.kept(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicated(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY, None)  # without one, values are linked within this run only, and nobody can undo them
    return pii.pseudonymised(docs, key or secrets.token_hex(32)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    _end_stage(spark)
    return docs
