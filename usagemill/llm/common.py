"""Small helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.tables import shared_dir, written

__all__ = ["SPACES", "SPACE_RUN", "bounded_sample", "shared_dir", "small_join", "table", "words_of", "written"]

#: The space characters that part words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those first by the hash of their key. Rows are counted first, so that few more than these leave their partitions."""
    n = rows.count()
    slots = 1_000_003
    if n > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(slots)) < -(-slots * most * 5 // (4 * n)))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000, salts: int = 64) -> DataFrame:
    """Equi-join with a right side whose keys are unique.

    right is counted first (pass a written table). Up to max_rows it is broadcast. Beyond that each of its
    rows is repeated under `salts` salts, so that a key with a large share of left's rows is dealt over as many tasks.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def words_of(text: Column) -> Column:
    """Words of a text that has been freed of nulls: runs of other than SPACES."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))
