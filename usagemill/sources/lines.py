"""Line-oriented logs as DataFrames: files, complete lines, the corrupt-line gate, file manifests.

A sync reads files in pieces, as Spark splits text, and numbers their lines afterwards; `read_files` and `contents` give small files whole, one row a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.functions.tables import new_path, removed, written

ISSUE = "source string, file string, ordinal long, category string, severity string, identifier string, field_path string, value_type string"
PREFIX_BYTES = 4096


def read_files(spark: SparkSession, paths: list[str], glob: str = "*.jsonl") -> DataFrame:
    """A1, A2: (file, value) of all files under the folders; a folder within another one isn't listed twice."""
    tops = {p.rstrip("/") for p in paths}
    tops = sorted(p for p in tops if not any(p.startswith(f"{q}/") for q in tops))
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(tops, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("file"), "value")


def lines(files: DataFrame) -> DataFrame:
    """(file, ordinal, line) of newline-terminated lines; an unterminated tail isn't read yet."""
    cut = F.split("value", "\n", -1)
    return files.select("file", F.posexplode(F.slice(cut, 1, F.size(cut) - 1)).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal").cast("long"))


def corrupt_gate(rows: DataFrame, source: str, derived: dict[str, Column] | None = None, kept: list[Column | str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, issues): a line that is no JSON object, or has a replaced character, ends its file; one issue is recorded there.

    Lines are parsed once, into a table, with columns that are derived from the variant v and may use the ones before: filters on them
    would else work them out again for every mention. With kept, the table has these columns only, beside file and ordinal. Which line ends a
    file is an aggregate, so that a long file isn't gathered in one task.
    """
    parsed = rows.withColumn("v", F.try_parse_json("line"))
    fine = is_object(F.col("v")) & ~F.contains("line", F.lit("�"))
    judged = parsed.withColumn("_bad", F.when(fine, None).otherwise(F.col("ordinal")))
    for name, column in (derived or {}).items():
        judged = judged.withColumn(name, column)
    judged = written(judged if kept is None else judged.select("file", "ordinal", "_bad", *kept))
    first = written(judged.where("_bad IS NOT NULL").groupBy("file").agg(F.min("_bad").alias("_first")))  # of known size: few files don't shuffle the lines
    judged = judged.join(first, "file", "left")
    good = judged.where(F.col("_first").isNull() | (F.col("ordinal") < F.col("_first"))).drop("_bad", "_first")
    return good, issue(judged.where(F.col("ordinal") == F.col("_first")), source, "invalid_jsonl")


#: Text that from_json may have read from a JSON number, literal, object or array as well.
_UNSURE = r"^(-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?|true|false|[{\[](?s:.*))$"


def exact(read: Column, v: Column, path: str) -> Column:
    """A string that from_json has read from a path, where it is one in the variant too; anything else is null."""
    return F.when(read.rlike(_UNSURE), string_at(v, path)).otherwise(read)


BLOCK_LINES = 65_536


def carried(rows: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """rows (file, ordinal, ...) with the column `name` of the last of marks (file, ordinal, name) up to each, in the file; null before the first.

    Files are dealt out in blocks of lines; what a block ends with goes to the blocks after it, up to the one that has a mark again.
    """
    block = F.floor(F.col("ordinal") / BLOCK_LINES).alias("_block")
    ends = marks.groupBy("file", block).agg(F.max_by(name, "ordinal").alias(name))
    lasts = rows.groupBy("file").agg(F.floor(F.max("ordinal") / BLOCK_LINES).alias("_end"))
    until = F.coalesce(F.lead("_block").over(Window.partitionBy("file").orderBy("_block")), F.col("_end"))
    spans = ends.join(lasts, "file").withColumn("_until", until).where("_until > _block")
    before = spans.select("file", F.explode(F.sequence(F.col("_block") + 1, "_until")).alias("_block"), F.struct(name).alias("_was"))
    both = rows.withColumn("_mark", F.lit(None).cast(marks.select(F.struct(name)).schema[0].dataType)).withColumn("_row", F.lit(1))
    both = both.unionByName(marks.select("file", "ordinal", F.struct(name).alias("_mark"), F.lit(0).alias("_row")), allowMissingColumns=True)
    within = Window.partitionBy("file", "_block").orderBy("ordinal", "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_block", block).withColumn("_mark", F.last("_mark", ignorenulls=True).over(within)).where("_row = 1")
    return found.join(before, ["file", "_block"], "left").withColumn(name, F.coalesce("_mark", "_was")[name]).drop("_block", "_mark", "_was", "_row")


def issue(rows: DataFrame, source: str, category: str, observed: str | None = None, severity: str = "error") -> DataFrame:
    """Issue rows of rejected records: where, and the kind of value at the path `observed`, never the content."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("v", observed, "variant")), F.lit("none")) if observed else F.lit(None).cast("string")
    return rows.select(
        F.lit(source).alias("source"), "file", "ordinal", F.lit(category).alias("category"), F.lit(severity).alias("severity"),
        F.concat_ws(":", "file", F.col("ordinal").cast("string")).alias("identifier"), F.col("ordinal").cast("string").alias("field_path"), F.regexp_extract(kind, "^[A-Za-z]*", 0).alias("value_type"),
    )


MANIFEST = "path_hash string, file string, generation int, size long, modified timestamp, prefix_hash string, first_seen long, last_ordinal long, is_missing boolean, changed boolean"


def listing(spark: SparkSession, paths: list[str], glob: str = "*.jsonl") -> DataFrame:
    """A10: (path_hash, file, size, modified) of listed files. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    return found.select(F.sha2("path", 256).alias("path_hash"), F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, value) of named files, whole; bytes that are no UTF-8 become the replacement character."""
    return spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("value"))


def numbered(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, ordinal, line) of the newline-terminated lines of named files of any size, as a table; bytes that are no UTF-8 become the replacement character.

    Files are split, lines are numbered in their piece, and pieces begin after the lines of those before. An unterminated tail shows in the bytes:
    the file has one less than its lines with their ends. A byte order mark, which the reader skips (3 bytes less), stays part of the first line.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = spark.read.option("lineSep", "\n").text(files).select(
        F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/").alias("file"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        F.octet_length("value").alias("_bytes"), F.make_valid_utf8("value").alias("line"),
    )
    raw = written(found, at := new_path(spark))
    file = Window.partitionBy("file")
    pieces = raw.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_bytes") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    before = F.coalesce(F.sum("_n").over(file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.sum("_bytes").over(file) - F.max("_size").over(file)
    pieces = pieces.select("file", "_start", "_first", before.alias("_before"), F.sum("_n").over(file).alias("_lines"), extra.alias("_extra"))
    placed = raw.drop("_size", "_bytes").join(pieces, ["file", "_start"]).withColumn("ordinal", F.col("_before") + F.col("_id") - F.col("_first"))
    tail = ((F.col("_extra") > 0) | (F.col("_extra") == -2)) & (F.col("ordinal") == F.col("_lines") - 1)
    marked = F.col("_extra").isin(-2, -3) & (F.col("ordinal") == 0)
    out = written(placed.where(~tail).select("file", "ordinal", F.when(marked, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")).alias("line")))
    removed(spark, at)
    return out


LARGE = 16_000_000


def _heads(spark: SparkSession, files: list[str], large: list[str]) -> DataFrame:
    """(file, head): the first PREFIX_BYTES of named files; those of large files are read from there alone, so that no file moves whole."""
    out = spark.createDataFrame([], "file string, head binary")
    if files:
        out = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), F.substring("content", 1, PREFIX_BYTES).alias("head"))
    found = []
    for name in large:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            found.append((name, bytearray(stream.readNBytes(PREFIX_BYTES))))
        finally:
            stream.close()
    return out.unionByName(spark.createDataFrame(found, "file string, head binary")) if found else out


def next_manifest(prior: DataFrame, listed: DataFrame, version: int = 0) -> DataFrame:
    """MANIFEST after a listing. prior has the latest row of each path.

    Only files whose size or time differs from the row before, or that had been missing, are opened, and only their first PREFIX_BYTES go on.
    A file is a new generation if it had been missing, shrank, or its first bytes, as far as they reached before, differ; an append isn't
    one. A path that isn't listed is missing. The names of the files to open pass through the driver, as Spark's own listing does.
    """
    spark = prior.sparkSession
    old = prior.select("path_hash", *[F.col(c).alias(f"_{c}") for c in ("file", "generation", "size", "modified", "prefix_hash", "first_seen", "last_ordinal", "is_missing")])
    joined = listed.join(old, "path_hash", "full")
    gone, new = F.col("file").isNull(), F.col("_file").isNull()
    differs = ~gone & (new | F.col("_is_missing") | (F.col("size") != F.col("_size")) | ~F.col("modified").eqNullSafe(F.col("_modified")))
    opened = [(r.file, r.size) for r in joined.where(differs).select("file", "size").toLocalIterator()]
    heads = _heads(spark, [f for f, n in opened if n < LARGE], [f for f, n in opened if n >= LARGE])
    joined = joined.join(heads, "file", "left")
    before = F.sha2(F.substr("head", F.lit(1), F.least(F.col("_size"), F.lit(PREFIX_BYTES)).cast("int")), 256)
    renewed = differs & ~new & (F.col("_is_missing") | (F.col("size") < F.col("_size")) | (before != F.col("_prefix_hash")))
    generation = F.when(new, F.lit(0)).when(renewed, F.col("_generation") + 1).otherwise(F.col("_generation"))
    return joined.select(
        "path_hash", F.coalesce("file", "_file").alias("file"), generation.cast("int").alias("generation"), F.coalesce("size", "_size").alias("size"), F.coalesce("modified", "_modified").alias("modified"),
        F.when(differs, F.sha2("head", 256)).otherwise(F.col("_prefix_hash")).alias("prefix_hash"), F.coalesce("_first_seen", F.lit(version)).cast("long").alias("first_seen"),
        F.when(new | renewed, F.lit(-1)).otherwise(F.col("_last_ordinal")).cast("long").alias("last_ordinal"), gone.alias("is_missing"), (differs & (new | renewed | (F.col("size") != F.col("_size")))).alias("changed"),
    )


def latest_generation(artifacts: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """of each key, the row with the largest generation."""
    rest = [c for c in artifacts.columns if c not in keys]
    return artifacts.groupBy(*keys).agg(F.max_by(F.struct(*rest), generation).alias("_r")).select(*keys, "_r.*")


def is_object(v):
    """Whether a variant is an object; false for null."""
    return F.try_variant_get(v, "$", "struct<_: variant>").isNotNull()


def whole(number):
    """B2: a non-negative whole number of a variant; anything else is null."""
    value = F.when(F.schema_of_variant(number) == "BIGINT", F.try_variant_get(number, "$", "bigint"))
    return F.when(value >= 0, value)


def text(found):
    """A string of a variant; anything else is null."""
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def strict_long(v, path: str):
    """B2: a non-negative whole number at a path of a variant; anything else is null."""
    return whole(F.try_variant_get(v, path, "variant"))


def string_at(v, path: str):
    """A string at a path of a variant; anything else is null."""
    return text(F.try_variant_get(v, path, "variant"))
