"""Checks of what leaves the ledger, and what of a source's metadata may come in: key names, private strings, contracts, keyed hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from usagemill.functions.tables import written

# Parts that no key of public output may have, fields that hold public addresses, and keys that no kept metadata may have.
FORBIDDEN_PARTS = ["session", "run_id", "event", "prompt", "reasoning", "path", "artifact"]
ADDRESSES = ["url", "canonical_url"]
FORBIDDEN_KEYS = [
    "content", "prompt", "prompts", "assistant", "assistanttext", "reasoning", "reasoningtext", "summary", "summaries", "command", "commands", "arguments", "argument", "toolarguments", "toolargument",
    "results", "result", "toolresults", "toolresult", "rawerror", "rawerrors", "attachment", "attachments", "rawapi", "rawapibody", "apibody", "cwd", "rawcwd", "workingdirectory",
]


# ---- trees


def flattened(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """(keys, place, key, kind, value): every object field and array item of a variant column at any depth, level by level.

    place is the way from the top (`.name` for a field, `[]` for an item), key the field's name (for items that of their array), kind the schema of
    the value as a variant, value a variant.
    """
    spark = rows.sparkSession
    level = written(rows.select(*keys, F.lit("").alias("place"), F.lit(None).cast("string").alias("key"), F.col(tree).alias("value")))
    out = []
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("_pos", "_key", "_value"))
        level = written(
            inner.select(*keys, F.concat("place", F.coalesce(F.concat(F.lit("."), "_key"), F.lit("[]"))).alias("place"), F.coalesce("_key", "key").alias("key"), F.schema_of_variant("_value").alias("kind"), F.col("_value").alias("value"))
        )
        if not level.limit(1).count():
            break
        out.append(level)
        level = level.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").drop("kind")
    return reduce(DataFrame.unionByName, out) if out else level


# ---- what may be published


def has_forbidden_part(key: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(key), F.lit(p)) for p in FORBIDDEN_PARTS])


def is_private(value: Column) -> Column:
    """K2: whether a string is a local address: a file address, a home, absolute or drive path, or one with a backslash or a step up."""
    low = F.lower(value)
    return low.startswith("file:") | low.startswith("~/") | value.startswith("/") | value.rlike(r"(?s)\A.:") | F.contains(value, F.lit("\\")) | value.rlike(r"(?:\A|/)\.\.(?:/|\z)")


def _walk(kind: DataType, at: str = ""):
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield f.name, f"{at}.{f.name}".lstrip("."), f.dataType
            yield from _walk(f.dataType, f"{at}.{f.name}")
    elif isinstance(kind, ArrayType):
        yield from _walk(kind.elementType, f"{at}[]")
    elif isinstance(kind, MapType):
        yield from _walk(kind.valueType, f"{at}{{}}")


def forbidden_keys(df: DataFrame) -> list[str]:
    """K1: places of columns and fields whose name has a forbidden part, whatever its case."""
    return [at for name, at, _ in _walk(df.schema) if any(p in name.lower() for p in FORBIDDEN_PARTS)]


def _any_private(value: Column, kind: DataType, exempt: tuple[str, ...]) -> Column:
    if isinstance(kind, StringType):
        return F.coalesce(is_private(value), F.lit(False))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a | b, [_any_private(value[f.name], f.dataType, exempt) for f in kind.fields if f.name not in exempt], F.lit(False))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(value, lambda x: _any_private(x, kind.elementType, exempt)), F.lit(False))
    if isinstance(kind, MapType):
        return F.coalesce(F.exists(F.map_values(value), lambda x: _any_private(x, kind.valueType, exempt)), F.lit(False))
    return F.lit(False)


def private_strings(df: DataFrame, exempt: tuple[str, ...] = tuple(ADDRESSES)) -> DataFrame:
    """K2: rows that have a local address in a string at any depth, but in fields that hold public addresses; no row for clean output."""
    return df.where(reduce(lambda a, b: a | b, [_any_private(F.col(f"`{f.name}`"), f.dataType, exempt) for f in df.schema.fields if f.name not in exempt], F.lit(False)))


def payload_problems(payloads: DataFrame, value: str = "value") -> DataFrame:
    """K1, K2 of JSON texts: (place, problem) of keys with a forbidden part, strings that are local addresses, and texts that are no JSON."""
    parsed = payloads.select(F.try_parse_json(value).alias("tree"))
    every = flattened(parsed.where("tree IS NOT NULL"), [], "tree")
    text = F.try_variant_get("value", "$", "string")
    private = (F.col("kind") == "STRING") & ~F.coalesce(F.col("key").isin(ADDRESSES), F.lit(False)) & is_private(text)
    problem = F.when(F.col("place").endswith(F.col("key")) & has_forbidden_part(F.col("key")), "forbidden key").when(private, "private string")
    return every.select("place", problem.alias("problem")).where("problem IS NOT NULL").unionByName(parsed.where("tree IS NULL").select(F.lit("").alias("place"), F.lit("no JSON").alias("problem")))


def contract(df: DataFrame, schema: StructType, checks: dict[str, Column]) -> tuple[bool, DataFrame]:
    """K3: whether the columns and types are exactly those of schema, and the rows that break a named check, with its name."""
    same = [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return same, df.withColumn("broken", broken).where(F.size("broken") > 0)


def publish(payload: DataFrame, folder: str, kind: str | None = None, value: str = "value") -> None:
    """K1-K3 in force: writes JSON texts aside, checks what was written, and puts it in the place of `folder` by one rename only if it is clean.

    kind: the SQL type that each text has to fit without another field or a field of another type. What isn't clean is removed, and its
    problems are raised; what was published before stays then.
    """
    spark, aside, old = payload.sparkSession, f"{folder}.aside-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    payload.select(value).write.text(aside)
    written_ = spark.read.text(aside, wholetext=False)
    problems = [f"{r.problem} at {r.place}" for r in payload_problems(written_).limit(20).collect()]
    if kind is not None:
        again = F.to_json(F.from_json("value", kind, {"mode": "PERMISSIVE"}))
        same = F.to_json(F.try_parse_json(again)).eqNullSafe(F.to_json(F.try_parse_json("value")))
        problems += ["it doesn't fit its contract"] * written_.where(~same).limit(1).count()
    if problems:
        fs.delete(path(aside), True)
        raise ValueError("; ".join(problems))
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(old))
    fs.rename(path(aside), path(folder))
    fs.delete(path(old), True)


# ---- what may come in


def scrubbed(rows: DataFrame, keys: list[str], usage: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, rejected) of usage objects (a variant column) at any depth.

    leaves (keys, place, value): numbers and booleans as JSON; strings, nulls and items of arrays are dropped. rejected (keys, place): fields with a forbidden
    name, whatever its case and underscores, but for numbers called reasoning; rows with one must not be kept.
    """
    every = flattened(rows, keys, usage).where("place NOT LIKE '%[]%'")
    number = F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("kind").startswith("DECIMAL")
    name = F.replace(F.lower("key"), F.lit("_"), F.lit(""))
    bad = name.isin(FORBIDDEN_KEYS) & ~((name == "reasoning") & number)
    leaves = every.where((number | (F.col("kind") == "BOOLEAN")) & ~bad).select(*keys, "place", F.to_json("value").alias("value"))
    return leaves, every.where(bad).select(*keys, "place")


def workspace_hash(cwd: Column, salt: str) -> Column:
    """A salted one-way hash of a working directory."""
    return F.sha2(F.concat(F.lit(salt), cwd), 256)
