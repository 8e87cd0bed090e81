"""Codex rollout logs: session headers and cumulative token counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.tables import written
from usagemill.functions.tokens import iso_to_ns
from usagemill.operators import lineage, reconcile
from usagemill.sources.lines import carried, corrupt_gate, issue, string_at, whole

# Token fields and the names under which logs give them; of two names the first wins.
FIELDS = {
    "input_tokens": ["input_tokens"], "output_tokens": ["output_tokens"], "cache_read_tokens": ["cache_read_input_tokens", "cached_input_tokens"],
    "cache_write_tokens": ["cache_creation_input_tokens"], "cache_write_5m_tokens": ["cache_creation_5m_input_tokens"], "cache_write_1h_tokens": ["cache_creation_1h_input_tokens"],
    "reasoning_tokens": ["reasoning_output_tokens"], "reported_total_tokens": ["total_tokens"],
}


#: A token count's two usage objects. They are cast whole, as each path of a variant is walked anew.
_NAMES = ", ".join(f"{n}: variant" for names in FIELDS.values() for n in names)
INFO = f"struct<total_token_usage: struct<{_NAMES}>, last_token_usage: struct<{_NAMES}>>"


def _usage(usage: str, prefix: str) -> dict[str, Column]:
    """B2: the token fields of a usage object of `_info`."""
    return {f"{prefix}_{f}": F.coalesce(*[whole(F.col(f"_info.{usage}.{n}")) for n in names]) for f, names in FIELDS.items()}


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines (file, ordinal, line) to observations, sessions, runs and issues."""
    v = F.col("v")
    rows, issues = corrupt_gate(lines, "codex", {"type": string_at(v, "$.type"), "kind": string_at(v, "$.payload.type"), "observed_at_ns": iso_to_ns(string_at(v, "$.timestamp"))})
    header = F.col("type") == "session_meta"
    id_ = F.nullif(string_at(v, "$.payload.id"), F.lit(""))
    headers = rows.where(header).withColumn("id", id_)
    # an owner's stretch ends where the owner changes; a header without an id clears the owner and ends it too
    placed = Window.partitionBy("file").orderBy("ordinal")
    turns = (~F.col("id").eqNullSafe(F.lag("id").over(placed))).cast("int")
    marks = headers.select("file", "ordinal", "id", turns.alias("_turn")).select("file", "ordinal", F.struct("id", F.sum("_turn").over(placed.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch")).alias("_owner"))
    count = rows.where((F.col("type") == "event_msg") & (F.col("kind") == "token_count"))
    count = count.withColumn("_info", F.try_variant_get(v, "$.payload.info", INFO))
    count = count.withColumns(_usage("total_token_usage", "total") | _usage("last_token_usage", "last")).drop("_info")
    some = lambda p: F.coalesce(*[F.col(f"{p}_{f}") for f in FIELDS]).isNotNull()
    valid = some("total") & some("last")
    # a table, as filters on these columns would work each of them out again for every mention
    count = carried(count.withColumn("valid", valid).drop("line").withColumn("v", F.when(~F.col("valid"), F.col("v"))), marks, "_owner")
    count = written(count.withColumns({"owner": F.col("_owner.id"), "stretch": F.col("_owner.stretch")}).drop("_owner"))
    valid, owned = F.col("valid"), count.where("owner IS NOT NULL")
    # the ordinal within an owner's stretch of the file
    stretch = owned.where(valid).withColumn("sequence", F.row_number().over(Window.partitionBy("file", "stretch").orderBy("ordinal")) - 1)
    named = headers.where("id IS NOT NULL").select(
        F.lit("codex").alias("source"), F.col("id").alias("source_session_id"), string_at(v, "$.payload.cli_version").alias("harness_version"),
        string_at(v, "$.payload.model_provider").alias("provider"), string_at(v, "$.payload.model").alias("model"), F.nullif("observed_at_ns", F.lit(0).cast("long")).alias("started_at_ns"), "file", "ordinal",
    )
    found = issues.unionByName(issue(headers.where("id IS NULL"), "codex", "missing_session_id", "$.payload.id")).unionByName(issue(count.where("owner IS NULL"), "codex", "missing_owner")).unionByName(issue(owned.where(~valid), "codex", "invalid_usage", "$.payload.info"))
    observations = stretch.select(
        F.lit("codex").alias("source"), "file", "ordinal", "owner", "sequence", "observed_at_ns",
        reconcile.fingerprint(["owner", "observed_at_ns", *[f"{p}_{f}" for p in ("last", "total") for f in FIELDS]]).alias("fingerprint"), *[f"{p}_{f}" for p in ("total", "last") for f in FIELDS],
    )
    return {"observations": observations, "sessions": named, "runs": named.select("source", "source_session_id", F.col("source_session_id").alias("source_run_id"), F.lit("session").alias("role"), "model", "started_at_ns"), "issues": found}


def numbered(observations: DataFrame, artifact: str) -> DataFrame:
    """Observations with what each adds and how often its fingerprint came back."""
    fields = list(FIELDS)
    deltas = reconcile.counter_delta(observations, fields, "owner", artifact)
    return reconcile.repeat_occurrence(deltas, fields, "fingerprint", "owner", artifact)


def _event_key() -> Column:
    return F.concat(F.lit("codex:"), "fingerprint", F.when(F.col("occurrence") > 0, F.concat(F.lit(":repeat:"), F.col("occurrence").cast("string"))).otherwise(""))


def links(rows: DataFrame) -> DataFrame:
    """Which observation of `numbered` stands for which event."""
    return rows.select(F.col("owner").alias("evidence_key"), "observation_key", _event_key().alias("event_key"), F.lit("usage_fingerprint").alias("method"))


def events(observations: DataFrame, artifact: str = "file") -> DataFrame:
    """One counted event for each fingerprint and repeat, over all copies of a log."""
    return events_of(numbered(observations, artifact), artifact)


def events_of(rows: DataFrame, artifact: str) -> DataFrame:
    """The events of `numbered` observations."""
    fields = list(FIELDS)
    counted = reconcile.counter_events(rows, fields, "fingerprint", "owner", artifact)
    first = rows.groupBy("owner", "fingerprint").agg(F.min("observed_at_ns").alias("completed_at_ns"))
    key = _event_key()
    return counted.join(first, ["owner", "fingerprint"]).select(F.lit("codex").alias("source"), key.alias("event_key"), F.lit("counter_delta").alias("granularity"), "status", *fields, F.nullif("completed_at_ns", F.lit(0).cast("long")).alias("completed_at_ns"), F.col("owner").alias("source_session_id"), "conflict", F.col("owner").alias("evidence_key"))


def threads(table: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Sessions of a threads table, with the root and depth that spawn edges (parent_thread_id, child_thread_id) give; columns that it lacks are null."""
    wanted = {"model": "string", "model_provider": "string", "reasoning_effort": "string", "cli_version": "string", "created_at": "long", "updated_at": "long"}
    own = table.where("id IS NOT NULL").select(F.col("id").alias("source_session_id"), *[(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])
    links = edges.select(F.col("child_thread_id").alias("node"), F.col("parent_thread_id").alias("parent")).where("node IS NOT NULL") if edges is not None else own.select(F.col("source_session_id").alias("node"), F.lit(None).cast("string").alias("parent"))
    roots = lineage.roots(links.unionByName(own.select(F.col("source_session_id").alias("node"), F.lit(None).cast("string").alias("parent")))).withColumnRenamed("node", "source_session_id")
    parents = links.groupBy(F.col("node").alias("source_session_id")).agg(F.min("parent").alias("parent_session_id"))
    ns = lambda c: (F.col(c) * 1_000_000).alias(f"{c}_ns")
    joined = own.join(parents, "source_session_id", "left").join(roots, "source_session_id", "left")
    return joined.select(F.lit("codex").alias("source"), "source_session_id", "parent_session_id", "root", "depth", "model", F.col("model_provider").alias("provider"), F.col("reasoning_effort").alias("effort"), F.col("cli_version").alias("harness_version"), ns("created_at"), ns("updated_at"))


def turns(table: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Turns of threads, in nanoseconds, and a session and run in name only for each thread that sessions (source_session_id) lacks."""
    ns = lambda c: (F.col(c) * 1_000_000).alias(f"{c}_ns")
    own = table.where("thread_id IS NOT NULL AND turn_id IS NOT NULL").select(F.lit("codex").alias("source"), F.col("thread_id").alias("source_session_id"), F.col("turn_id").alias("source_turn_id"), "status", ns("started_at"), ns("completed_at"), (F.col("duration_ms") * 1_000_000).alias("duration_ns"))
    stubs = own.select("source", "source_session_id").distinct().join(sessions.select("source_session_id"), "source_session_id", "left_anti").select("source", "source_session_id")
    return {"turns": own, "sessions": stubs, "runs": stubs.select("*", F.col("source_session_id").alias("source_run_id"), F.lit("session").alias("role"))}
