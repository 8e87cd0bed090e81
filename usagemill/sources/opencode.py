"""OpenCode tables (session, message, part): step-finish parts, or the message itself where it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.tokens import money_to_nanos
from usagemill.operators import reconcile
from usagemill.sources.lines import whole

# Columns that the tables need, and the version that is supported.
NEEDED = {"session": ["id", "parent_id", "version", "agent", "time_created", "time_updated"], "message": ["id", "session_id", "time_created", "time_updated", "data"], "part": ["id", "message_id", "session_id", "time_created", "time_updated", "data"]}
VERSION = r"^1\.[0-9]+\.[0-9]+$"
FIELDS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "reported_total_tokens", "derived_total_tokens"]


def schema_gate(session: DataFrame, message: DataFrame, part: DataFrame) -> None:
    """A5: raises unless all columns are there and every session's version is supported."""
    for name, table in (("session", session), ("message", message), ("part", part)):
        if lacking := set(NEEDED[name]) - set(table.columns):
            raise ValueError(f"unsupported OpenCode schema: {name} lacks {sorted(lacking)}")
    if session.where(~F.coalesce(F.col("version").rlike(VERSION), F.lit(False))).limit(1).count():
        raise ValueError("unsupported OpenCode schema: version")


#: What is read from the JSON of a step or a message. It is cast whole, so that each text is parsed once.
SHAPE = "struct<tokens: struct<input: variant, output: variant, reasoning: variant, total: variant, cache: struct<read: variant, write: variant>>, time: struct<completed: variant>, cost: variant>"


def _read(rows: DataFrame, data: str) -> DataFrame:
    """rows with `_d`, the SHAPE of a column of JSON, in place of it."""
    return rows.withColumn("_d", F.try_variant_get(F.try_parse_json(data), "$", SHAPE)).drop(data)


def _usage() -> list[Column]:
    """What `_d` says of tokens and cost; counts that it lacks are 0."""
    zero = lambda p: F.coalesce(whole(F.col(f"_d.tokens.{p}")), F.lit(0).cast("long"))
    cost = F.try_variant_get("_d.cost", "$", "decimal(38,29)")
    said = {"input_tokens": zero("input"), "visible": zero("output"), "reasoning_tokens": zero("reasoning"), "cache_read_tokens": zero("cache.read"), "cache_write_tokens": zero("cache.write"), "reported_total_tokens": whole(F.col("_d.tokens.total"))}
    return [*[c.alias(n) for n, c in said.items()], F.when(cost >= 0, money_to_nanos(cost)).alias("total_cost_nanos")]


def observations(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """One row for each step-finish part of an assistant message, and one for each assistant message without any.

    Messages and steps are parsed once each and meet in one join; a message that no step meets stands for itself.
    """
    schema_gate(session, message, part)
    s = session.select(F.col("id").alias("session_id"), F.col("agent").alias("s_agent"))
    named = F.json_tuple("mdata", "role", "providerID", "modelID", "agent").alias("_role", "provider", "model", "agent")
    m = message.select(F.col("id").alias("message_id"), "session_id", "time_updated", F.col("data").alias("mdata")).select("*", named).where("_role = 'assistant'")
    done = F.coalesce(whole(F.col("_d.time.completed")), F.when(F.col("time_updated") >= 0, F.col("time_updated")))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    m = _read(m, "mdata").select(
        "message_id", "session_id", *[text(c).alias(c) for c in ("provider", "model", "agent")], (F.nullif(done, F.lit(0).cast("long")) * 1_000_000).alias("completed_at_ns"),
        F.struct(F.col("message_id").alias("id"), F.lit("message").alias("kind"), *_usage()).alias("_own"),
    ).join(s, "session_id").withColumn("agent", F.coalesce("agent", "s_agent")).drop("s_agent")
    steps = _read(part.where(F.get_json_object("data", "$.type") == "step-finish").select("id", "message_id", "data"), "data")
    steps = steps.select("message_id", F.struct("id", F.lit("part").alias("kind"), *_usage()).alias("_step"))
    out = m.join(steps, "message_id", "left").withColumn("_u", F.coalesce("_step", "_own")).drop("_step", "_own").select("*", "_u.*").drop("_u")
    out = out.withColumn("output_tokens", F.col("visible") + F.col("reasoning_tokens")).withColumn("derived_total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    key = F.sha2(F.to_json(F.struct("agent", "completed_at_ns", "id", "kind", "message_id", "model", "provider", "session_id", *FIELDS, "total_cost_nanos")), 256)
    return out.withColumns({"event_key": F.concat_ws(":", F.lit("opencode"), "kind", "id"), "observation_key": F.concat_ws(":", F.lit("opencode"), "kind", "id", key)}).drop("visible")


def sessions(session: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions, and runs of those that have a parent; milliseconds become nanoseconds and 0 becomes null."""
    ns = lambda c: (F.nullif(c, F.lit(0).cast("long")) * 1_000_000)
    s = session.select(F.lit("opencode").alias("source"), F.col("id").alias("source_session_id"), F.col("parent_id").alias("parent_session_id"), F.col("version").alias("harness_version"), ns("time_created").alias("started_at_ns"), ns("time_updated").alias("updated_at_ns"))
    runs = s.where("parent_session_id IS NOT NULL").select("source", "source_session_id", F.col("source_session_id").alias("source_run_id"), F.col("parent_session_id").alias("parent_run_id"), F.lit("child").alias("role"), "started_at_ns")
    return s, runs


def events(retained: DataFrame, order: list[str]) -> DataFrame:
    """Events of all retained observations: revisions fold by dominance, the larger cost and first date stay, and of a message's parts and its fallback the dominating side counts.

    Observations are dealt and sorted by event once, events by message once.
    """
    rows = reconcile.folded_revisions(retained, ["event_key"], order, "derived_total_tokens", [f for f in FIELDS if f != "derived_total_tokens"], "total_cost_nanos", "completed_at_ns")
    own = Window.partitionBy("message_id")
    part, sums = F.col("kind") == "part", [f"_p_{f}" for f in FIELDS]
    sided = rows.withColumns({f"_p_{f}": F.sum(F.when(part, F.col(f))).over(own) for f in FIELDS} | {"_parts": F.count(F.when(part, 1)).over(own), "_own": F.max(F.when(~part, F.struct(*FIELDS))).over(own)})
    choice = reconcile.side([F.col(c) for c in sums], [F.col(f"_own.{f}") for f in FIELDS], F.col("_parts") > 0, F.col("_own").isNotNull())
    status = F.when(part == (choice == "parts"), "canonical").otherwise("excluded")
    return sided.select(F.lit("opencode").alias("source"), "event_key", F.lit("model_call").alias("granularity"), status.alias("status"), "session_id", "provider", "model", F.col("agent").alias("effort"), *FIELDS, "total_cost_nanos", "completed_at_ns", F.col("message_id").alias("evidence_key"))
