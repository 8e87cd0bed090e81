"""Claude transcripts: progressive snapshots of assistant messages, with iterations and advisors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.tables import written
from usagemill.functions.tokens import iso_to_ns
from usagemill.operators import reconcile
from usagemill.sources.lines import corrupt_gate, issue, strict_long, string_at

# Token fields and where a usage object has them.
FIELDS = {
    "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_write_tokens": "cache_creation_input_tokens",
    "cache_write_5m_tokens": "cache_creation.ephemeral_5m_input_tokens", "cache_write_1h_tokens": "cache_creation.ephemeral_1h_input_tokens",
}


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _tokens(v: Column, root: str) -> dict[str, Column]:
    return {f: strict_long(v, f"{root}.{p}") for f, p in FIELDS.items()}


def _valid(v: Column, root: str) -> Column:
    """An object with at least one token field, none of them present but invalid."""
    fine = F.coalesce(_kind(v, root).startswith("OBJECT"), F.lit(False)) & F.coalesce(*_tokens(v, root).values()).isNotNull()
    for f, p in FIELDS.items():
        fine = fine & (_kind(v, f"{root}.{p}").isNull() | _tokens(v, root)[f].isNotNull())
    creation = _kind(v, f"{root}.cache_creation")
    return fine & (creation.isNull() | creation.startswith("OBJECT") | (creation == "VOID"))


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines (file, ordinal, line) to observations (one a message snapshot, with iterations), sessions, runs and issues."""
    v = F.col("v")
    good, issues = corrupt_gate(lines, "claude", {"type": string_at(v, "$.type")})
    s = lambda p: F.nullif(string_at(v, p), F.lit(""))
    rows = good.where("type = 'assistant'").drop("line", "type")
    session = F.coalesce(s("$.sessionId"), s("$.session_id"))
    rows = rows.withColumns(
        {
            "is_message": F.coalesce(_kind(v, "$.message").startswith("OBJECT"), F.lit(False)),
            "is_usage": _valid(v, "$.message.usage"),
            "source_session_id": session,
            "message": F.coalesce(s("$.message.id"), F.concat_ws(":", F.when(session.isNotNull() & s("$.uuid").isNotNull(), session), F.when(session.isNotNull(), s("$.uuid")))),
            "observed_at_ns": iso_to_ns(string_at(v, "$.timestamp")),
            "iteration_kind": _kind(v, "$.message.usage.iterations"),
            "items": F.try_variant_get(v, "$.message.usage.iterations", "array<variant>"),
        }
    ).withColumn("message", F.nullif("message", F.lit("")))
    kinds = F.transform("items", lambda x: string_at(x, "$.type"))
    listed = F.col("iteration_kind").isNull() | (F.col("iteration_kind") == "VOID") | F.col("items").isNotNull()
    rows = rows.withColumns({"listed": listed, "items_valid": F.coalesce(F.forall("items", lambda x: _valid(x, "$")), F.lit(True)), "kinds_valid": F.coalesce(F.forall(kinds, lambda k: F.coalesce(k.isin("message", "advisor_message"), F.lit(False))), F.lit(True))})
    problem = (
        F.when(~F.col("is_message"), "invalid_message").when(~F.col("is_usage"), "invalid_usage").when(F.col("message").isNull(), "missing_message_identity")
        .when(~F.col("listed"), "invalid_iterations").when(~F.col("items_valid"), "invalid_iteration_usage").when(~F.col("kinds_valid"), "invalid_iteration_type")
    )
    rows = written(rows.withColumn("problem", problem))
    where = {"invalid_message": "$.message", "invalid_usage": "$.message.usage", "missing_message_identity": "$.message.id"} | dict.fromkeys(("invalid_iterations", "invalid_iteration_usage", "invalid_iteration_type"), "$.message.usage.iterations")
    for category, path in where.items():
        issues = issues.unionByName(issue(rows.where(F.col("problem") == category), "claude", category, path))
    iteration = lambda x, i: F.struct(i.cast("long").alias("idx"), (string_at(x, "$.type") == "advisor_message").alias("is_advisor"), string_at(x, "$.model").alias("model"), *[c.alias(f) for f, c in _tokens(x, "$").items()])
    run = F.coalesce(s("$.agentId"), F.col("source_session_id"))
    sidechain = F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))
    observations = rows.where("problem IS NULL").select(
        F.lit("claude").alias("source"), "file", "ordinal", "message", "source_session_id", run.alias("source_run_id"), "observed_at_ns", s("$.message.model").alias("model"), s("$.advisorModel").alias("advisor_model"),
        s("$.version").alias("harness_version"), s("$.effort").alias("effort"), s("$.message.usage.service_tier").alias("service_tier"), s("$.message.usage.speed").alias("speed"), s("$.message.usage.inference_geo").alias("inference_region"), s("$.message.stop_reason").alias("stop_reason"),
        F.when(sidechain, F.concat_ws(":", s("$.entrypoint"), F.lit("sidechain"))).otherwise(s("$.entrypoint")).alias("role"),
        strict_long(v, "$.message.usage.server_tool_use.web_search_requests").alias("web_search_count"), strict_long(v, "$.message.usage.server_tool_use.web_fetch_requests").alias("web_fetch_count"),
        *[c.alias(f) for f, c in _tokens(v, "$.message.usage").items()], F.transform("items", iteration).alias("iterations"),
    )
    known = observations.where("source_session_id IS NOT NULL")
    at = F.nullif("observed_at_ns", F.lit(0).cast("long")).alias("started_at_ns")
    sessions = known.select("source", "source_session_id", "harness_version", F.lit("anthropic").alias("provider"), "model", at, "file", "ordinal")
    parent = F.when(F.col("source_run_id") != F.col("source_session_id"), F.col("source_session_id")).alias("parent_run_id")
    runs = known.select("source", "source_session_id", "source_run_id", parent, "role", "model", at, "file", "ordinal")
    return {"observations": observations, "sessions": sessions, "runs": runs, "issues": issues}


def events(observations: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, issues): maxima over all copies of a message, iterations checked against the outer tokens, residuals."""
    fields, order = list(FIELDS), order or ["file", "ordinal"]
    rows = observations.withColumn("at", F.struct(*order))
    items = rows.where("iterations IS NOT NULL").select("message", "at", "advisor_model", F.explode("iterations").alias("i")).select("message", "at", "i.idx", "i.is_advisor", F.coalesce("i.model", "advisor_model").alias("advisor_model"), *[f"i.{f}" for f in fields])
    state = reconcile.coherent_state(rows.select("message", "at", *fields), items.select("message", "at", "idx", "is_advisor", *fields), "message", "at", fields)
    outer, inner = state.where("idx IS NULL"), state.where("idx IS NOT NULL")
    advisor = items.where("is_advisor").groupBy("message", "idx").agg(F.max_by("advisor_model", "at").alias("advisor_model"))
    many = inner.select("message").distinct().withColumn("has_items", F.lit(True))
    split = outer.join(many, "message", "left")
    whole = split.where("has_items IS NULL").select("message", F.col("message").alias("suffix"), "is_advisor", F.lit("canonical").alias("status"), *fields, F.lit(None).cast("string").alias("advisor_model"), F.lit(True).alias("counts_web"))
    each = inner.join(advisor, ["message", "idx"], "left").select("message", F.concat(F.lit("iteration:"), F.col("idx").cast("string")).alias("suffix"), "is_advisor", reconcile.iteration_status().alias("status"), *fields, "advisor_model", (F.col("idx") == 0).alias("counts_web"))
    rest = reconcile.residual(split.where("has_items").select("message", *fields), inner, "message", fields)
    left = rest.where("has_residual").select("message", F.lit("residual").alias("suffix"), F.lit(False).alias("is_advisor"), F.lit("canonical").alias("status"), *fields, F.lit(None).cast("string").alias("advisor_model"), F.lit(False).alias("counts_web"))
    meta = rows.groupBy("message").agg(F.max_by(F.struct("model", "effort", "service_tier", "speed", "inference_region", "stop_reason", "source_session_id", "source_run_id", "web_search_count", "web_fetch_count"), "at").alias("m"), F.min_by("observed_at_ns", F.when(F.col("observed_at_ns") > 0, F.col("at"))).alias("completed_at_ns"))
    joined = whole.unionByName(each).unionByName(left).join(meta, "message")
    web = lambda c: F.when(F.col("counts_web"), F.col(f"m.{c}")).alias(c)
    key = F.concat(F.lit("claude:"), "message", F.when(F.col("suffix") == F.col("message"), F.lit("")).otherwise(F.concat(F.lit(":"), "suffix")))
    out = joined.select(
        F.lit("claude").alias("source"), key.alias("event_key"), F.lit("model_call").alias("granularity"), "status", F.lit("anthropic").alias("provider"), F.when(F.col("is_advisor"), F.col("advisor_model")).otherwise(F.col("m.model")).alias("model"),
        *fields, *[f"m.{c}" for c in ("effort", "service_tier", "speed", "inference_region", "stop_reason", "source_session_id", "source_run_id")], web("web_search_count"), web("web_fetch_count"), "completed_at_ns", F.col("message").alias("evidence_key"),
    )
    problems = inner.where("conflict").select("message").distinct().select(F.lit("claude").alias("source"), F.lit("iteration_conflict").alias("category"), F.col("message").alias("identifier"))
    return out, problems
