"""Pi session trees: direct usage in four slots, subagent snapshots, state that carries forward, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.tables import written
from usagemill.functions.tokens import iso_to_ns, money_to_nanos
from usagemill.operators import lineage, reconcile
from usagemill.sources.lines import carried, corrupt_gate, exact, is_object, issue, strict_long, string_at

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "reasoning_tokens", "reported_total_tokens", "derived_total_tokens"]
COSTS = ["input_cost_nanos", "output_cost_nanos", "cache_read_cost_nanos", "cache_write_cost_nanos", "total_cost_nanos"]
# Statuses of a subagent that end it.
TERMINAL = ["completed", "failed", "aborted"]
STATUSES = [*TERMINAL, "running", "pending"]
_MONEY = "decimal(38,29)"


# Token fields of a usage object and the names under which it has them.
NEEDED = {"input_tokens": "input", "output_tokens": "output", "cache_read_tokens": "cacheRead", "cache_write_tokens": "cacheWrite"}
_MORE = {"cache_write_1h_tokens": "cacheWrite1h", "reasoning_tokens": "reasoning", "reported_total_tokens": "totalTokens"}
_PRICED = dict(zip(COSTS, ("input", "output", "cacheRead", "cacheWrite", "total"), strict=True))
#: What is read of most lines, by from_json in one pass: it takes a whole number for a long from a JSON integer only. Costs stay variants, whose kind counts.
_USAGE = f"struct<{', '.join(f'{n}: long' for n in (NEEDED | _MORE).values())}, cost: struct<{', '.join(f'{n}: variant' for n in _PRICED.values())}>>"
_SHAPE = f"struct<type: string, id: string, timestamp: string, message: struct<role: string, toolName: string, provider: string, api: string, model: string, responseModel: string, stopReason: string, usage: {_USAGE}>, usage: {_USAGE}>"
_DECIMALS = "^(BIGINT|DOUBLE|DECIMAL.*)$"


def _nanos(number: Column) -> Column:
    """Nanodollars of a number, with all its digits."""
    value = F.try_variant_get(number, "$", _MONEY)
    return F.when(F.schema_of_variant(number).rlike(_DECIMALS), F.when(value >= 0, money_to_nanos(value)))


def _direct() -> dict[str, Column]:
    """The tokens and costs of a line's usage object in `_d`; `ok` tells whether it has the four required tokens and no part exceeds its whole."""
    of = lambda n: F.when(F.col("type") == "message", F.col(f"_d.message.usage.{n}")).otherwise(F.col(f"_d.usage.{n}"))
    got = {f"_{k}": of(n) for k, n in (NEEDED | _MORE).items()} | {k: F.when(F.col(f"_{k}") >= 0, F.col(f"_{k}")) for k in (NEEDED | _MORE)}
    costs = {f"_{c}": of(f"cost.{n}") for c, n in _PRICED.items()} | {c: _nanos(F.col(f"_{c}")) for c in COSTS}
    total, hour = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"), F.col("cache_write_1h_tokens")
    ok = F.col("derived_total_tokens").isNotNull() & F.coalesce(F.col("reasoning_tokens") <= F.col("output_tokens"), F.lit(True)) & F.coalesce(hour <= F.col("cache_write_tokens"), F.lit(True))
    return got | costs | {"cache_write_5m_tokens": F.col("cache_write_tokens") - hour, "derived_total_tokens": total, "ok": ok}


def _object(v: Column, path: str) -> Column:
    return is_object(F.try_variant_get(v, path, "variant"))


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines (file, ordinal, line) to observations, sessions, samples and issues. Files without a session header are left out.

    Lines of direct usage, which are most, are read by one from_json into columns; lines of other kinds that say something, and those that are
    rejected, are kept as text and read from their variant.
    """
    v, slot, role = F.col("v"), F.col("slot"), F.col("_role")
    s = lambda p: F.nullif(string_at(v, p), F.lit(""))
    t = lambda p: exact(F.col(f"_d.{p}"), v, f"$.{p}")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    marker = (role == "toolResult") & (t("message.toolName") == "subagent") & F.try_variant_get(v, "$.message.details.records", "array<variant>").isNotNull()
    in_message = (F.col("type") == "message") & F.col("_d.message.usage").isNotNull()
    slots = F.when(in_message & (role == "assistant"), "assistant").when(in_message & F.coalesce(marker, F.lit(False)), "subagent_batch").when(in_message & (role == "toolResult"), "tool_result")
    slots = slots.when(F.col("type").isin("compaction", "branch_summary") & F.col("_d.usage").isNotNull(), F.col("type"))
    custom = F.col("type") == "custom"
    is_sub = custom & (string_at(v, "$.customType") == "orchestrator-subagent") | custom & (string_at(v, "$.name") == "orchestrator-subagent")
    names = {"provider": "provider", "api": "api", "model": "model", "response_model": "responseModel", "stop_reason": "stopReason"}
    texts = {f"_{k}": F.when(slot == "assistant", t(f"message.{n}")) for k, n in names.items()} | {k: some(f"_{k}") for k in names}
    is_error = F.when(slot == "tool_result", F.try_variant_get(v, "$.message.isError", "boolean"))
    failed = F.col("stop_reason").isin("error", "aborted")
    success = F.when(slot == "assistant", ~failed).when(slot == "tool_result", F.coalesce(~F.col("_is_error"), F.lit(False))).otherwise(F.lit(True))
    error = F.when((slot == "assistant") & failed, F.col("stop_reason")).when((slot == "tool_result") & F.coalesce(F.col("_is_error"), F.lit(False)), "tool_error")
    said = F.when(F.col("total_cost_nanos").isNotNull(), F.coalesce(*[F.try_variant_get(f"_d.{p}usage.cost.total", "$", "string") for p in ("message.", "")]))
    used = slot.isNotNull() & (slot != "subagent_batch")
    kept = F.coalesce(F.col("is_sub"), F.lit(False)) | F.coalesce(F.col("type").isin("session", "model_change", "thinking_level_change", "compaction") | (slot == "subagent_batch"), F.lit(False)) | F.coalesce(used & (F.col("entry").isNull() | ~F.col("ok")), F.lit(False))
    derived = {"_d": F.from_json("line", _SHAPE), "type": t("type"), "_at": t("timestamp"), "observed_at_ns": iso_to_ns(F.col("_at")), "_role": t("message.role"), "slot": slots, "is_sub": is_sub}
    derived |= {"_id": F.when(used, t("id")), "entry": some("_id")} | _direct() | texts | {"_is_error": is_error, "success": success, "error_category": error, "original_decimal": said, "line": F.when(kept, F.col("line"))}
    values = ["observed_at_ns", *names, "success", "error_category", *TOKENS, *COSTS, "original_decimal"]
    rows, issues = corrupt_gate(lines, "pi", derived, ["line", "type", "slot", "is_sub", "entry", "ok", *values])
    told = written(rows.where("line IS NOT NULL").select("file", "ordinal", "type", "slot", "is_sub", "entry", "ok", "observed_at_ns", "line")).withColumn("v", F.try_parse_json("line")).drop("line")
    first = written(told.where("ordinal = 0 AND type = 'session'").select("file", s("$.id").alias("session_id"), s("$.parentSession").alias("parent_session"), strict_long(v, "$.version").alias("schema_version"), s("$.cwd").alias("cwd"), F.nullif("observed_at_ns", F.lit(0).cast("long")).alias("started_at_ns")).where("session_id IS NOT NULL"))
    rows, told = (df.join(first.select("file", "session_id"), "file") for df in (rows, told))
    models = told.where("type = 'model_change'").select("file", "ordinal", F.struct(s("$.provider").alias("provider"), s("$.modelId").alias("model")).alias("_model"))
    levels = written(told.where("type = 'thinking_level_change'").select("file", "ordinal", s("$.thinkingLevel").alias("effort")))

    fine = rows.where(used & F.col("entry").isNotNull() & F.col("ok")).select("file", "ordinal", "session_id", "slot", "entry", *values)
    marked = levels.select("file").distinct()  # lines of other files aren't dealt out to look for a mark
    direct = carried(fine.join(marked, "file", "left_semi"), levels, "effort").unionByName(fine.join(marked, "file", "left_anti").withColumn("effort", F.lit(None).cast("string")))
    rejected = told.where(used & (F.col("entry").isNull() | ~F.col("ok")))
    sub = told.where("is_sub")
    parts = {k: strict_long(v, f"$.data.usage.{n}") for k, n in NEEDED.items()}
    total = parts["input_tokens"] + parts["output_tokens"] + parts["cache_read_tokens"] + parts["cache_write_tokens"]
    started, batch, agent, status = strict_long(v, "$.data.startedAt"), s("$.data.batchId"), s("$.data.id"), s("$.data.status")
    named = agent.isNotNull() & status.isNotNull() & started.isNotNull() & _object(v, "$.data.usage")
    sub = written(sub.withColumns({"named": named, "known": F.coalesce(status.isin(STATUSES), F.lit(False)), "total": total}))
    route = s("$.data.model")
    scoped = F.contains(route, F.lit("/"))
    subagents = sub.where("named AND known AND total IS NOT NULL").select(
        "file", "ordinal", "session_id", "observed_at_ns", batch.alias("batch_id"), agent.alias("agent_id"), started.alias("started_ms"), status.alias("status"), status.isin(TERMINAL).alias("terminal"), s("$.data.role").alias("role"), s("$.data.thinkingLevel").alias("effort"),
        F.when(scoped, F.substring_index(route, "/", 1)).alias("provider"), F.when(scoped, F.substr(route, F.instr(route, "/") + 1, F.length(route))).otherwise(route).alias("model"),
        (started * 1_000_000).alias("started_at_ns"), (strict_long(v, "$.data.finishedAt") * 1_000_000).alias("completed_at_ns"), *[c.alias(k) for k, c in parts.items()], F.col("total").alias("reported_total_tokens"), F.col("total").alias("derived_total_tokens"),
        *[_nanos(F.try_variant_get(v, f"$.data.usage.{n}", "variant")).alias(c) for c, n in zip(COSTS, ("costInput", "costOutput", "costCacheRead", "costCacheWrite", "cost"), strict=True)],
    )
    samples = told.where((slot == "compaction") & strict_long(v, "$.tokensBefore").isNotNull()).select(F.lit("pi").alias("source"), "file", "ordinal", "observed_at_ns", F.lit("tokens_before").alias("name"), F.lit("tokens").alias("unit"), strict_long(v, "$.tokensBefore").alias("value_integer"))
    seen = rows.groupBy("file").agg(F.max(F.nullif("observed_at_ns", F.lit(0).cast("long"))).alias("updated_at_ns"))
    model = models.groupBy("file").agg(F.max_by("_model", "ordinal").alias("_model"), F.min_by("_model.model", F.when(F.col("_model.model").isNotNull(), F.col("ordinal"))).alias("initial_model"))
    state = seen.join(model, "file", "left").join(levels.groupBy("file").agg(F.max_by("effort", "ordinal").alias("effort")), "file", "left")
    sessions = first.join(state, "file").select(F.lit("pi").alias("source"), "file", F.col("session_id").alias("source_session_id"), "parent_session", F.col("_model.provider").alias("provider"), "initial_model", F.col("_model.model").alias("current_model"), F.col("effort").alias("reasoning_effort"), "started_at_ns", "updated_at_ns")
    found = issues.unionByName(issue(rejected.where("entry IS NULL"), "pi", "missing_usage_identity", "$.id")).unionByName(issue(rejected.where("entry IS NOT NULL AND NOT ok"), "pi", "invalid_usage", "$.message.usage"))
    found = found.unionByName(issue(sub.where("NOT named OR NOT known"), "pi", "invalid_subagent")).unionByName(issue(sub.where("named AND known AND total IS NULL"), "pi", "invalid_subagent_usage"))
    return {"direct": direct, "subagents": subagents, "sessions": sessions, "samples": samples, "batches": told.where("slot = 'subagent_batch'").select("file", "ordinal", s("$.message.toolCallId").alias("client_id")), "issues": found}


def lineage_roots(sessions: DataFrame) -> DataFrame:
    """C4: (source_session_id, root) along parentSession, which names a file or a session; a walk that meets a cycle ends at the node it met."""
    files = sessions.select(F.col("file").alias("parent_session"), F.col("source_session_id").alias("parent"))
    ends = sessions.join(files, sessions["parent_session"] == files["parent_session"], "left")
    nodes = ends.select(F.col("source_session_id").alias("node"), F.coalesce("parent", sessions["parent_session"]).alias("parent"))
    return lineage.roots(nodes, stop_before_seen=False).select(F.col("node").alias("source_session_id"), "root")


def parents(sessions: DataFrame) -> DataFrame:
    """(source_session_id, parent_session_id): the parent of a session that names a session, or a file of one."""
    of_file = sessions.groupBy(F.col("file").alias("parent_session")).agg(F.min("source_session_id").alias("_named"))
    named = sessions.where("parent_session IS NOT NULL").select("source_session_id", "parent_session").join(of_file, "parent_session", "left")
    return named.groupBy("source_session_id").agg(F.min(F.coalesce("_named", "parent_session")).alias("parent_session_id"))


def _run_key() -> Column:
    return F.when(F.col("batch_id").isNotNull(), F.concat_ws(":", "batch_id", "agent_id")).otherwise(F.concat_ws(":", F.lit("legacy"), "root", F.col("started_ms").cast("string"), "agent_id"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, F.col("session_id") == F.col("source_session_id"))


def subagent_keys(subagents: DataFrame, roots: DataFrame) -> DataFrame:
    """Subagent snapshots with their root and run_key."""
    return _rooted(subagents, roots).drop("source_session_id").withColumn("run_key", _run_key())


def links(direct: DataFrame, subagents: DataFrame, roots: DataFrame) -> DataFrame:
    """Which observation stands for which event."""
    of = lambda rows, key, method: rows.select(F.col("root").alias("evidence_key"), "observation_key", key.alias("event_key"), F.lit(method).alias("method"))
    entries = of(_rooted(direct, roots), F.concat_ws(":", F.lit("pi"), "root", "entry", "slot"), "lineage_entry_slot")
    return entries.unionByName(of(subagent_keys(subagents, roots), F.concat_ws(":", F.lit("pi:subagent"), "run_key"), "subagent_run_key"))


def _folded(rows: DataFrame, order: list[str], rank: list[str], at: str, names: list[str], meta: list[str]) -> DataFrame:
    """The last row of each event with its fold (_s), the largest costs (_max_*) and their decimal text, what the row of the highest rank
    says (_m), the earliest start and the first positive time. Rows are dealt and sorted by event once; only events with several rows are folded."""
    upto = Window.partitionBy("event_key").orderBy(*order)
    every = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    largest = F.when(F.col("total_cost_nanos").isNotNull(), F.struct(-F.col("total_cost_nanos"), F.col("original_decimal").isNull(), *order))
    found = {"_place": F.row_number().over(upto), "_n": F.count(F.lit(1)).over(every), "_rows": F.collect_list(F.struct(*names)).over(every), "_start": F.min("started_at_ns").over(every)}
    found |= {f"_max_{c}": F.max(c).over(every) for c in COSTS} | {"_decimal": F.min_by("original_decimal", largest).over(every), "_m": F.max_by(F.struct(*meta), F.struct(*rank)).over(every)}
    found["_first"] = F.first(F.when(F.col(at) > 0, F.col(at)), ignorenulls=True).over(every)
    last = rows.withColumns(found).where("_place = _n")
    return last.withColumn("_s", F.when(F.col("_n") > 1, reconcile.fold(F.col("_rows"), names)).otherwise(F.struct(*names)))


def events(batch: dict[str, DataFrame], order: list[str] | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Direct events by lineage root, entry and slot, and one event for each subagent run; tokens by the dominance fold, costs with
    the decimal text of the row that first had the largest total, and a subagent's start and duration."""
    order = order or ["file", "ordinal"]
    roots = lineage_roots(batch["sessions"]) if roots is None else roots
    direct = _rooted(batch["direct"], roots).withColumns({"event_key": F.concat_ws(":", F.lit("pi"), "root", "entry", "slot"), "run_key": F.col("session_id")})
    sub = subagent_keys(batch["subagents"], roots)
    done = F.col("status") == "completed"
    sub = sub.withColumns({"event_key": F.concat_ws(":", F.lit("pi:subagent"), "run_key"), "success": F.when(F.col("terminal"), done), "error_category": F.when(F.col("status").isin("failed", "aborted"), F.col("status"))})
    out = []
    meta = ["session_id", "run_key", "provider", "model", "effort", "success", "error_category", "api", "response_model", "stop_reason"]
    fields = [t for t in TOKENS if t != "derived_total_tokens"]
    for rows, rank, at in ((direct, order, "observed_at_ns"), (sub, ["terminal", "observed_at_ns", *order], "completed_at_ns")):
        for c in (*TOKENS, *COSTS, "started_at_ns", "original_decimal", "api", "response_model", "stop_reason"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("long" if c in (*TOKENS, *COSTS, "started_at_ns") else "string"))
        folded = _folded(rows.withColumn("_total", F.coalesce("reported_total_tokens", "derived_total_tokens")), order, rank, at, ["_total", *fields, "derived_total_tokens"], [*meta, "root"])
        out.append(folded.select(F.lit("pi").alias("source"), "event_key", F.lit("model_call").alias("granularity"), F.lit("canonical").alias("status"), *[F.col(f"_m.{c}") for c in meta], F.col("_m.session_id").alias("source_session_id"), F.col("_m.run_key").alias("source_run_id"), *[F.col(f"_s.{c}") for c in TOKENS], *[F.col(f"_max_{c}").alias(c) for c in COSTS], F.col("_decimal").alias("original_decimal"), F.col("_start").alias("started_at_ns"), F.greatest(F.col("_first") - F.col("_start"), F.lit(0)).alias("duration_ns"), F.col("_first").alias("completed_at_ns"), F.col("_m.root").alias("evidence_key")))
    return out[0].unionByName(out[1])
