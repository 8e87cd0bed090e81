"""From counted events to reporting rows and usage by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.tokens import TOKENS, UNKNOWN_DAY, UNKNOWN_MODEL, counted, event_total, in_window, local_day

#: E1's dimensions of totals and the columns they read.
DIMENSIONS = {
    "source": "source", "provider": "provider", "api": "api", "model": "model", "response_model": "response_model", "service_tier": "service_tier",
    "speed": "speed", "inference_region": "inference_region", "effort": "effort", "status": "status", "granularity": "granularity",
}
STATS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]


def _looked_up(left: DataFrame, right: DataFrame, key: str, of: str) -> DataFrame:
    """left with the columns of right by one equi-join, within the source if right has one. Rows without a key get one that nothing has, dealt over all tasks."""
    salt = F.concat(F.lit("\0"), F.xxhash64("source", "model", "started_at_ns", "completed_at_ns", "input_tokens", "output_tokens").cast("string"))
    same = F.coalesce(F.col(key), salt) == F.col(of)
    source = of.split("_")[0] + "_source"
    return left.join(right, same & (F.col("source") == F.col(source)) if source in right.columns else same, "left")


def reporting(events: DataFrame, runs: DataFrame, sessions: DataFrame, agent_key: bool = False, window: tuple[int, int] | None = None) -> DataFrame:
    """Counted events with what their run and session say; both joins are equi-joins on natural keys (with the source, if runs and sessions have one).

    With a window, only rows within it: an event's own time decides before the joins, which only those without one have to take for it.
    """
    e = events.where(counted())
    if window is not None:
        own = F.coalesce("started_at_ns", "completed_at_ns")
        e = e.where(F.coalesce((own >= window[0]) & (own < window[1]), F.lit(True)))
    r = runs.select([F.col(c).alias(f"r_{c}") for c in runs.columns])
    s = sessions.select([F.col(c).alias(f"s_{c}") for c in sessions.columns])
    joined = _looked_up(e, r, "source_run_id", "r_source_run_id").withColumn("_session", F.coalesce("source_session_id", "r_source_session_id"))
    joined = _looked_up(joined, s, "_session", "s_source_session_id")
    out = {
        "source": "source",
        "granularity": "granularity",
        "provider": F.coalesce("provider", "r_provider", "s_provider"),
        "resolved_model": F.coalesce("response_model", "model", "r_model", "s_current_model", "s_initial_model", F.lit(UNKNOWN_MODEL)),
        "requested_model": F.coalesce("model", "r_model", "s_current_model", "s_initial_model"),
        "occurred_at_ns": F.coalesce("started_at_ns", "completed_at_ns", "r_started_at_ns", "r_completed_at_ns", "s_started_at_ns", "s_updated_at_ns", "s_completed_at_ns"),
        **{c: c for c in TOKENS},
        "total_cost_nanos": "total_cost_nanos",
        "service_tier": F.coalesce("service_tier", "s_service_tier"),
        "speed": "speed",
        "inference_region": "inference_region",
    }
    if agent_key:
        child = F.col("r_source_run_id").isNotNull() & F.col("r_parent_run_id").isNotNull()
        out["agent_key"] = F.when(child, F.concat_ws(":", "source", F.lit("run"), "source_run_id")).when(F.col("_session").isNotNull(), F.concat_ws(":", "source", F.lit("session"), "_session"))
    return joined.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in out.items()]).where(in_window(window))


def totals_by(events: DataFrame, dimension: str | None = None) -> DataFrame:
    """Sums of all token columns and cost over counted events; null where no event has a value, none where there is no event."""
    if dimension is not None and dimension not in DIMENSIONS:
        raise ValueError(f"unsupported dimension: {dimension}")
    rows = events.where(counted())
    sums = [F.sum(c).alias(c) for c in [*TOKENS, "total_cost_nanos"]]
    if dimension:
        return rows.groupBy(F.col(DIMENSIONS[dimension]).alias("group_value")).agg(*sums)
    return rows.agg(F.count(F.lit(1)).alias("_n"), *sums).where("_n > 0").drop("_n").withColumn("group_value", F.lit(None).cast("string"))


def totals_by_all(events: DataFrame) -> DataFrame:
    """E1 for every dimension in one pass over the events: (dimension, group_value, sums)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("group_value")) for n, c in DIMENSIONS.items()])).alias("d")
    rows = events.where(counted()).select(each, *TOKENS, "total_cost_nanos")
    return rows.groupBy("d.dimension", "d.group_value").agg(*[F.sum(c).alias(c) for c in [*TOKENS, "total_cost_nanos"]])


def source_total(events: DataFrame, source: str) -> DataFrame:
    """One row of sums for a source, all null if it has no counted event."""
    rows = events.where(counted() & (F.col("source") == source))
    return rows.agg(*[F.sum(c).alias(c) for c in [*TOKENS, "total_cost_nanos"]]).withColumn("group_value", F.lit(source))


def _stats() -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS]
    return [F.count(F.lit(1)).alias("event_count"), *sums, F.coalesce(F.sum(event_total()), F.lit(0)).alias("total_tokens"), F.sum("total_cost_nanos").alias("cost_nanos"), F.count("total_cost_nanos").alias("cost_covered_events")]


def group_column(group_by: str, tz: str) -> Column:
    if group_by == "day":
        return F.coalesce(local_day("occurred_at_ns", tz).cast("string"), F.lit(UNKNOWN_DAY))
    return F.col({"source": "source", "model": "resolved_model"}[group_by])


def usage_stats(rows: DataFrame, group_by: str, tz: str, window: tuple[int, int] | None = None) -> DataFrame:
    """Usage by source, model or local day of reporting rows within a window."""
    if group_by not in ("source", "model", "day"):
        raise ValueError(f"unsupported group_by: {group_by}")
    return rows.where(in_window(window)).groupBy(group_column(group_by, tz).alias("usage_group")).agg(*_stats())


def usage_overall(rows: DataFrame) -> DataFrame:
    """One row for everything, of zeros if there is nothing."""
    return rows.agg(*_stats()).withColumn("usage_group", F.lit("all"))


def visible(stats: DataFrame) -> DataFrame:
    """Groups with tokens, largest first."""
    return stats.where("total_tokens > 0").orderBy(F.desc("total_tokens"), "usage_group")


def export_payload(rows: DataFrame, tz: str, generated_at: str) -> DataFrame:
    """One row of JSON with overall, by_source, by_model and by_day; only group, event_count and total_tokens of each."""
    kinds = {"by_source": "source", "by_model": "model", "by_day": "day"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), group_column(g, tz).alias("g")) for k, g in {**kinds}.items()], F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("g")))).alias("k")
    sums = rows.select(each, event_total().alias("t")).groupBy("k.kind", "k.g").agg(F.count(F.lit(1)).alias("event_count"), F.sum("t").alias("total_tokens"))
    entry = F.struct(F.col("g").alias("group"), "event_count", "total_tokens")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind)
    nothing = F.struct(F.lit("all").alias("group"), F.lit(0).cast("long").alias("event_count"), F.lit(0).cast("long").alias("total_tokens"))
    lists = sums.agg(of("overall"), *[of(k) for k in kinds])
    body = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(tz).alias("timezone"), F.coalesce(F.get("overall", F.lit(0)), nothing).alias("overall"), *kinds)
    return lists.select(F.to_json(body).alias("value"))


def event_lookup(events: DataFrame, event_key: str, source: str | None = None) -> DataFrame:
    """An event by key, and source if given."""
    found = events.where(F.col("event_key") == event_key)
    return (found.where(F.col("source") == source) if source else found).limit(1)
