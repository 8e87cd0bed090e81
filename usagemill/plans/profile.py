"""Profile analytics over reporting rows with agent keys: window totals, rankings, calendars, streaks, awards and the public payload."""

from __future__ import annotations

from datetime import date, datetime, timedelta, tzinfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.models import creator, family
from usagemill.functions.tables import written
from usagemill.functions.tokens import SOURCES, display_model, event_total, in_window, local_day, window_bounds

ACTIVITY_DAYS = 364
# What an award takes, in catalogue order.
AWARDS = {"ten-billion": 10_000_000_000, "billion-day": 1_000_000_000, "fleet-commander": 250, "hot-streak": 14, "model-collector": 10, "all-systems-go": 4}
OTHER = "other models"


def measured(rows: DataFrame, tz: str) -> DataFrame:
    """The columns that the profile reads: source, model, creator, agent_key, occurred_at_ns, day, tokens."""
    return rows.select("source", F.col("resolved_model").alias("model"), creator(F.col("provider")).alias("creator"), "agent_key", "occurred_at_ns", local_day("occurred_at_ns", tz).alias("day"), event_total().alias("tokens"))


#: What one row of `condensed` adds up.
CELL = ["source", "model", "creator", "agent_key", "day"]


def condensed(m: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """One row for each of CELL, within the window and beyond it, as a written table: all profile frames can be derived from it.

    Measured rows are aggregated once, in a shuffle after partial sums; the rows that come out are about agents times days at most. Tokens
    of one event are never negative, so cells have tokens exactly if one of their rows has.
    """
    inside = F.coalesce(in_window(window), F.lit(False)).alias("inside")
    return written(m.groupBy(*CELL, inside).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("events"), F.min("occurred_at_ns").alias("occurred_at_ns")))


def totals(m: DataFrame, window: tuple[int, int] | None) -> DataFrame:
    """Tokens within the window and of all time; undated rows are in the latter only."""
    return m.agg(F.coalesce(F.sum(F.when(in_window(window), F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_time_tokens"))


def primary_provider(m: DataFrame, *keys: str) -> DataFrame:
    """(keys, model, creator): the creator with most of a model's tokens, ties to the first by name."""
    sums = m.where("tokens > 0 AND creator IS NOT NULL").groupBy(*keys, "model", "creator").agg(F.sum("tokens").alias("t"))
    return sums.groupBy(*keys, "model").agg(F.min(F.struct(-F.col("t"), "creator")).creator.alias("creator"))


def model_totals(m: DataFrame, *keys: str) -> DataFrame:
    """(keys, model, tokens, creator) of models with tokens."""
    sums = m.groupBy(*keys, "model").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return sums.join(primary_provider(m, *keys), [*keys, "model"], "left")


def harness_totals(m: DataFrame) -> DataFrame:
    """Tokens by source, where there are any."""
    return m.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def active(m: DataFrame) -> DataFrame:
    """Rows of agents that used tokens."""
    return m.where("agent_key IS NOT NULL AND tokens > 0")


def agent_count(m: DataFrame) -> DataFrame:
    """Agents with tokens."""
    return active(m).agg(F.countDistinct("agent_key").alias("agents"))


def agent_primary_model(m: DataFrame) -> DataFrame:
    """(agent_key, model): each agent's model with most tokens, ties to the first by name."""
    sums = active(m).groupBy("agent_key", "model").agg(F.sum("tokens").alias("t"))
    return sums.groupBy("agent_key").agg(F.min(F.struct(-F.col("t"), "model")).model.alias("model"))


def agents_by_model(m: DataFrame) -> DataFrame:
    """Agents by their primary model."""
    return agent_primary_model(m).groupBy("model").agg(F.count(F.lit(1)).alias("agents"))


def calendar(like: DataFrame, first: date, days: int) -> DataFrame:
    """(day), one row for each."""
    return like.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(first + timedelta(days=days - 1)))).alias("day"))


def daily_tokens(m: DataFrame, first: date, days: int) -> DataFrame:
    """(day, tokens, models) for each day; models as array of (model, tokens, creator), largest first."""
    inside = m.where(F.col("day").between(F.lit(first), F.lit(first + timedelta(days=days - 1))))
    total = inside.groupBy("day").agg(F.sum("tokens").alias("tokens"))
    entry = F.struct((-F.col("tokens")).alias("minus"), "model", "creator")
    lists = model_totals(inside, "day").groupBy("day").agg(F.sort_array(F.collect_list(entry)).alias("models"))
    joined = calendar(m, first, days).join(total, "day", "left").join(lists, "day", "left")
    ordered = F.transform(F.coalesce("models", F.array().cast("array<struct<minus:bigint,model:string,creator:string>>")), lambda x: F.struct(x.model.alias("model"), (-x.minus).alias("tokens"), x.creator.alias("creator")))
    return joined.select("day", F.coalesce("tokens", F.lit(0)).alias("tokens"), ordered.alias("models"))


def daily_agents(m: DataFrame, first: date, days: int) -> DataFrame:
    """(day, agents, models) for each day; an agent counts under its primary model of the whole window."""
    seen = active(m).where("day IS NOT NULL").select("day", "agent_key").distinct().join(agent_primary_model(m), "agent_key")
    by_model = seen.groupBy("day", "model").agg(F.count(F.lit(1)).alias("n"))
    lists = by_model.groupBy("day").agg(F.sum("n").alias("agents"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "model"))).alias("models"))
    ordered = F.transform(F.coalesce("models", F.array().cast("array<struct<minus:bigint,model:string>>")), lambda x: F.struct(x.model.alias("model"), (-x.minus).alias("agents")))
    return calendar(m, first, days).join(lists, "day", "left").select("day", F.coalesce("agents", F.lit(0)).alias("agents"), ordered.alias("models"))


def peak(m: DataFrame) -> DataFrame:
    """Largest day's tokens, models with tokens, first day with a row."""
    days = m.where("day IS NOT NULL").groupBy("day").agg(F.sum("tokens").alias("t")).agg(F.coalesce(F.greatest(F.max("t"), F.lit(0)), F.lit(0)).alias("peak_usage"))
    models = m.groupBy("model").agg(F.sum("tokens").alias("t")).where("t > 0").agg(F.count(F.lit(1)).alias("model_count"))
    first = m.agg(F.min("day").alias("first_tracked_day"))
    return days.crossJoin(models).crossJoin(first)  # one row each


def islands(m: DataFrame) -> DataFrame:
    """(island, day, place): runs of consecutive days with an active agent. There is one row for each day of the calendar at most."""
    days = active(m).where("day IS NOT NULL").select("day").distinct()
    numbered = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.orderBy("day"))))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy("island").orderBy("day")))


def longest_streak(m: DataFrame) -> DataFrame:
    return islands(m).agg(F.coalesce(F.max("place"), F.lit(0)).alias("longest_streak"))


def awards(m: DataFrame) -> DataFrame:
    """(key, metric_value, earned_on) of the awards earned over all rows; a day's value is that of the first day that qualifies."""
    used = m.where("tokens > 0")
    by_day = used.where("day IS NOT NULL").groupBy("day").agg(F.sum("tokens").alias("tokens"), F.countDistinct("agent_key").alias("agents"))
    row = lambda key, value, on=F.lit(None).cast("date"): (F.lit(key).alias("key"), value.cast("long").alias("metric_value"), on.alias("earned_on"))
    first = lambda key, column: by_day.where(F.col(column) >= AWARDS[key]).agg(F.min("day").alias("d"), F.min_by(column, "day").alias("v")).where("d IS NOT NULL").select(*row(key, F.col("v"), F.col("d")))
    out = m.agg(F.sum("tokens").alias("v")).where(F.col("v") >= AWARDS["ten-billion"]).select(*row("ten-billion", F.col("v")))
    streak = islands(m).where(F.col("place") >= AWARDS["hot-streak"]).agg(F.min("day").alias("d")).where("d IS NOT NULL").select(*row("hot-streak", F.lit(AWARDS["hot-streak"]), F.col("d")))
    models = used.agg(F.countDistinct("model").alias("v")).where(F.col("v") >= AWARDS["model-collector"]).select(*row("model-collector", F.col("v")))
    every = used.where(F.col("source").isin(SOURCES)).agg(F.countDistinct("source").alias("v")).where(F.col("v") >= AWARDS["all-systems-go"]).select(*row("all-systems-go", F.col("v")))
    for more in (first("billion-day", "tokens"), first("fleet-commander", "agents"), streak, models, every):
        out = out.unionByName(more)
    return out


def group_small(models: Column, total: Column, count: str) -> Column:
    """The entries of a day's models as (name, count), those under 5 % joined to one at the end."""
    small = lambda x: (total > 0) & (x[count] * 100 < total * 5)
    large = F.transform(F.filter(models, lambda x: ~small(x)), lambda x: F.struct(display_model(x.model).alias("name"), x[count].alias(count)))
    rest = F.aggregate(F.filter(models, small), F.lit(0).cast("long"), lambda a, x: a + x[count])
    return F.when(rest != 0, F.concat(large, F.array(F.struct(F.lit(OTHER).alias("name"), rest.alias(count))))).otherwise(large)


def activity_levels(days: DataFrame) -> DataFrame:
    """(day, level 1 to 4) of days with tokens, by three cuts among the sorted totals. There are ACTIVITY_DAYS rows at most."""
    ranked = days.where("tokens > 0").withColumns({"i": F.row_number().over(Window.orderBy("tokens", "day")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    cut = lambda k: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.expr(f"n * {k} div 4")), F.col("tokens"))).over(Window.partitionBy())
    cuts = ranked.withColumns({f"c{k}": cut(k) for k in (1, 2, 3)})
    return cuts.select("day", F.least(F.lit(4), 1 + sum(((F.col("tokens") >= F.col(f"c{k}")).cast("int") for k in (1, 2, 3)), F.lit(0))).alias("level"))


def activity(days: DataFrame, first_tracked: DataFrame) -> DataFrame:
    """days with state and level; first_tracked has one row with first_tracked_day."""
    tracked = F.col("first_tracked_day").isNotNull() & (F.col("day") >= F.col("first_tracked_day"))
    state = F.when(F.col("tokens") != 0, "active").when(tracked, "quiet").otherwise("untracked")
    joined = days.join(activity_levels(days), "day", "left").crossJoin(F.broadcast(first_tracked))
    return joined.select("day", "tokens", "models", state.alias("state"), F.coalesce("level", F.lit(0)).alias("level"))


def conservation_check(m: DataFrame, first: date, days: int) -> DataFrame:
    """Days on which the models don't add up to the total; no row."""
    positive = m.where("tokens >= 0")
    tokens = daily_tokens(positive, first, days).where(F.aggregate("models", F.lit(0).cast("long"), lambda a, x: a + x.tokens) != F.col("tokens")).select("day", F.lit("tokens").alias("what"))
    agents = daily_agents(positive, first, days).where(F.aggregate("models", F.lit(0).cast("long"), lambda a, x: a + x.agents) != F.col("agents")).select("day", F.lit("agents").alias("what"))
    return tokens.unionByName(agents)


def profile(rows: DataFrame, tz: tzinfo, tz_name: str, now: datetime, window_days: int) -> dict[str, DataFrame]:
    """All frames of a profile of reporting rows with agent keys."""
    window = window_bounds(window_days, tz, now)
    end = now.astimezone(tz).date()
    first = end - timedelta(days=window_days - 1)
    m = condensed(measured(rows, tz_name), window)
    recent = m.where("inside")
    days = daily_tokens(m, end - timedelta(days=ACTIVITY_DAYS - 1), ACTIVITY_DAYS)
    return {
        "totals": m.agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_time_tokens")),
        "models": model_totals(recent),
        "harnesses": harness_totals(recent),
        "agent_count": agent_count(recent),
        "agent_models": agents_by_model(recent),
        "recent_days": daily_agents(recent, first, window_days),
        "recent_token_days": daily_tokens(recent, first, window_days),
        "peak": peak(recent).drop("first_tracked_day"),
        "first_tracked_day": m.agg(F.min("day").alias("first_tracked_day")),
        "longest_streak": longest_streak(recent),
        "activity": activity(days, m.agg(F.min("day").alias("first_tracked_day"))),
        "awards": awards(m),
    }


def public_payload(frames: dict[str, DataFrame], window_days: int, window_end: date) -> DataFrame:
    """One row of JSON with the fixed keys of a public profile; numbers, no labels. Its inputs are of calendar size."""
    listed = lambda df, order, *fields: df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("x")))), lambda y: y.x).alias("list"))
    day = F.col("day").cast("string").alias("date")
    lists = {
        "activity": listed(frames["activity"], ["day"], day, "tokens", "state", "level", group_small(F.col("models"), F.col("tokens"), "tokens").alias("models")),
        "agents": listed(frames["recent_days"], ["day"], day, "agents", group_small(F.col("models"), F.col("agents"), "agents").alias("models")),
        "models": listed(frames["models"], [(-F.col("tokens")).alias("minus"), F.col("model").alias("by")], display_model(F.col("model")).alias("name"), "tokens", family(F.col("creator"), F.col("model")).alias("icon")),
        "harnesses": listed(frames["harnesses"], [(-F.col("tokens")).alias("minus"), F.col("source").alias("by")], F.col("source").alias("name"), "tokens"),
        "awards": listed(frames["awards"], [F.array_position(F.array(*[F.lit(k) for k in AWARDS]), F.col("key")).alias("minus")], "key", "metric_value", F.col("earned_on").cast("string").alias("earned_on")),
    }
    out = frames["totals"].crossJoin(frames["agent_count"].withColumnRenamed("agents", "agent_count")).crossJoin(frames["peak"]).crossJoin(frames["longest_streak"])  # one row each
    for name, df in lists.items():
        out = out.crossJoin(df.withColumnRenamed("list", name))
    start = window_end - timedelta(days=window_days - 1)
    body = F.struct(F.lit(start.isoformat()).alias("window_start"), F.lit(window_end.isoformat()).alias("window_end"), F.lit(window_days).alias("window_days"), "total_tokens", "all_time_tokens", "agent_count", "peak_usage", "longest_streak", "model_count", *lists)
    return out.select(F.to_json(body).alias("value"))
