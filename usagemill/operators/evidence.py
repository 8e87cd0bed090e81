"""Links between observations and events, stale evidence, and where subagent runs belong. All are equi-, semi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagemill.operators import lineage, reconcile
from usagemill.sources.lines import latest_generation


def resolved_links(links: DataFrame, observations: DataFrame, events: DataFrame, observation: str = "observation_key", event: str = "event_key") -> tuple[DataFrame, DataFrame]:
    """(links whose ends both exist, dangling ones). A commit with a dangling link has to fail."""
    o, e = observations.select(observation).distinct().withColumn("_o", F.lit(True)), events.select(event).distinct().withColumn("_e", F.lit(True))
    joined = links.join(o, observation, "left").join(e, event, "left")
    fine = F.coalesce(F.col("_o") & F.col("_e"), F.lit(False))
    return joined.where(fine).drop("_o", "_e"), joined.where(~fine).drop("_o", "_e")


def stale_events(events: DataFrame, links: DataFrame, observations: DataFrame, live: str = "live", observation: str = "observation_key", event: str = "event_key") -> DataFrame:
    """C11: keys of counted events for which no live observation speaks."""
    alive = links.join(observations.where(F.col(live)).select(observation), observation, "left_semi").select(event)
    return events.where(F.col("status").isin("canonical", "provisional")).select(event).distinct().join(alive, event, "left_anti")


def stale_messages(observations: DataFrame, artifacts: DataFrame, counted: DataFrame, message: str = "message") -> DataFrame:
    """Messages of counted (message) that have no copy in the latest generation of a listed file, or one in a file whose latest generation is missing.

    observations: (message, path_hash, generation); artifacts: (path_hash, generation, is_missing), one row for each generation.
    """
    last = latest_generation(artifacts.select("path_hash", "generation", "is_missing"), ["path_hash"])
    own = observations.select(message, "path_hash", "generation").join(last, ["path_hash", "generation"]).groupBy(message).agg(F.max((~F.col("is_missing")).cast("int")).alias("_live"), F.max(F.col("is_missing").cast("int")).alias("_gone"))
    joined = counted.select(message).distinct().join(own, message, "left")
    return joined.where((F.coalesce("_live", F.lit(0)) == 0) | (F.coalesce("_gone", F.lit(0)) == 1)).select(message)


def session_of_runs(events: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with the session of their own or else their run, its parent and its root (sessions: source_session_id, parent_session_id)."""
    of_run = runs.where("source_run_id IS NOT NULL").select("source_run_id", F.col("source_session_id").alias("_of_run"))
    some, none = events.where("source_run_id IS NOT NULL"), events.where("source_run_id IS NULL")  # null keys would meet in one task
    joined = some.join(of_run, "source_run_id", "left").unionByName(none, allowMissingColumns=True).withColumn("session", F.coalesce("source_session_id", "_of_run")).drop("_of_run")
    tree = lineage.roots(sessions.select(F.col("source_session_id").alias("node"), F.col("parent_session_id").alias("parent"))).select(F.col("node").alias("session"), "root")
    about = sessions.select(F.col("source_session_id").alias("session"), F.col("parent_session_id").alias("parent")).join(tree, "session")
    return joined.where("session IS NOT NULL").join(about, "session", "left").unionByName(joined.where("session IS NULL"), allowMissingColumns=True)


def keys_with_status(events: DataFrame, key: str, status: str = "provisional") -> DataFrame:
    """Distinct keys that have an event of a status."""
    return events.where((F.col("status") == status) & F.col(key).isNotNull()).select(key).distinct()


def legacy_owners(events: DataFrame, links: DataFrame, observations: DataFrame, method: str, owner: str = "owner") -> DataFrame:
    """Owners of observations linked to counted events by a method, none of whose observations is linked by another one."""
    linked = links.join(events.where(F.col("status").isin("canonical", "provisional")).select("event_key"), "event_key", "left_semi").join(observations.select("observation_key", owner), "observation_key")
    own = linked.groupBy(owner).agg(F.min(F.col("method") == method).alias("_only"))
    return own.where("_only").select(owner)


def event_channels(links: DataFrame, observations: DataFrame) -> DataFrame:
    """(event_key, channel): through which channels an event was observed."""
    return links.join(observations.select("observation_key", "channel"), "observation_key").select("event_key", "channel").distinct()


def dated(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """C20: rows with `dated`: their own time, else the first known one of their key."""
    first = reconcile.first_known_time(rows, keys, at, order).withColumnRenamed(at, "_first")
    return rows.join(first, keys).withColumn("dated", F.coalesce(at, "_first")).drop("_first")


def metadata_changes(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The rows whose columns differ, null-safe, from the revision before, over all revisions of a key."""
    now = F.struct(*columns)
    before = F.lag(now).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_before", before).where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(now)).drop("_before")


def legacy_overlap(fallbacks: DataFrame, parts: DataFrame, legacy: DataFrame, message: str = "message_id", session: str = "session_id") -> DataFrame:
    """Fallbacks with `decision`: suppressed if the message has known parts, ambiguous if its session has parts of unknown messages, else kept."""
    known = parts.where(F.col(message).isNotNull()).select(message).distinct().withColumn("_known", F.lit(True))
    vague = legacy.where(F.col(message).isNull()).select(session).distinct().withColumn("_vague", F.lit(True))
    joined = fallbacks.join(known, message, "left").join(vague, session, "left")
    return joined.withColumn("decision", F.when(F.col("_known"), "suppressed").when(F.col("_vague"), "ambiguous").otherwise("kept")).drop("_known", "_vague")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Existing with the rows whose keys it hasn't; of rows that share keys, one."""
    fresh = rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def subagent_runs(snapshots: DataFrame, sessions: DataFrame, old: DataFrame) -> DataFrame:
    """(run_key, session, role, model, provider, effort, status, started_at_ns, completed_at_ns) of one selected snapshot for each run.

    snapshots: those columns but session, with session_id (the physical one) and root. A run stays in the session of its old run, else goes to its lineage root if that
    is a known session, else to the physical session. What the snapshot doesn't know is taken from the old run.
    """
    named = ["role", "model", "provider", "effort", "status", "started_at_ns", "completed_at_ns"]
    o = old.select("run_key", F.col("session").alias("_s"), *[F.col(c).alias(f"_{c}") for c in named])
    known = sessions.select(F.col("source_session_id").alias("root"), F.lit(True).alias("_known")).distinct()
    joined = snapshots.join(o, "run_key", "left").join(known, "root", "left")
    place = F.coalesce("_s", F.when(F.col("_known"), F.col("root")), "session_id")
    return joined.select("run_key", place.alias("session"), *[F.coalesce(c, f"_{c}").alias(c) for c in named])
