"""Reports over a synced ledger: usage, exports, profiles, single events and their evidence, for all sources under one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill import entities, sync
from usagemill.functions.tokens import SOURCES
from usagemill.ledger import Ledger
from usagemill.operators import evidence, lineage
from usagemill.plans import profile, reporting

#: Sources whose events belong to the root of their session; Pi's belong to their run's session, Claude's to their own.
ROOTED = ["codex", "opencode"]


def entity(ledger: Ledger, name: str, version: int | None = None) -> DataFrame:
    """An entity's rows of all sources, under its schema; none for a ledger without any."""
    version = ledger.version() if version is None else version
    read = {"events": sync.events, "links": sync.links}.get(name, lambda held, source, at: held.read(f"{source}/{name}", at))
    found = [entities.conform(df, entities.SCHEMAS[name]) for source in SOURCES if (df := read(ledger, source, version)) is not None]
    empty = ledger.spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in entities.SCHEMAS[name].items()))
    return reduce(DataFrame.unionByName, found) if found else empty


def session_roots(sessions: DataFrame) -> DataFrame:
    """(source, source_session_id, root_session_id) of the sessions that have a parent, as far as their root is a known session."""
    key = lambda c: F.concat_ws("\0", "source", c)
    linked = sessions.where("parent_session_id IS NOT NULL AND source_session_id IS NOT NULL")
    roots = lineage.roots(linked.select(key("source_session_id").alias("node"), key("parent_session_id").alias("parent")))
    known = roots.join(sessions.select(key("source_session_id").alias("root")).distinct(), "root", "left_semi")
    part = lambda c, n: F.substring_index(c, "\0", n)
    return known.select(part("node", 1).alias("source"), part("node", -1).alias("source_session_id"), part("root", -1).alias("root_session_id"))


def placed_events(events: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with the session that they belong to: the root of their own, or for Pi their run's."""
    roots = session_roots(sessions).where(F.col("source").isin(ROOTED)).select("source", "source_session_id", "root_session_id")
    own = runs.where("source = 'pi'").select("source", "source_run_id", F.col("source_session_id").alias("_of_run"))
    joined = events.join(roots, ["source", "source_session_id"], "left").join(own, ["source", "source_run_id"], "left")
    return joined.withColumn("source_session_id", F.coalesce("root_session_id", "_of_run", "source_session_id")).select(*entities.EVENT)


def usage_rows(ledger: Ledger, agent_key: bool = False, version: int | None = None) -> DataFrame:
    """Reporting rows of all counted events of a ledger."""
    version = ledger.version() if version is None else version
    events, runs, sessions = (entity(ledger, n, version) for n in ("events", "runs", "sessions"))
    return reporting.reporting(placed_events(events, runs, sessions), runs, sessions, agent_key)


def stats(ledger: Ledger, group_by: str, tz: str, window: tuple[int, int] | None = None, version: int | None = None) -> DataFrame:
    """Usage of a ledger by source, model or day."""
    return reporting.usage_stats(usage_rows(ledger, version=version), group_by, tz, window)


def totals(ledger: Ledger, dimension: str | None = None, version: int | None = None) -> DataFrame:
    """Sums of a ledger's counted events by one of their own columns."""
    return reporting.totals_by(entity(ledger, "events", version), dimension)


def export(ledger: Ledger, tz: str, generated_at: str) -> DataFrame:
    """A14 of a ledger."""
    return reporting.export_payload(usage_rows(ledger), tz, generated_at)


def measured(ledger: Ledger, tz: str) -> DataFrame:
    """The rows that the profile's frames are made of."""
    return profile.measured(usage_rows(ledger, True), tz)


def event(ledger: Ledger, event_key: str, source: str | None = None) -> DataFrame:
    """One event of a ledger."""
    return reporting.event_lookup(entity(ledger, "events"), event_key, source)


def channels(ledger: Ledger) -> DataFrame:
    """(event_key, channel): where a ledger's events were observed; an observation's key says it."""
    links = entity(ledger, "links")
    return evidence.event_channels(links, links.select("observation_key", F.element_at(F.split("observation_key", ":"), 2).alias("channel")).distinct())


def open_issues(ledger: Ledger) -> DataFrame:
    """The issues that stand."""
    return entity(ledger, "issues").where("resolved IS NULL")
