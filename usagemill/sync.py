"""Syncs: from log files or tables to evidence, recomputed events and one commit; rebuilds from retained evidence.

A sync lists its source, opens the files that changed, appends what is new as evidence keyed by source, artifact, generation and ordinal,
derives the keys that this touches, recomputes their events and links from the evidence in these keys' buckets, merges sessions and runs, opens and
resolves issues, and commits with counts. Vanished, truncated and replaced files never remove usage. A sync without changes commits nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill import entities
from usagemill.functions.tables import scratch, written
from usagemill.ledger import Batch, Keyed, Ledger, dangling, merge_events
from usagemill.operators import evidence as rules
from usagemill.operators import lineage, reconcile
from usagemill.sources import claude, codex, lines, opencode, pi
from usagemill.sources.tables import Snapshot

def _leaving_no_tables(job):
    """A job (spark, ...) in a `scratch` folder: what it commits and the row of STATS that it returns don't lie there."""

    @wraps(job)
    def run(spark, *args, **kwargs):
        with scratch(spark):
            return job(spark, *args, **kwargs)

    return run


STATS = "source string, files_read long, lines_read long, observations long, inserted long, updated long, version long"
Frames = dict[str, DataFrame]
ORDER = ["sync", "artifact", "ordinal"]


@dataclass(frozen=True)
class Adapter:
    """What a source of line-oriented logs brings.

    evidence: the parsed frames that are kept, with the column that they are dealt by; whole: those of which a recompute needs all rows.
    touched(fresh, evidence) gives the keys (evidence_key) to recompute, within(keys, evidence) what evidence is dealt by for them (dealt),
    events(evidence, keys) their events, as a table, and what they raise as issues (scope, category, identifier), those of all keys for null, links(evidence, keys)
    which observation stands for which event, and rows(fresh, old runs) the sessions, runs and samples that new evidence says.
    """

    parse: Callable[[DataFrame], Frames]
    evidence: dict[str, str]
    touched: Callable[[Frames, Frames], DataFrame]
    events: Callable[[Frames, DataFrame | None], tuple[DataFrame, DataFrame | None]]
    links: Callable[[Frames, DataFrame | None], DataFrame]
    rows: Callable[[Frames, Frames, DataFrame | None], Frames]
    within: Callable[[DataFrame, Frames], DataFrame] = lambda keys, evidence: keys.select(F.col("evidence_key").alias("dealt"))
    whole: tuple[str, ...] = field(default=())


def _only(rows: DataFrame, column: str, keys: DataFrame | None) -> DataFrame:
    return rows if keys is None else rows.join(keys.select(F.col("evidence_key").alias(column)), column, "left_semi")


def _by_column(column: str):
    return lambda fresh, evidence: fresh["observations"].select(F.col(column).alias("evidence_key")).distinct()


# ---- sources


def _codex_events(evidence: Frames, keys: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Copies of a row that disagree raise an issue."""
    evidence["numbered"] = written(codex.numbered(_only(evidence["observations"], "owner", keys), "artifact"))  # links need it too
    found = written(codex.events_of(evidence["numbered"], "artifact").withColumn("source_run_id", F.col("source_session_id")))
    return found, found.where("conflict").select(F.col("evidence_key").alias("scope"), F.lit("conflicting_context").alias("category"), F.col("event_key").alias("identifier"))


def _codex_rows(fresh: Frames, evidence: Frames, runs: DataFrame | None) -> Frames:
    named = fresh["sessions"]
    return {
        "sessions": named.withColumns({"initial_model": F.col("model"), "current_model": F.col("model"), "updated_at_ns": F.col("started_at_ns")}),
        "runs": named.select("source", "source_session_id", F.col("source_session_id").alias("source_run_id"), F.lit("session").alias("role"), "model", "started_at_ns", *ORDER),
    }


def _claude_events(evidence: Frames, keys: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    found, problems = claude.events(_only(evidence["observations"], "message", keys), ["artifact", "ordinal"])
    return written(found), problems.select(F.col("identifier").alias("scope"), "category", "identifier")


def _claude_links(evidence: Frames, keys: DataFrame | None) -> DataFrame:
    rows = _only(evidence["observations"], "message", keys).select(F.col("message").alias("evidence_key"), "observation_key")
    return rows.join(evidence["events"].select("evidence_key", "event_key"), "evidence_key").withColumn("method", F.lit("message_id"))


def _claude_rows(fresh: Frames, evidence: Frames, runs: DataFrame | None) -> Frames:
    return {"sessions": fresh["sessions"].withColumns({"initial_model": F.col("model"), "current_model": F.col("model"), "updated_at_ns": F.col("started_at_ns")}), "runs": fresh["runs"]}


def _pi_roots(sessions: DataFrame) -> DataFrame:
    latest = reconcile.replace_upsert(sessions.withColumn("_at", F.struct("artifact", "ordinal")), ["file", "source_session_id"], ["parent_session"], "_at")
    return written(pi.lineage_roots(latest))


def _pi_parents(sessions: DataFrame) -> DataFrame:
    latest = reconcile.replace_upsert(sessions.withColumn("_at", F.struct("artifact", "ordinal")), ["file", "source_session_id"], ["parent_session"], "_at")
    return latest.groupBy("source_session_id").agg(F.min(F.struct("file", "parent_session")).alias("p")).select("source_session_id", "p.parent_session")


def _pi_touched(fresh: Frames, evidence: Frames) -> DataFrame:
    """Roots of new rows, roots of sessions whose root changed, and what either was before. Roots are worked out anew only if a session or a parent is new."""
    seen = fresh["direct"].select("session_id").unionByName(fresh["subagents"].select("session_id")).distinct().withColumnRenamed("session_id", "source_session_id").withColumn("_new", F.lit(True))
    after = evidence["roots"] = _pi_roots(evidence["sessions"])
    old = evidence["sessions"].join(fresh["sessions"].select("observation_key"), "observation_key", "left_anti")
    changed = _pi_parents(evidence["sessions"]).withColumnRenamed("parent_session", "_now").join(_pi_parents(old), "source_session_id", "left")
    moved = changed.where(~F.col("_now").eqNullSafe(F.col("parent_session"))).limit(1).count()
    before = (_pi_roots(old) if moved else after).select("source_session_id", F.col("root").alias("_was"))
    joined = after.join(before, "source_session_id", "left").join(seen, "source_session_id", "left").where(F.col("_new") | ~F.col("root").eqNullSafe(F.col("_was")))
    return joined.select(F.explode(F.array_compact(F.array("root", "_was"))).alias("evidence_key")).distinct()


def _pi_rooted(evidence: Frames) -> DataFrame:
    if "roots" not in evidence:
        evidence["roots"] = _pi_roots(evidence["sessions"])
    return evidence["roots"]


def _pi_events(evidence: Frames, keys: DataFrame | None) -> tuple[DataFrame, None]:
    return written(pi.events({n: evidence[n] for n in ("direct", "subagents", "sessions")}, ["artifact", "ordinal"], _only(_pi_rooted(evidence), "root", keys))), None


def _pi_links(evidence: Frames, keys: DataFrame | None) -> DataFrame:
    return pi.links(evidence["direct"], evidence["subagents"], _only(_pi_rooted(evidence), "root", keys))


def _pi_rows(fresh: Frames, evidence: Frames, runs: DataFrame | None) -> Frames:
    """Sessions and their runs, and a run for each subagent: in the session of its old run, else its lineage root if that is known, else its own."""
    sessions = fresh["sessions"]
    own = sessions.select("source", "source_session_id", F.col("source_session_id").alias("source_run_id"), F.lit("session").alias("role"), F.col("current_model").alias("model"), "provider", F.col("reasoning_effort").alias("effort"), "started_at_ns", *ORDER)
    snapshots = pi.subagent_keys(fresh["subagents"], _pi_rooted(evidence))
    columns = ["role", "model", "provider", "effort", "status", "started_at_ns", "completed_at_ns"]
    last = snapshots.groupBy("run_key").agg(F.max_by(F.struct("session_id", "root", *columns, *ORDER), F.struct("terminal", "observed_at_ns", *ORDER)).alias("r")).select("run_key", "r.*")
    old = (runs if runs is not None else own.where("false")).select(F.col("source_run_id").alias("run_key"), F.col("source_session_id").alias("session"), *[(F.col(c) if runs is not None or c in own.columns else F.lit(None)).cast(entities.RUN[c]).alias(c) for c in columns])
    placed = rules.subagent_runs(last, evidence["sessions"], old).join(last.select("run_key", "root", *ORDER), "run_key")
    found = placed.select(F.lit("pi").alias("source"), F.col("run_key").alias("source_run_id"), F.col("session").alias("source_session_id"), F.col("root").alias("parent_run_id"), *columns, *ORDER)
    parents = pi.parents(evidence["sessions"])
    kind = entities.RUN | {"sync": "long", "artifact": "string", "ordinal": "long"}
    return {"sessions": sessions.join(parents, "source_session_id", "left"), "runs": entities.conform(own, kind).unionByName(entities.conform(found, kind))}


def _pi_within(keys: DataFrame, evidence: Frames) -> DataFrame:
    return _only(_pi_rooted(evidence), "root", keys).select(F.col("source_session_id").alias("dealt"))


ADAPTERS = {
    "codex": Adapter(codex.parse, {"observations": "owner", "sessions": "source_session_id"}, _by_column("owner"), _codex_events, lambda e, keys: codex.links(e["numbered"]), _codex_rows),
    "claude": Adapter(claude.parse, {"observations": "message", "sessions": "source_session_id", "runs": "source_session_id"}, _by_column("message"), _claude_events, _claude_links, _claude_rows),
    "pi": Adapter(
        lambda rows: {k: v.withColumn("ordinal", F.lit(0).cast("long")) if k == "sessions" else v for k, v in pi.parse(rows).items()},
        {"direct": "session_id", "subagents": "session_id", "sessions": "source_session_id", "samples": "file"}, _pi_touched, _pi_events, _pi_links, _pi_rows, _pi_within, ("sessions",),
    ),
}


# ---- what all syncs share


def _placed(rows: DataFrame, source: str, files: DataFrame, version: int) -> DataFrame:
    """Rows of parsed frames beyond what was read before, with where they come from and their observation key."""
    known = rows.join(files.select("file", "path_hash", "generation", "artifact", "last_ordinal"), "file")
    key = F.concat_ws(":", F.lit(source), F.lit("disk"), "path_hash", F.col("generation").cast("string"), F.col("ordinal").cast("string"))
    return known.where(F.col("ordinal") > F.col("last_ordinal")).drop("last_ordinal").withColumns({"observation_key": key, "sync": F.lit(version).cast("long")})


def _kept(source: str, name: str) -> str:
    """Where a parsed frame is kept as evidence: beside the entity of its name, if there is one."""
    return f"evidence/{source}/{name}" if name in entities.SCHEMAS else f"{source}/{name}"


def _with(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
    return fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)


def _recomputed(ledger: Ledger, base: int, source: str, name: str, produced: DataFrame, keys: DataFrame | None) -> tuple[Keyed, tuple[int, int]]:
    """The touched buckets of events or links with the produced rows in place of those of keys, and how many were inserted and updated.

    Events are read several times, links once. Events of the keys that aren't produced any more stay, excluded; links go.
    """
    schema, key = entities.SCHEMAS[name], entities.KEYS[name]
    produced = entities.conform(produced.withColumn("source", F.lit(source)), schema)
    touched = ledger.buckets_of(f"{source}/{name}", keys, key, base) if keys is not None else None
    old = ledger.read(f"{source}/{name}", base, touched)
    every = touched if touched is not None else ledger.every_bucket(f"{source}/{name}", base)
    if old is None:
        return Keyed(produced, key, every), (produced.count() if name == "events" else 0, 0)
    old = entities.conform(old, schema)
    kept = lambda rows: rows if keys is None else old.join(keys, key, "left_anti").unionByName(rows)
    if name == "links":
        return Keyed(kept(produced), key, every), (0, 0)
    mine = old if keys is None else old.join(keys, key, "left_semi")
    now = written(_replaced(mine, produced, list(schema)))
    stats = now.agg(F.count(F.when(F.col("_change") == "inserted", 1)).alias("inserted"), F.count(F.when(F.col("_change") == "updated", 1)).alias("updated")).first()
    return Keyed(kept(now.drop("_change")), key, every), (stats.inserted, stats.updated)


def _replaced(old: DataFrame, produced: DataFrame, columns: list[str]) -> DataFrame:
    """Events after a recompute, and what it changed (_change: inserted, updated or null), by one join; those that aren't produced any more are excluded."""
    was = old.select("event_key", F.struct(*columns).alias("_old"))
    joined = produced.select("event_key", F.struct(*columns).alias("_new")).join(was, "event_key", "full")
    gone = F.struct(*[F.lit("excluded").alias(c) if c == "status" else F.col(f"_old.{c}").alias(c) for c in columns])
    now = joined.withColumn("_now", F.coalesce("_new", gone))
    change = F.when(F.col("_old").isNull(), "inserted").when(~F.col("_now").eqNullSafe(F.col("_old")), "updated")
    return now.select("_now.*", change.alias("_change"))


def merged_entity(ledger: Ledger, base: int, source: str, name: str, new: DataFrame, order: list[str]) -> Keyed:
    """The touched buckets of sessions, runs or turns with new rows merged into the old ones."""
    key = entities.KEYS[name]
    new = written(new)
    touched = ledger.buckets_of(f"{source}/{name}", new.where(F.col(key).isNotNull()), key, base)
    return Keyed(entities.last_known(ledger.read(f"{source}/{name}", base, touched), new, name, order), key, touched)


def _issues(ledger: Ledger, base: int, source: str, version: int, found: DataFrame | None, raised: DataFrame | None, keys: DataFrame | None) -> Keyed:
    """The touched scopes' issues. Those found in lines stay open; those that a recompute raises are resolved when it doesn't any more."""
    fields = {c: k for c, k in entities.ISSUE.items() if c not in ("opened", "resolved")}
    rows = [entities.conform(df.withColumn("source", F.lit(source)), fields) for df in (found, raised.withColumn("severity", F.lit("warning")) if raised is not None else None) if df is not None]
    every, name = written(reduce(DataFrame.unionByName, rows)), f"{source}/issues"
    if keys is None:
        held = ledger.read(name, base)
        keys = _with(held, every).where(~F.col("scope").startswith("artifact:")).select(F.col("scope").alias("evidence_key"))
    judged = keys.select(F.col("evidence_key").alias("scope")).distinct()
    touched = ledger.buckets_of(name, every.select("scope").unionByName(judged), "scope", base)
    old = ledger.read(name, base, touched)
    return Keyed(entities.issue_intervals(old, every, judged, version), "scope", touched)


def _stats(spark: SparkSession, *row: object) -> DataFrame:
    return spark.createDataFrame([row], STATS)


@_leaving_no_tables
def sync_lines(spark: SparkSession, ledger: Ledger, source: str, folders: list[str], stream: tuple[str, int] | None = None) -> DataFrame:
    """One row of STATS of a sync of a source's log files."""
    adapter, base = ADAPTERS[source], ledger.version()
    version = base + 1
    if ledger.has(stream, base):
        return _stats(spark, source, 0, 0, 0, 0, 0, base)
    prior = ledger.read(f"{source}/artifacts", base)
    prior = prior if prior is not None else spark.createDataFrame([], lines.MANIFEST)
    state = written(lines.next_manifest(prior, lines.listing(spark, folders), version))
    changed = [r.file for r in state.where("changed").select("file").toLocalIterator()]
    moved = state.join(prior.select("path_hash", F.col("is_missing").alias("_was")), "path_hash", "left").where("is_missing AND NOT _was").limit(1).count()
    if not changed and not moved:
        return _stats(spark, source, 0, 0, 0, 0, 0, base)
    if not changed:
        return _stats(spark, source, 0, 0, 0, 0, 0, ledger.commit(Batch(replace={f"{source}/artifacts": state.withColumn("changed", F.lit(False))}, stream=stream), base))
    # artifacts come in the order in which they were first seen, then by path and generation
    order = F.concat_ws("/", F.lpad(F.col("first_seen").cast("string"), 10, "0"), "file", F.lpad(F.col("generation").cast("string"), 6, "0"))
    files = written(state.where("changed").withColumn("artifact", order))
    rows = lines.numbered(spark, changed)
    parsed = adapter.parse(rows)
    fresh = {name: written(_placed(parsed[name], source, files, version)) for name in adapter.evidence}
    identifier = F.concat_ws(":", F.lit("artifact"), "path_hash", F.lit("generation"), F.col("generation").cast("string"), F.lit("ordinal"), F.col("ordinal").cast("string"))
    found = _placed(parsed["issues"], source, files, version).withColumns({"identifier": identifier, "scope": F.concat(F.lit("artifact:"), "path_hash")})
    last = rows.groupBy("file").agg(F.max("ordinal").alias("_last"))
    read = rows.join(files.select("file", "last_ordinal"), "file").where("ordinal > last_ordinal").count()
    manifest = state.join(last, "file", "left").withColumn("last_ordinal", F.coalesce(F.when(F.col("changed"), F.col("_last")), "last_ordinal")).drop("_last").withColumn("changed", F.lit(False))

    evidence = {name: _with(ledger.read(_kept(source, name), base), fresh[name]) for name in adapter.whole}
    keys = written(adapter.touched(fresh, evidence))
    within = written(adapter.within(keys, evidence))
    for name, dealt in adapter.evidence.items():
        if name not in evidence:
            evidence[name] = _with(ledger.read_keys(_kept(source, name), within, "dealt", dealt, base), fresh[name])
    produced, raised = adapter.events(evidence, keys)
    evidence["events"] = produced
    keyed = {}
    keyed[f"{source}/events"], (inserted, updated) = _recomputed(ledger, base, source, "events", produced, keys)
    keyed[f"{source}/links"], _ = _recomputed(ledger, base, source, "links", adapter.links(evidence, keys).withColumn("role", F.lit("primary")), keys)
    said = adapter.rows(fresh, evidence, ledger.read(f"{source}/runs", base))
    keyed |= {f"{source}/{n}": merged_entity(ledger, base, source, n, said[n].withColumn("source", F.lit(source)), ORDER) for n in ("sessions", "runs")}
    keyed[f"{source}/issues"] = _issues(ledger, base, source, version, found, raised, keys)
    keyed |= {_kept(source, n): Keyed(df, adapter.evidence[n]) for n, df in fresh.items()}
    batch = Batch(replace={f"{source}/artifacts": manifest}, keyed=keyed, references=[(fresh[n], "path_hash", state, "path_hash") for n in adapter.evidence], stream=stream)
    count = reduce(lambda n, df: n + df.count(), fresh.values(), 0)
    return _stats(spark, source, len(changed), read, count, inserted, updated, ledger.commit(batch, base))


@_leaving_no_tables
def sync_opencode(spark: SparkSession, ledger: Ledger, tables: Snapshot | tuple[DataFrame, DataFrame, DataFrame], stream: tuple[str, int] | None = None) -> DataFrame:
    """One row of STATS of a sync of the session, message and part tables. A Snapshot of them is checked again before the commit."""
    base, frames = ledger.version(), tables.frames if isinstance(tables, Snapshot) else tables
    version = base + 1
    if ledger.has(stream, base):
        return _stats(spark, "opencode", 0, 0, 0, 0, 0, base)
    found = opencode.observations(*frames).withColumn("sync", F.lit(version).cast("long"))
    # a key holds its message, by which the rows are dealt already
    fresh = written(ledger.fresh("opencode/observations", found, ["message_id", "observation_key"], base))
    sessions, runs = opencode.sessions(frames[0])
    place = {"sync": F.lit(version).cast("long"), "artifact": F.lit(""), "ordinal": F.lit(0).cast("long")}
    said = {"sessions": merged_entity(ledger, base, "opencode", "sessions", sessions.withColumns(place), ORDER), "runs": merged_entity(ledger, base, "opencode", "runs", runs.withColumns(place), ORDER)}
    keyed = {f"opencode/{n}": k for n, k in said.items() if _differs(ledger, base, f"opencode/{n}", n, k)}
    n = fresh.count()
    if not n and not keyed:
        return _stats(spark, "opencode", 0, 0, 0, 0, 0, base)
    inserted = updated = 0
    if n:
        keys = written(fresh.select(F.col("message_id").alias("evidence_key")).distinct())
        retained = _with(ledger.read_keys("opencode/observations", keys, "evidence_key", "message_id", base), fresh)
        keyed["opencode/events"], (inserted, updated) = _recomputed(ledger, base, "opencode", "events", written(_opencode_events(retained)), keys)
        keyed["opencode/links"], _ = _recomputed(ledger, base, "opencode", "links", _opencode_links(retained), keys)
        keyed["opencode/observations"] = Keyed(fresh, "message_id")
    if isinstance(tables, Snapshot):
        tables.check()
    return _stats(spark, "opencode", 0, 0, n, inserted, updated, ledger.commit(Batch(keyed=keyed, stream=stream), base))


def _opencode_events(retained: DataFrame) -> DataFrame:
    return opencode.events(retained, ["sync", "observation_key"]).withColumns({"source_session_id": F.col("session_id"), "source_run_id": F.col("session_id")})


def _opencode_links(retained: DataFrame) -> DataFrame:
    method = F.when(F.col("kind") == "part", "part_id").otherwise("message_id")
    return retained.select(F.col("message_id").alias("evidence_key"), "observation_key", "event_key", method.alias("method"), F.lit("primary").alias("role"))


def _differs(ledger: Ledger, base: int, entity: str, name: str, keyed: Keyed) -> bool:
    old, key = ledger.read(entity, base, keyed.touched), entities.KEYS[name]
    if old is None:
        return keyed.rows.limit(1).count() > 0
    columns = [c for c in entities.SCHEMAS[name] if c not in ("source", key)]
    stats = reconcile.write_stats(entities.conform(old, entities.SCHEMAS[name]), keyed.rows, ["source", key], columns).first()
    return bool(stats.inserted or stats.updated)


@_leaving_no_tables
def sync_codex_state(spark: SparkSession, ledger: Ledger, threads: DataFrame, edges: DataFrame | None = None, turns: DataFrame | None = None, check: Snapshot | None = None) -> DataFrame:
    """STATS of a sync of Codex's own tables: sessions and runs with the parents that spawn edges give, turns, and stubs of threads that only turns name.

    Events aren't recomputed: reports look their sessions' roots up. The rows are kept as evidence, so that a rebuild has them too.
    """
    base = ledger.version()
    place = {"sync": F.lit(base + 1).cast("long"), "artifact": F.lit("state"), "ordinal": F.lit(0).cast("long")}
    known = written(codex.threads(threads, edges))
    sessions = known.withColumns({"initial_model": F.col("model"), "current_model": F.col("model"), "reasoning_effort": F.col("effort"), "started_at_ns": F.col("created_at_ns")})
    runs = known.withColumns({"source_run_id": F.col("source_session_id"), "parent_run_id": F.col("parent_session_id"), "started_at_ns": F.col("created_at_ns")})
    frames = {"sessions": entities.conform(sessions, entities.SESSION), "runs": entities.conform(runs, entities.RUN)}
    if turns is not None:
        old = ledger.read("codex/sessions", base)
        found = codex.turns(turns, known.select("source_session_id") if old is None else known.select("source_session_id").unionByName(old.select("source_session_id")))
        frames = {n: df.unionByName(entities.conform(found[n], entities.SCHEMAS[n])) for n, df in frames.items()} | {"turns": entities.conform(found["turns"], entities.TURN)}
    frames = {n: written(df.withColumns(place)) for n, df in frames.items()}
    said = {n: merged_entity(ledger, base, "codex", n, df, ORDER) for n, df in frames.items()}
    changed = [n for n, k in said.items() if _differs(ledger, base, f"codex/{n}", n, k)]
    if not changed:
        return _stats(spark, "codex", 0, 0, 0, 0, 0, base)
    if check:
        check.check()
    keyed = {f"codex/{n}": said[n] for n in changed} | {f"evidence/codex/state_{n}": Keyed(frames[n], entities.KEYS[n]) for n in changed}
    return _stats(spark, "codex", 0, 0, sum(frames[n].count() for n in changed), 0, 0, ledger.commit(Batch(keyed=keyed), base))


def sync(spark: SparkSession, ledger: Ledger, source: str, inputs, stream: tuple[str, int] | None = None) -> DataFrame:
    """One source: folders of log files, or OpenCode's three tables. With stream (name, batch), a batch that has been committed commits nothing."""
    return sync_opencode(spark, ledger, inputs, stream) if source == "opencode" else sync_lines(spark, ledger, source, inputs, stream)


def sync_all(spark: SparkSession, ledger: Ledger, inputs: dict, strict: bool = False) -> dict[str, str]:
    """I4: syncs each source that has inputs; one that fails doesn't stop the others unless strict. Returns ok, skipped or the error for each."""
    out = {}
    for source, given in inputs.items():
        try:
            out[source] = "skipped" if given is None else (sync(spark, ledger, source, given), "ok")[1]
        except Exception as e:
            if strict:
                raise
            out[source] = f"error: {type(e).__name__}: {e}"[:300]
    return out


@_leaving_no_tables
def rebuild(spark: SparkSession, ledger: Ledger, sources: list[str]) -> DataFrame:
    """STATS of the sources' events, links, sessions, runs and derived issues worked out from all retained evidence, replaced in one commit.

    A source without evidence is left out. Merges are no evidence and stay as they are.
    """
    base = ledger.version()
    keyed, rows = {}, []
    for source in sources:
        names = ["observations"] if source == "opencode" else list(ADAPTERS[source].evidence)
        evidence = {n: df for n in names if (df := ledger.read(_kept(source, n), base)) is not None}
        if len(evidence) < len(names):
            continue
        if source == "opencode":
            produced, links, raised = written(_opencode_events(evidence["observations"])), _opencode_links(evidence["observations"]), None
        else:
            adapter = ADAPTERS[source]
            produced, raised = adapter.events(evidence, None)
            evidence["events"] = produced
            links, said = adapter.links(evidence, None).withColumn("role", F.lit("primary")), adapter.rows(evidence, evidence, None)
            for n in ("sessions", "runs"):
                state = ledger.read(f"evidence/{source}/state_{n}", base)
                new = entities.conform(said[n].withColumn("source", F.lit(source)), entities.SCHEMAS[n] | {"sync": "long", "artifact": "string", "ordinal": "long"})
                new = entities.last_known(None, new if state is None else new.unionByName(state), n, ORDER)
                everything = ledger.buckets_of(f"{source}/{n}", _with(ledger.read(f"{source}/{n}", base), new), entities.KEYS[n], base)
                keyed[f"{source}/{n}"] = Keyed(new, entities.KEYS[n], everything)
        keyed[f"{source}/events"], (inserted, updated) = _recomputed(ledger, base, source, "events", produced, None)
        keyed[f"{source}/links"], _ = _recomputed(ledger, base, source, "links", links, None)
        if raised is not None:
            keyed[f"{source}/issues"] = _issues(ledger, base, source, base + 1, None, raised, None)
        rows.append([source, 0, 0, 0, inserted, updated])
    version = ledger.commit(Batch(keyed=keyed), base) if keyed else base
    return spark.createDataFrame([(*r, version) for r in rows], STATS)


# ---- merges


def merge(ledger: Ledger, source: str, pairs: DataFrame) -> int:
    """Merges events (survivor, absorbed) for good: they outlast syncs and rebuilds, as `events` applies them to whatever is recomputed.

    Both have to be events of the source. Either may have been absorbed before; its survivor is taken then. Pairs that name one event twice
    are nothing; an event can't go to two survivors, nor in a circle, in one call. Returns the version.
    """
    base = ledger.version()
    found = ledger.read(f"{source}/events", base)
    named = pairs.select(F.explode(F.array("survivor", "absorbed")).alias("event_key"))
    if found is None or dangling(named, "event_key", found, "event_key").limit(1).count():
        raise ValueError("events to merge must exist and have the same source")
    old = ledger.read(f"{source}/merges", base)
    if old is not None:
        of = lineage.roots(old, "absorbed", "survivor").select("node", "root")
        for side in ("survivor", "absorbed"):
            pairs = pairs.join(of.withColumnsRenamed({"node": side, "root": "_root"}), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    new = written(pairs.where("survivor <> absorbed").select("survivor", "absorbed").distinct())
    if new.groupBy("absorbed").count().where("count > 1").limit(1).count():
        raise ValueError("an event can't be merged into two survivors at once")
    ends = lineage.roots(new, "absorbed", "survivor").select(F.col("root").alias("absorbed"))
    if ends.join(new, "absorbed", "left_semi").limit(1).count():
        raise ValueError("events can't be merged in a circle")
    return ledger.commit(Batch(append={f"{source}/merges": new}), base) if new.limit(1).count() else base


def events(ledger: Ledger, source: str, version: int | None = None) -> DataFrame | None:
    """A source's events as last committed, with their merges: absorbed events are excluded, their survivors know what they knew."""
    return _merged(ledger, source, version)[0]


def links(ledger: Ledger, source: str, version: int | None = None) -> DataFrame | None:
    """Which observations stand for which events; those of absorbed events stand for the survivors too."""
    return _merged(ledger, source, version)[1]


def _merged(ledger: Ledger, source: str, version: int | None) -> tuple[DataFrame | None, DataFrame | None]:
    version = ledger.version() if version is None else version
    found, held, pairs = (ledger.read(f"{source}/{n}", version) for n in ("events", "links", "merges"))
    if pairs is None:
        return found if found is None else entities.conform(found, entities.EVENT), held
    fill = [c for c in entities.EVENT if c not in ("source", "event_key", "evidence_key", "granularity", "status", "conflict")]
    out, copied = merge_events(found, held, pairs, fill)
    return out.select(*entities.EVENT, "merged_into"), copied
