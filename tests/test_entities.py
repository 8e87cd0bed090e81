"""A ledger's entities: reports over four synced sources, storage by bucket, issues, merges, snapshots, streams."""

import json

import pytest
from pyspark.sql import functions as F
from test_sources import assistant, count, meta, opencode_tables, pi_log, write
from test_sync import later, stats

from usagemill import entities, sync
from usagemill import ledger as storage
from usagemill.ledger import Batch, Conflict, Keyed, Ledger
from usagemill.plans import ledger_reports as reports
from usagemill.sources.tables import Changed, snapshot
from usagemill.streaming.ingest import sync_stream


def files(ledger):
    return sorted(str(p) for p in __import__("pathlib").Path(ledger.path).rglob("*.parquet"))


def append(path, *rows):
    with path.open("a") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    later(path)


@pytest.fixture
def logs(tmp_path):
    use = {"input": 10, "output": 5, "cacheRead": 3, "cacheWrite": 2, "totalTokens": 20, "cost": {"total": 0.5}}
    write(tmp_path / "codex", "a.jsonl", [meta("s"), count((100, 10), (100, 10)), count((120, 15), (20, 5), "2026-01-01T00:00:02Z")])
    write(tmp_path / "codex", "b.jsonl", [meta("t"), count((7, 1), (7, 1))])
    write(tmp_path / "claude", "c.jsonl", [assistant("m1", {"input_tokens": 2, "output_tokens": 1}), assistant("m1", {"input_tokens": 2, "output_tokens": 9}), assistant("m2", {"input_tokens": -1})])
    write(tmp_path / "pi", "kid.jsonl", [{"type": "session", "id": "kid", "parentSession": "root", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "message", "id": "k1", "timestamp": "2026-01-02T00:00:00Z", "message": {"role": "assistant", "model": "pm", "usage": use}}])
    return {s: [str(tmp_path / s)] for s in ("codex", "claude", "pi")}


def test_reports_over_four_sources(spark, tmp_path, logs):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    inputs = logs | {"opencode": opencode_tables(spark)}
    assert set(sync.sync_all(spark, ledger, inputs, strict=True).values()) == {"ok"}
    of = {r.usage_group: (r.event_count, r.input_tokens, r.output_tokens) for r in reports.stats(ledger, "source", "UTC").collect()}
    assert of["codex"] == (3, 127, 16) and of["claude"] == (1, 2, 9) and of["pi"] == (1, 10, 5) and "opencode" in of
    events = reports.entity(ledger, "events")
    assert events.columns == list(entities.EVENT) and events.count() == sum(sync.events(ledger, s).count() for s in inputs)
    days = {r.usage_group: r.event_count for r in reports.stats(ledger, "day", "UTC").collect()}
    assert days["2026-01-02"] >= 1 and sum(days.values()) == sum(n for n, _, _ in of.values())
    assert {r.usage_group for r in reports.stats(ledger, "model", "UTC").collect()} >= {"pm"}
    (row,) = reports.event(ledger, "pi:root:k1:assistant", "pi").collect()
    assert (row.source_session_id, row.source_run_id, row.total_cost_nanos) == ("kid", "kid", 500_000_000)
    # every link's ends are there, and every counted event has one
    links, observed = reports.entity(ledger, "links"), [ledger.read(n) for n in ("codex/observations", "claude/observations", "pi/direct", "opencode/observations")]
    known = {r.observation_key for df in observed for r in df.collect()}
    assert {r.observation_key for r in links.collect()} <= known and {r.event_key for r in links.collect()} == {r.event_key for r in events.collect()}
    assert {r.channel for r in reports.channels(ledger).where("event_key LIKE 'codex%'").collect()} == {"disk"}
    agents = {r.agent_key for r in reports.usage_rows(ledger, True).collect()}
    assert "codex:session:s" in agents and "pi:session:kid" in agents
    assert json.loads(reports.export(ledger, "UTC", "now").first().value)["overall"]["event_count"] == sum(n for n, _, _ in of.values())
    assert reports.measured(ledger, "UTC").count() == sum(n for n, _, _ in of.values())
    # a second sync of everything changes no file
    before, version = files(ledger), ledger.version()
    for source, given in inputs.items():
        assert stats(sync.sync(spark, ledger, source, given))["version"] == version
    assert files(ledger) == before
    # a rebuild from evidence gives the same entities
    was = {n: sorted(map(str, reports.entity(ledger, n).collect())) for n in ("events", "links", "sessions", "runs")}
    sync.rebuild(spark, ledger, list(inputs))
    assert {n: sorted(map(str, reports.entity(ledger, n).collect())) for n in was} == was


def test_sessions_keep_what_was_last_known(spark, tmp_path):
    ledger, folder = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "logs"
    header = meta("s")
    header["payload"] |= {"cli_version": "1", "model": "m1"}
    a = write(folder, "a.jsonl", [header])
    sync.sync(spark, ledger, "codex", [str(folder)])
    append(a, meta("s") | {"payload": {"id": "s", "model": "m2"}}, count((1, 1), (1, 1)))
    sync.sync(spark, ledger, "codex", [str(folder)])
    (session,) = reports.entity(ledger, "sessions").collect()
    assert (session.harness_version, session.current_model) == ("1", "m2")
    (run,) = reports.entity(ledger, "runs").collect()
    assert (run.source_run_id, run.role, run.model) == ("s", "session", "m2")
    assert {r.usage_group for r in reports.stats(ledger, "model", "UTC").collect()} == {"m2"}


def test_threads_place_events_at_their_root(spark, tmp_path, logs):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    sync.sync(spark, ledger, "codex", logs["codex"])
    tables = {"threads": spark.createDataFrame([("s", "m", 1), ("t", None, 2)], "id string, model string, created_at long"), "edges": spark.createDataFrame([("s", "t")], "parent_thread_id string, child_thread_id string"), "turns": spark.createDataFrame([("t", "u1", "done", 1, 2, 1), ("z", "u2", "done", 1, 2, 1)], "thread_id string, turn_id string, status string, started_at long, completed_at long, duration_ms long")}
    for n, df in tables.items():
        df.write.parquet(str(tmp_path / n))
    frames = lambda: snapshot(spark, *[str(tmp_path / n) for n in tables])
    shot = frames()
    assert stats(sync.sync_codex_state(spark, ledger, *shot.frames, check=shot))["version"] == 2
    agents = {r.agent_key: r.n for r in reports.usage_rows(ledger, True).groupBy("agent_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert agents == {"codex:session:s": 2, "codex:run:t": 1}
    assert {r.source_session_id for r in reports.placed_events(*(reports.entity(ledger, n) for n in ("events", "runs", "sessions"))).collect()} == {"s"}
    assert reports.entity(ledger, "turns").count() == 2 and {r.source_session_id for r in reports.entity(ledger, "sessions").collect()} == {"s", "t", "z"}
    assert stats(sync.sync_codex_state(spark, ledger, *frames().frames))["version"] == 2
    was = sorted(map(str, reports.entity(ledger, "sessions").collect()))
    sync.rebuild(spark, ledger, ["codex"])
    assert sorted(map(str, reports.entity(ledger, "sessions").collect())) == was
    # a table that changes after it was listed fails the sync without a version
    shot, version = frames(), ledger.version()
    spark.createDataFrame([("y", "m", 1)], "id string, model string, created_at long").write.mode("append").parquet(str(tmp_path / "threads"))
    with pytest.raises(Changed):
        sync.sync_codex_state(spark, ledger, shot.frames[0].unionByName(shot.frames[0].withColumn("id", F.lit("new"))), check=shot)
    assert ledger.version() == version


def test_a_sync_reads_touched_buckets_only(spark, tmp_path):
    ledger, folder = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "logs"
    for k in range(12):
        write(folder, f"{k}.jsonl", [meta(f"o{k}"), count((5, 1), (5, 1))])
    sync.sync(spark, ledger, "codex", [str(folder)])
    keys = spark.createDataFrame([("o7",)], "evidence_key string")
    touched = ledger.buckets_of("codex/observations", keys, "evidence_key")
    assert len(touched) == 1
    held = ledger._record(1)["codex/observations"]
    read = ledger.read("codex/observations", buckets=touched).inputFiles()
    assert 0 < len(read) < len(ledger.read("codex/observations").inputFiles()) and all(f"bucket={touched[0]}/" in f for f in read) and held["bytes"] > 0
    append(folder / "7.jsonl", count((9, 2), (4, 1), "2026-01-01T00:00:05Z"))
    sync.sync(spark, ledger, "codex", [str(folder)])
    changed = [b for b, runs in ledger._record(2)["codex/events"]["runs"].items() if runs != ledger._record(1)["codex/events"]["runs"].get(b)]
    assert changed == [str(b) for b in touched]
    assert {r.usage_group: r.event_count for r in reports.stats(ledger, "source", "UTC").collect()} == {"codex": 13}


def test_runs_are_merged_and_buckets_grow(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = lambda k: spark.createDataFrame([("same", k), (f"key{k}", k)], "key string, n int")
    monkeypatch.setattr(storage, "FANOUT", 3)
    for k in range(8):
        ledger.commit(Batch(keyed={"x": Keyed(rows(k), "key")}))
    bucket = str(ledger.buckets_of("x", spark.createDataFrame([("same",)], "key string"), "key")[0])
    runs = ledger._record(8)["x"]["runs"][bucket]
    assert len(runs) == 4 and sorted(level for _, level in runs) == [0, 0, 1, 1]  # eight runs, of which six were merged
    assert ledger.read("x").count() == 16 and ledger.read_keys("x", spark.createDataFrame([("same",)], "key string"), "key").count() == 8
    assert ledger.read("x", version=3).count() == 6
    monkeypatch.setattr(storage, "BUCKET_BYTES", held_bytes := ledger._record(8)["x"]["bytes"] // 12)
    ledger.commit(Batch(keyed={"x": Keyed(rows(20), "key")}))
    held = ledger._record(9)["x"]
    assert held["buckets"] == 16 and held["bytes"] > 12 * held_bytes and ledger.read("x").count() == 18
    assert ledger.read_keys("x", spark.createDataFrame([("key3",)], "key string"), "key").count() == 1


def test_writers_of_different_rows_both_commit(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    keys = [r.key for r in spark.range(200).select(F.concat(F.lit("k"), "id").alias("key")).collect()]
    one = lambda k, n: spark.createDataFrame([(k, n)], "key string, n int")
    of = {k: ledger.buckets_of("x", one(k, 0), "key") for k in keys[:40]}
    a, b = next((a, b) for a in of for b in of if of[a] != of[b])
    ledger.commit(Batch(keyed={"x": Keyed(one(a, 0).unionByName(one(b, 0)), "key")}))
    ledger.commit(Batch(keyed={"x": Keyed(one(a, 1), "key", of[a])}), base=1)
    assert ledger.commit(Batch(keyed={"x": Keyed(one(b, 2), "key", of[b]), "y": Keyed(one(b, 5), "key")}, append={"z": one("z", 1)}), base=1) == 3
    assert sorted((r.key, r.n) for r in ledger.read("x").collect()) == sorted([(a, 1), (b, 2)])
    with pytest.raises(Conflict):
        ledger.commit(Batch(keyed={"x": Keyed(one(b, 3), "key", of[b])}), base=1)
    ledger.commit(Batch(keyed={"y": Keyed(one(a, 6), "key")}), base=1)  # runs are appended on top of others' runs
    assert sorted(r.n for r in ledger.read("y").collect()) == [5, 6]


def test_issues_open_survive_resolve_and_reopen(spark, tmp_path):
    ledger, folder = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "logs"
    step = lambda *rows: (append(a, *rows), sync.sync(spark, ledger, "claude", [str(folder)]))
    found = lambda: sorted((r.opened, r.resolved) for r in ledger.read("claude/issues").where("category = 'iteration_conflict'").collect())
    over = {"input_tokens": 5, "output_tokens": 5, "iterations": [{"type": "message", "input_tokens": 50, "output_tokens": 1}]}
    a = write(folder, "a.jsonl", [assistant("m1", over), assistant("m2", {"input_tokens": 1, "output_tokens": -1})])
    sync.sync(spark, ledger, "claude", [str(folder)])
    assert found() == [(1, None)] and reports.open_issues(ledger).count() == 2
    step(assistant("m1", over))
    assert found() == [(1, None)]
    step(assistant("m1", {"input_tokens": 90, "output_tokens": 9}))  # the outer tokens now cover the iterations
    assert found() == [(1, 3)] and reports.open_issues(ledger).count() == 1
    step(assistant("m3", over))
    assert found() == [(1, 3), (4, None)]
    raised = spark.createDataFrame([("claude", "m1", "iteration_conflict", "m1")], "source string, scope string, category string, identifier string")
    again = entities.issue_intervals(ledger.read("claude/issues"), raised, raised.select("scope"), 9).where("identifier = 'm1'")
    assert sorted((r.opened, r.resolved) for r in again.collect()) == [(1, 3), (9, None)]
    sync.rebuild(spark, ledger, ["claude"])
    assert found() == [(1, 3), (4, None)] and reports.open_issues(ledger).count() == 2


def test_merges_outlast_syncs_and_rebuilds(spark, tmp_path):
    ledger, folder = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "logs"
    a = write(folder, "a.jsonl", [assistant(f"m{i}", {"input_tokens": i, "output_tokens": 1}) for i in range(1, 5)])
    sync.sync(spark, ledger, "claude", [str(folder)])
    pairs = lambda *p: spark.createDataFrame([(f"claude:{x}", f"claude:{y}") for x, y in p], "survivor string, absorbed string")
    status = lambda: {r.event_key[-2:]: (r.status, r.merged_into and r.merged_into[-2:]) for r in sync.events(ledger, "claude").collect()}
    assert sync.merge(ledger, "claude", pairs(("m1", "m2"))) == 2
    sync.merge(ledger, "claude", pairs(("m2", "m3")))  # its survivor is taken
    expected = {"m1": ("canonical", None), "m2": ("excluded", "m1"), "m3": ("excluded", "m1"), "m4": ("canonical", None)}
    assert status() == expected
    append(a, assistant("m2", {"input_tokens": 7, "output_tokens": 7}))
    sync.sync(spark, ledger, "claude", [str(folder)])
    assert status() == expected
    sync.rebuild(spark, ledger, ["claude"])
    assert status() == expected
    assert {r.usage_group: (r.event_count, r.input_tokens) for r in reports.stats(ledger, "source", "UTC").collect()} == {"claude": (2, 5)}
    assert sync.links(ledger, "claude").where("event_key = 'claude:m1'").count() == 4
    assert sync.merge(ledger, "claude", pairs(("m3", "m2"))) == ledger.version()  # one event already
    for bad in (pairs(("m1", "m9")), pairs(("m1", "m4"), ("m4", "m1"))):
        with pytest.raises(ValueError):
            sync.merge(ledger, "claude", bad)


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    ledger, zone = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "zone"
    write(zone, "a.jsonl", [meta("s"), count((5, 1), (5, 1))])
    run = lambda name: sync_stream(spark, ledger, "codex", str(zone), str(tmp_path / name)).awaitTermination()
    # killed between the write and the commit: nothing is committed, and the next run does it
    real = Ledger._created
    Ledger._created = lambda self, version, record: (_ for _ in ()).throw(RuntimeError("killed"))
    try:
        with pytest.raises(Exception, match="killed"):
            run("check")
    finally:
        Ledger._created = real
    assert ledger.version() == 0
    run("check")
    assert ledger.version() == 1 and ledger._record(1)["stream:codex"] == 0
    write(zone, "b.jsonl", [meta("t"), count((7, 1), (7, 1))])
    run("check")
    assert ledger.version() == 2
    # a batch that is delivered again commits nothing
    append(zone / "a.jsonl", count((9, 2), (4, 1), "2026-01-01T00:00:09Z"))
    assert stats(sync.sync(spark, ledger, "codex", [str(zone)], ("codex", 1)))["version"] == 2 == ledger.version()
    sync.sync(spark, ledger, "codex", [str(zone)], ("codex", 2))
    batch = Ledger(spark, str(tmp_path / "batch"))
    sync.sync(spark, batch, "codex", [str(zone)])
    key = lambda held: sorted(map(str, reports.entity(held, "events").collect()))
    assert key(ledger) == key(batch)


def test_an_empty_ledger_reports_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert reports.stats(ledger, "source", "UTC").count() == 0 and reports.channels(ledger).count() == 0 and reports.open_issues(ledger).count() == 0
    assert pi_log is not None
