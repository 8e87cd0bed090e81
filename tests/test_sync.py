"""Syncs of small logs: appends, copies, replaced and vanished files, rebuilds, references, two writers."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_sources import assistant, count, meta, opencode_tables, pi_log, write

from usagemill import sync
from usagemill.ledger import Batch, Conflict, Ledger
from usagemill.sources import codex


def stats(df):
    (row,) = df.collect()
    return row.asDict()


def later(path):
    """Moves a file's time on, as writes within a test may share one."""
    os.utime(path, (os.stat(path).st_mtime + 10,) * 2)


def counted(ledger, source="codex"):
    return {r.event_key: (r.input_tokens, r.output_tokens) for r in sync.events(ledger, source).where("status = 'canonical'").collect()}


def test_sync_appends_recounts_and_forgets_nothing(spark, tmp_path):
    ledger, logs = Ledger(spark, str(tmp_path / "ledger")), tmp_path / "logs"
    a = write(logs, "a.jsonl", [meta("s"), count((100, 10), (100, 10)), count((120, 15), (20, 5), "2026-01-01T00:00:02Z")])
    write(logs, "copy.jsonl", [meta("s"), count((100, 10), (100, 10))])
    write(logs, "b.jsonl", [meta("t"), count((7, 1), (7, 1))])
    first = stats(sync.sync(spark, ledger, "codex", [str(logs)]))
    assert (first["files_read"], first["lines_read"], first["inserted"], first["updated"], first["version"]) == (3, 7, 3, 0, 1)
    # a second sync reads and writes nothing
    again = stats(sync.sync(spark, ledger, "codex", [str(logs)]))
    assert again == first | dict.fromkeys(("files_read", "lines_read", "observations", "inserted", "updated"), 0) and ledger.version() == 1
    before = counted(ledger)
    # an append: only the new line is evidence, only its owner is recomputed
    with a.open("a") as f:
        f.write(json.dumps(count((150, 20), (30, 5), "2026-01-01T00:00:03Z")) + "\n")
    later(a)
    more = stats(sync.sync(spark, ledger, "codex", [str(logs)]))
    assert (more["files_read"], more["lines_read"], more["observations"], more["inserted"], more["updated"]) == (1, 1, 1, 1, 0)
    assert sorted(counted(ledger).values()) == sorted([*before.values(), (30, 5)])
    # a replaced file is a new generation: its lines are new evidence, the old ones stay
    a.write_text("".join(json.dumps(r) + "\n" for r in [meta("s"), count((9, 9), (9, 9), "2026-02-01T00:00:00Z")]))
    later(a)
    replaced = stats(sync.sync(spark, ledger, "codex", [str(logs)]))
    assert (replaced["observations"], replaced["inserted"]) == (2, 1)
    assert sorted(counted(ledger).values()) == sorted([*before.values(), (30, 5), (9, 9)])
    keys = [r.observation_key for r in ledger.read("codex/observations").collect()]
    assert len(keys) == len(set(keys)) and {k.split(":")[3] for k in keys} == {"0", "1"}
    # a vanished file removes no usage
    a.unlink()
    gone = stats(sync.sync(spark, ledger, "codex", [str(logs)]))
    assert gone["files_read"] == 0 and ledger.version() == gone["version"] == 4
    assert len(counted(ledger)) == 5
    # a rebuild from evidence gives the same events
    events = sync.events(ledger, "codex").collect()
    rebuilt = stats(sync.rebuild(spark, ledger, ["codex", "claude"]))
    assert (rebuilt["inserted"], rebuilt["updated"], rebuilt["version"]) == (0, 0, 5)
    assert sorted(map(tuple, sync.events(ledger, "codex").select(*sync.events(ledger, "codex").columns).collect()), key=str) == sorted(map(tuple, events), key=str)


def test_all_sources_sync_into_one_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    use = {"input": 10, "output": 5, "cacheRead": 3, "cacheWrite": 2, "totalTokens": 20, "cost": {"total": 0.5}}
    write(tmp_path / "claude", "c.jsonl", [assistant("m1", {"input_tokens": 2, "output_tokens": 1}), assistant("m1", {"input_tokens": 2, "output_tokens": 9}), assistant("m2", {"input_tokens": -1})])
    child = [{"type": "session", "id": "kid", "parentSession": "root", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "message", "id": "k1", "message": {"role": "assistant", "usage": use}}]
    write(tmp_path / "pi", "kid.jsonl", child)
    out = sync.sync_all(spark, ledger, {"claude": [str(tmp_path / "claude")], "pi": [str(tmp_path / "pi")], "opencode": opencode_tables(spark), "codex": None, "odd": ["x"]})
    assert (out["claude"], out["pi"], out["opencode"], out["codex"]) == ("ok", "ok", "ok", "skipped") and out["odd"].startswith("error")
    assert counted(ledger, "claude") == {"claude:m1": (2, 9)} and set(counted(ledger, "pi")) == {"pi:root:k1:assistant"}
    assert sync.events(ledger, "pi").first().original_decimal == "0.5"
    (issue,) = ledger.read("claude/issues").collect()
    assert (issue.category, issue.severity, issue.value_type, issue.field_path, issue.opened, issue.resolved) == ("invalid_usage", "error", "OBJECT", "2", 1, None) and issue.identifier.endswith(":generation:0:ordinal:2")
    # a parent that arrives later has a parent of its own: the child's events move to the new root
    write(tmp_path / "pi", "root.jsonl", [{"type": "session", "id": "root", "parentSession": "top", "timestamp": "2026-01-01T00:00:00Z"}])
    sync.sync(spark, ledger, "pi", [str(tmp_path / "pi")])
    assert set(counted(ledger, "pi")) == {"pi:top:k1:assistant"}
    assert sync.events(ledger, "pi").where("status = 'excluded'").first().event_key == "pi:root:k1:assistant"
    assert stats(sync.sync(spark, ledger, "opencode", opencode_tables(spark)))["observations"] == 0
    with pytest.raises(Exception):
        sync.sync_all(spark, ledger, {"odd": ["x"]}, strict=True)


def test_ledger_carries_over_by_name_and_has_one_writer(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.version() == 0 and ledger.read("rows") is None
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long")
    ledger.commit(Batch(replace={"other": rows}, append={"rows": ledger.fresh("rows", rows, ["key"])}))
    more = spark.createDataFrame([("b", 9), ("c", 3)], "key string, n long")
    ledger.commit(Batch(append={"rows": ledger.fresh("rows", more, ["key"])}))
    assert sorted(map(tuple, ledger.read("rows").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert ledger._record(1)["other"] == ledger._record(2)["other"] and sorted(map(tuple, ledger.read("rows", 1).collect())) == [("a", 1), ("b", 2)]
    for broken in (Batch(replace={"rows": more.withColumn("n", F.raise_error(F.lit("stop")).cast("long"))}), Batch(replace={"x": more}, references=[(more, "key", rows, "key")])):
        with pytest.raises(Exception):
            ledger.commit(broken)
    assert ledger.version() == 2 and ledger.read("rows").count() == 3
    # another writer that has replaced what a commit from version 2 replaces
    ledger.commit(Batch(replace={"other": more}))
    with pytest.raises(Conflict):
        ledger.commit(Batch(replace={"other": rows}), base=2)
    assert ledger.commit(Batch(replace={"x": rows}), base=2) == 4 and ledger.read("other").count() == 2 and ledger.read("x").count() == 2


def test_an_owners_sequence_restarts_where_the_owner_changes(spark, tmp_path):
    from usagemill.sources.lines import lines, read_files

    at = iter(range(1, 60))
    c = lambda: count((1, 1), (1, 1), f"2026-01-01T00:00:{next(at):02d}Z")
    write(tmp_path, "a.jsonl", [meta("A"), c(), c(), meta("A"), c(), meta("B"), c(), meta("A"), c(), meta(""), c(), meta("A"), c()])
    got = codex.parse(lines(read_files(spark, [str(tmp_path)])))["observations"].orderBy("ordinal").collect()
    assert [(r.owner, r.sequence) for r in got] == [("A", 0), ("A", 1), ("A", 2), ("B", 0), ("A", 0), ("A", 0)]


def test_threads_and_turns(spark):
    table = spark.createDataFrame([("a", "m", 1), ("b", None, 2), ("c", None, 3)], "id string, model string, created_at long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "parent_thread_id string, child_thread_id string")
    got = {r.source_session_id: (r.root, r.depth, r.parent_session_id, r.created_at_ns) for r in codex.threads(table, edges).collect()}
    assert got == {"a": ("a", 0, None, 10**6), "b": ("a", 1, "a", 2 * 10**6), "c": ("a", 2, "b", 3 * 10**6)}
    turns = spark.createDataFrame([("a", "t1", "done", 1, 2, 1), ("z", "t2", "done", 1, 2, 1), ("z", None, "done", 1, 2, 1)], "thread_id string, turn_id string, status string, started_at long, completed_at long, duration_ms long")
    out = codex.turns(turns, codex.threads(table))
    assert out["turns"].count() == 2 and [r.source_run_id for r in out["runs"].collect()] == ["z"]


def test_syncs_and_rebuilds_leave_nothing_in_the_shared_folder(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    ledger, settings = Ledger(spark, str(tmp_path / "ledger")), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec")
    write(tmp_path / "logs", "a.jsonl", [meta("s"), count((100, 10), (100, 10))])
    before, was = set(os.listdir(shared)), [spark.conf.get(k) for k in settings]
    sync.sync(spark, ledger, "codex", [str(tmp_path / "logs")])
    sync.sync(spark, ledger, "opencode", opencode_tables(spark))
    sync.rebuild(spark, ledger, ["codex", "opencode"])
    with pytest.raises(ValueError):
        sync.sync(spark, ledger, "opencode", tuple(df.drop("id") for df in opencode_tables(spark)))
    assert set(os.listdir(shared)) == before and [spark.conf.get(k) for k in settings] == was
    assert counted(ledger) and counted(ledger, "opencode")


def test_opencode_observations_are_dealt_by_message_once(spark, tmp_path, monkeypatch):
    """Whether a key is there already is asked where the rows of its message lie."""
    asked, real = [], Ledger.fresh
    monkeypatch.setattr(Ledger, "fresh", lambda self, entity, rows, keys, version=None: asked.append(out := real(self, entity, rows, keys, version)) or out)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sync.sync(spark, Ledger(spark, str(tmp_path / "ledger")), "opencode", opencode_tables(spark))
        plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "hashpartitioning(message_id" in plan and "hashpartitioning(observation_key" not in plan and "observation_key#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
