"""Ingestion of the four log families over small logs written here."""

import json

import pytest
from pyspark.sql import functions as F

from usagemill.functions.tables import written
from usagemill.sources import claude, codex, opencode, pi
from usagemill.sources.lines import MANIFEST, corrupt_gate, lines, listing, next_manifest, read_files


def write(folder, name, records, tail=""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records) + tail)
    return path


def read(spark, folder):
    return lines(read_files(spark, [str(folder)]))


def meta(id_, **more):
    return {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": id_, **more}}


def count(total, last, at="2026-01-01T00:00:01Z"):
    names = ("input_tokens", "output_tokens")
    usage = lambda v: dict(zip(names, v, strict=True))
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(total), "last_token_usage": usage(last)}}}


def test_only_terminated_lines_count_and_a_corrupt_line_ends_its_file(spark, tmp_path):
    write(tmp_path, "a.jsonl", [{"x": 1}, "not json", {"x": 2}], tail='{"x": 3}')
    write(tmp_path, "b.jsonl", [{"x": 1}, "[1]"])
    rows = read(spark, tmp_path)
    assert rows.count() == 5
    good, issues = corrupt_gate(rows, "codex")
    assert good.count() == 2
    assert sorted(r.ordinal for r in issues.collect()) == [1, 1]
    assert {r.category for r in issues.collect()} == {"invalid_jsonl"}


def test_codex_counts_deltas_resets_and_copies_once(spark, tmp_path):
    reset = [meta("s"), count((100, 10), (100, 10)), count((120, 15), (20, 5), "2026-01-01T00:00:02Z"), count((10, 2), (10, 2), "2026-01-01T00:00:03Z"), count((10, 2), (10, 2), "2026-01-01T00:00:04Z")]
    write(tmp_path, "a/reset.jsonl", reset)
    write(tmp_path, "b/copy.jsonl", reset)
    events = codex.events(codex.parse(read(spark, tmp_path))["observations"])
    got = sorted((r.input_tokens, r.output_tokens, r.status) for r in events.collect())
    assert got == [(0, 0, "excluded"), (10, 2, "canonical"), (20, 5, "canonical"), (100, 10, "canonical")]


def test_codex_repeats_of_one_counter_count_once_each(spark, tmp_path):
    log = [meta("s"), count((10, 0), (10, 0)), count((0, 0), (0, 0)), count((10, 0), (10, 0)), count((10, 0), (10, 0))]
    write(tmp_path, "a.jsonl", log)
    write(tmp_path, "b.jsonl", log)
    events = codex.events(codex.parse(read(spark, tmp_path))["observations"])
    assert events.where("status = 'canonical'").agg(F.sum("input_tokens")).first()[0] == 20


def test_codex_owner_and_issues(spark, tmp_path):
    write(tmp_path, "a.jsonl", [count((1, 1), (1, 1)), meta("s"), count((1, 1), (1, 1)), meta(""), count((2, 2), (2, 2)), meta("t"), {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": "5"}}}}])
    out = codex.parse(read(spark, tmp_path))
    assert [r.owner for r in out["observations"].collect()] == ["s"]
    assert sorted(r.category for r in out["issues"].collect()) == ["invalid_usage", "missing_owner", "missing_owner", "missing_session_id"]


def assistant(id_, usage, at="2026-01-01T00:00:00Z", **more):
    return {"timestamp": at, "type": "assistant", "sessionId": "s", "uuid": "u", **more, "message": {"id": id_, "model": "m", "usage": usage, "content": "PRIVATE_TEXT"}}


def test_claude_progressive_snapshots_are_one_event(spark, tmp_path):
    use = lambda o: {"input_tokens": 2, "output_tokens": o, "cache_read_input_tokens": 20, "cache_creation_input_tokens": 3, "cache_creation": {"ephemeral_5m_input_tokens": 1, "ephemeral_1h_input_tokens": 2}}
    write(tmp_path, "a.jsonl", [assistant("m1", use(1)), assistant("m1", use(21), "2026-01-02T00:00:00Z"), assistant("m1", use(9))])
    out = claude.parse(read(spark, tmp_path))
    events, issues = claude.events(out["observations"])
    (row,) = events.collect()
    assert (row.input_tokens, row.output_tokens, row.cache_read_tokens, row.cache_write_tokens, row.cache_write_5m_tokens, row.cache_write_1h_tokens) == (2, 21, 20, 3, 1, 2)
    assert row.event_key == "claude:m1" and row.completed_at_ns == 1767225600 * 10**9
    assert issues.count() == 0
    assert "PRIVATE" not in str(out["observations"].toPandas().to_dict())


def item(kind, i, o, **more):
    return {"type": kind, "input_tokens": i, "output_tokens": o, **more}


def test_claude_residual_and_conflict(spark, tmp_path):
    write(tmp_path, "a.jsonl", [assistant("r", {"input_tokens": 2, "output_tokens": 15, "iterations": [item("message", 2, 10), item("advisor_message", 20, 7, model="adv")]})])
    write(tmp_path, "b.jsonl", [assistant("c", {"input_tokens": 1, "output_tokens": 5, "iterations": [item("message", 1, 10), item("advisor_message", 20, 3)]})])
    events, issues = claude.events(claude.parse(read(spark, tmp_path))["observations"])
    got = {r.event_key: (r.input_tokens, r.output_tokens, r.status, r.model) for r in events.collect()}
    assert got["claude:r:residual"] == (0, 5, "canonical", "m")
    assert got["claude:r:iteration:1"] == (20, 7, "canonical", "adv")
    assert got["claude:c:iteration:0"][2] == "conflicted" and got["claude:c:iteration:1"][:3] == (20, 3, "canonical")
    assert [r.identifier for r in issues.collect()] == ["c"]


def test_claude_rejects_bad_records_without_content(spark, tmp_path):
    write(tmp_path, "a.jsonl", [assistant("x", {"input_tokens": -1}), {"type": "assistant", "message": 5}, {"type": "assistant", "message": {"usage": {"input_tokens": 1}}}, assistant("y", {"input_tokens": 1, "iterations": 3}), assistant("z", {"input_tokens": 1, "iterations": [item("other", 1, 1)]})])
    out = claude.parse(read(spark, tmp_path))
    assert out["observations"].count() == 0
    assert sorted(r.category for r in out["issues"].collect()) == ["invalid_iteration_type", "invalid_iterations", "invalid_message", "invalid_usage", "missing_message_identity"]


USE = {"input": 10, "output": 5, "cacheRead": 3, "cacheWrite": 2, "cacheWrite1h": 1, "totalTokens": 20, "cost": {"input": 0.029, "total": 6e-10}}


def pi_log(*records):
    return [{"type": "session", "id": "root", "version": 3, "timestamp": "2026-01-01T00:00:00Z", "cwd": "/PRIVATE"}, *records]


def test_pi_direct_slots_samples_and_copies(spark, tmp_path):
    log = pi_log(
        {"type": "model_change", "provider": "p", "modelId": "m0"},
        {"type": "thinking_level_change", "thinkingLevel": "high"},
        {"type": "message", "id": "e1", "message": {"role": "assistant", "model": "m", "stopReason": "stop", "usage": USE}},
        {"type": "message", "id": "e2", "message": {"role": "toolResult", "isError": True, "usage": USE}},
        {"type": "compaction", "id": "e3", "usage": USE, "tokensBefore": 1234},
        {"type": "message", "id": "e4", "message": {"role": "assistant", "usage": {"input": 1}}},
        {"type": "message", "id": "e5", "message": {"role": "toolResult", "toolName": "subagent", "details": {"records": []}, "usage": USE}},
    )
    write(tmp_path, "a.jsonl", log)
    write(tmp_path, "noheader.jsonl", [{"type": "message", "id": "q", "message": {"role": "assistant", "usage": USE}}])
    out = pi.parse(read(spark, tmp_path))
    got = {r.entry: (r.slot, r.effort, r.success, r.error_category, r.derived_total_tokens, r.cache_write_5m_tokens, r.input_cost_nanos, r.total_cost_nanos) for r in out["direct"].collect()}
    assert got == {"e1": ("assistant", "high", True, None, 20, 1, 29000000, 1), "e2": ("tool_result", "high", False, "tool_error", 20, 1, 29000000, 1), "e3": ("compaction", "high", True, None, 20, 1, 29000000, 1)}
    assert [r.value_integer for r in out["samples"].collect()] == [1234]
    assert [r.category for r in out["issues"].collect()] == ["invalid_usage"]
    assert out["batches"].count() == 1
    events = pi.events(out)
    assert sorted(r.event_key for r in events.collect()) == ["pi:root:e1:assistant", "pi:root:e2:tool_result", "pi:root:e3:compaction"]


def test_pi_subagents_prefer_terminal_and_fold_by_dominance(spark, tmp_path):
    snap = lambda status, i, o, at: {"type": "custom", "customType": "orchestrator-subagent", "timestamp": at, "data": {"id": "a", "batchId": "b", "status": status, "model": "prov/mod/x", "startedAt": 1000, "finishedAt": 3000 if status == "completed" else None, "usage": {"input": i, "output": o, "cacheRead": 0, "cacheWrite": 0, "cost": 0.5}}}
    write(tmp_path, "a.jsonl", pi_log(snap("running", 1, 5, "2026-01-01T00:00:01Z"), snap("completed", 2, 6, "2026-01-01T00:00:02Z"), snap("running", 9, 1, "2026-01-01T00:00:03Z"), snap("odd", 1, 1, "2026-01-01T00:00:04Z")))
    out = pi.parse(read(spark, tmp_path))
    (row,) = pi.events(out).collect()
    assert row.event_key == "pi:subagent:b:a" and (row.input_tokens, row.output_tokens) == (2, 6)
    assert (row.provider, row.model, row.success, row.total_cost_nanos) == ("prov", "mod/x", True, 500000000)
    assert [r.category for r in out["issues"].collect()] == ["invalid_subagent"]


def opencode_tables(spark, version="1.2.3"):
    session = spark.createDataFrame([("s", None, version, "agent", 1, 2), ("c", "s", version, None, 0, 5)], "id string, parent_id string, version string, agent string, time_created long, time_updated long")
    data = lambda **x: json.dumps({"role": "assistant", "providerID": "p", "modelID": "m", "time": {"completed": 7}, **x})
    message = spark.createDataFrame([("m1", "s", 1, 2, data(tokens={"input": 50})), ("m2", "s", 1, 2, data(tokens={"input": 5, "output": 2, "reasoning": 1, "cache": {"read": 1, "write": 1}}, cost=6e-10)), ("m3", "s", 1, 2, json.dumps({"role": "user"}))], "id string, session_id string, time_created long, time_updated long, data string")
    part = spark.createDataFrame([("p1", "m1", "s", 1, 2, json.dumps({"type": "step-finish", "cost": 0.029, "tokens": {"input": 20}})), ("p2", "m1", "s", 1, 2, json.dumps({"type": "text"}))], "id string, message_id string, session_id string, time_created long, time_updated long, data string")
    return session, message, part


def test_opencode_parts_replace_messages(spark):
    rows = {r.event_key: r for r in opencode.observations(*opencode_tables(spark)).collect()}
    assert set(rows) == {"opencode:part:p1", "opencode:message:m2"}
    assert (rows["opencode:part:p1"].derived_total_tokens, rows["opencode:part:p1"].total_cost_nanos, rows["opencode:part:p1"].agent) == (20, 29000000, "agent")
    assert (rows["opencode:message:m2"].output_tokens, rows["opencode:message:m2"].derived_total_tokens, rows["opencode:message:m2"].total_cost_nanos, rows["opencode:message:m2"].completed_at_ns) == (3, 10, 1, 7000000)
    sessions, runs = opencode.sessions(opencode_tables(spark)[0])
    assert [r.parent_run_id for r in runs.collect()] == ["s"]
    assert sessions.where("source_session_id = 'c'").first().started_at_ns is None


def test_opencode_schema_gate(spark):
    with pytest.raises(ValueError):
        opencode.observations(*opencode_tables(spark, "2.0.0"))
    session, message, part = opencode_tables(spark)
    with pytest.raises(ValueError):
        opencode.schema_gate(session, message.drop("data"), part)


def test_opencode_fallback_then_parts_keeps_what_dominates(spark):
    session, message, part = opencode_tables(spark)
    first = opencode.observations(session, message, part.where("false")).withColumn("sync", F.lit(1))
    second = opencode.observations(session, message, part).withColumn("sync", F.lit(2))
    events = {r.event_key: r for r in opencode.events(first.unionByName(second), ["sync", "observation_key"]).collect()}
    assert events["opencode:message:m1"].status == "canonical" and events["opencode:part:p1"].status == "excluded"  # 50 against 20


def test_opencode_events_fold_the_revisions_of_each_event(spark):
    """Revisions in order, not a maximum: one that isn't larger in all changes no tokens; cost is the largest, the time the first positive one, names the last."""
    fields = [f for f in opencode.FIELDS if f != "derived_total_tokens"]
    row = lambda sync, i, o, cost, at, model: ("opencode:part:p", sync, f"k{sync}", "part", "m", "s", "p", model, "a", *[{"input_tokens": i, "output_tokens": o}.get(f, 0) for f in fields], i + o, cost, at)
    schema = "event_key string, sync long, observation_key string, kind string, message_id string, session_id string, provider string, model string, agent string, " + ", ".join(f"{f} long" for f in fields) + ", derived_total_tokens long, total_cost_nanos long, completed_at_ns long"
    retained = spark.createDataFrame([row(3, 9, 1, 5, 30, "z"), row(1, 2, 2, 7, None, "x"), row(2, 5, 3, None, 20, "y")], schema)
    (found,) = opencode.events(retained, ["sync", "observation_key"]).collect()
    assert (found.input_tokens, found.output_tokens, found.total_cost_nanos, found.completed_at_ns, found.model, found.status) == (5, 3, 7, 20, "z", "canonical")


def test_opencode_messages_and_steps_meet_once(spark):
    """Messages and steps are joined once; events are dealt by event and by message only."""
    session, message, part = opencode_tables(spark)
    plan = opencode.observations(session, message, part)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # with sessions and with steps
    events = opencode.events(written(opencode.observations(session, message, part)), ["observation_key"])._jdf.queryExecution().executedPlan().toString()
    assert events.count("Exchange hashpartitioning") == 2 and "Join" not in events



def test_manifest_generations(spark, tmp_path):
    import os

    a, b = write(tmp_path, "a.jsonl", [{"x": 1}]), write(tmp_path, "b.jsonl", [{"x": 1}])
    empty = spark.createDataFrame([], MANIFEST)

    def listed(state):
        rows = next_manifest(state, listing(spark, [str(tmp_path)])).collect()
        return spark.createDataFrame(rows, MANIFEST), {r.file.rsplit("/", 1)[1]: (r.generation, r.is_missing, r.changed) for r in rows}

    state, got = listed(empty)
    assert all(x == (0, False, True) for x in got.values())
    with a.open("a") as f:
        f.write('{"x": 2}\n')
    b.unlink()
    state, got = listed(state)
    assert got == {"a.jsonl": (0, False, True), "b.jsonl": (0, True, False)}
    assert listed(state)[1] == {"a.jsonl": (0, False, False), "b.jsonl": (0, True, False)}
    a.write_text('{"y": 1}\n{"x": 22}\n')
    os.utime(a, (os.stat(a).st_mtime + 10,) * 2)
    write(tmp_path, "b.jsonl", [{"x": 1}])
    assert listed(state)[1] == {"a.jsonl": (1, False, True), "b.jsonl": (1, False, True)}
    assert "content" not in listing(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_carried_marks_cross_blocks_and_files(spark, monkeypatch):
    from usagemill.sources import lines as module

    monkeypatch.setattr(module, "BLOCK_LINES", 4)
    rows = spark.range(20).select(F.lit("a").alias("file"), F.col("id").alias("ordinal")).unionByName(spark.range(9).select(F.lit("b").alias("file"), F.col("id").alias("ordinal")))
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 13, None), ("a", 14, "y"), ("b", 5, "z")], "file string, ordinal long, owner string")
    got = {(r.file, r.ordinal): r.owner for r in module.carried(rows, marks, "owner").collect()}
    assert len(got) == 29
    assert got == {("a", n): None if n in (0, 13) else "x" if n < 13 else "y" for n in range(20)} | {("b", n): "z" if n >= 5 else None for n in range(9)}


def test_filters_on_parsed_columns_read_a_table(spark, tmp_path):
    """A filter on tokens takes nothing from the variant again."""
    usage = {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4}
    write(tmp_path, "a.jsonl", [{"type": "session", "id": "s"}, {"type": "message", "id": "e", "message": {"role": "assistant", "usage": usage}}])
    direct = pi.parse(read(spark, tmp_path))["direct"].drop("effort").where("input_tokens > 0")
    assert direct.count() == 1
    assert "message.usage" not in direct._jdf.queryExecution().optimizedPlan().toString()


def test_long_files_are_read_in_pieces_with_the_same_lines(spark, tmp_path):
    from usagemill.sources.lines import contents, numbered

    for n, text in enumerate(["".join(f'{{"n": {i}, "\u00e9": "{"x" * (i % 90)}"}}\n' for i in range(400)) + "\n\ncut", "a\r\n\nb\n", "tail", "", "\ufeffa\nb\n", "\ufeffa\nb"]):
        (tmp_path / f"a b+c%20{n}.jsonl").write_bytes(text.encode())
    files = [r.file for r in listing(spark, [str(tmp_path)]).collect()]
    expected = sorted(map(tuple, lines(contents(spark, files)).collect()))
    size, cost = (spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = numbered(spark, files)
        assert sorted(map(tuple, found.collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_manifest_opens_the_first_bytes_of_large_files_only(spark, tmp_path, monkeypatch):
    from usagemill.sources import lines as module

    write(tmp_path, "a.jsonl", [{"x": "y" * 9000}])
    whole = next_manifest(spark.createDataFrame([], MANIFEST), listing(spark, [str(tmp_path)])).first()
    monkeypatch.setattr(module, "LARGE", 100)
    assert next_manifest(spark.createDataFrame([], MANIFEST), listing(spark, [str(tmp_path)])).first().prefix_hash == whole.prefix_hash


def test_codex_counts_are_read_at_their_types(spark):
    """B2: of two names the first valid one; floats, texts and negative numbers are no counts; all of a usage object comes from one cast."""
    body = '{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":7,"output_tokens":"3","cached_input_tokens":4,"cache_read_input_tokens":-1},"last_token_usage":{"input_tokens":2.0,"total_tokens":5}}}}'
    rows = spark.createDataFrame([("f", 0, '{"type":"session_meta","payload":{"id":"s"}}'), ("f", 1, body)], "file string, ordinal long, line string")
    (found,) = codex.parse(rows)["observations"].collect()
    assert (found.total_input_tokens, found.total_output_tokens, found.total_cache_read_tokens, found.last_input_tokens, found.last_reported_total_tokens) == (7, None, 4, None, 5)


def test_pi_usage_is_read_once_and_as_strictly_as_from_variants(spark, tmp_path, monkeypatch):
    """Lines of direct usage go into one table of columns, without their text; numbers in text, fractions and numbers for names are still refused."""
    from usagemill.sources import lines as source_lines

    tables, real = [], source_lines.written
    keep = lambda df, *a: tables.append(df.columns) or real(df, *a)
    monkeypatch.setattr(source_lines, "written", keep)
    monkeypatch.setattr(pi, "written", keep)
    of = lambda id_, **x: {"type": "message", "id": id_, "message": {"role": "assistant", "model": "m", "usage": USE | x}}
    odd = [of("a"), of("b", input="10"), of("c", input=10.0), of("d", input=10**25), of(5), of("6"), of("7x", cost={"total": "0.5"}), of("e", reasoning="1"), {"type": "message", "id": "f", "message": {"role": "assistant", "model": 5, "usage": USE}}]
    write(tmp_path, "a.jsonl", pi_log(*odd))
    out = pi.parse(read(spark, tmp_path))
    got = {r.entry: (r.model, r.total_cost_nanos, r.reasoning_tokens is None) for r in out["direct"].collect()}
    assert set(got) == {"a", "6", "7x", "e", "f"} and got["7x"][1] is None and got["a"][1] is not None and got["e"][2] and got["f"][0] is None and got["6"][0] == "m"
    assert sorted(r.category for r in out["issues"].collect()) == ["invalid_usage"] * 3 + ["missing_usage_identity"]
    assert sum("input_tokens" in t for t in tables) == 1 and not any("v" in t and "input_tokens" in t for t in tables)
