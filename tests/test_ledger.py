"""Ledger commits, merges, lineage with cycles, streaming ingestion, windows, pricing and safety checks."""

import json
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from usagemill import demo
from usagemill.functions import safety, tokens
from usagemill.ledger import merge_events
from usagemill.operators import lineage, reconcile
from usagemill.plans import pricing
from usagemill.streaming.ingest import ingest


def test_merge_follows_chains_and_fills_nulls(spark):
    events = spark.createDataFrame([("a", "canonical", None), ("b", "canonical", "x"), ("c", "canonical", "y")], "event_key string, status string, model string")
    links = spark.createDataFrame([("o1", "b"), ("o2", "c")], "observation string, event_key string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "survivor string, absorbed string")
    out, moved = merge_events(events, links, pairs, ["model"])
    assert {r.event_key: (r.status, r.model, r.merged_into) for r in out.collect()} == {"a": ("canonical", "x", None), "b": ("excluded", "x", "a"), "c": ("excluded", "y", "a")}
    assert sorted(map(tuple, moved.collect())) == [("o1", "a"), ("o1", "b"), ("o2", "a"), ("o2", "c")]


def test_roots_depths_and_cycles(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "gone"), ("p", "q"), ("q", "p"), ("t", "p")], "node string, parent string")
    got = {r.node: (r.root, r.depth) for r in lineage.roots(nodes).collect()}
    assert {k: got[k] for k in "rabcd"} == {"r": ("r", 0), "a": ("r", 1), "b": ("r", 2), "c": ("r", 3), "d": ("r", 4)}
    assert got["x"] == ("gone", 1)
    assert got["p"][0] == "q" and got["q"][0] == "p"
    seen = {r.node: r.root for r in lineage.roots(nodes, stop_before_seen=False).collect()}
    assert seen["p"] == "p" and seen["q"] == "q" and seen["t"] == "p"


def walked(parents, node, stop_before_seen):
    """The walk from a node, hop by hop: (root, hops)."""
    at, seen = node, [node]
    while (up := parents.get(at)) is not None and up != at:
        if up in seen:
            return (at, len(seen) - 1) if stop_before_seen else (up, len(seen))
        at = up
        seen.append(at)
    return at, len(seen) - 1


@pytest.mark.parametrize("stop_before_seen", [True, False])
def test_roots_equal_walks(spark, stop_before_seen):
    import random

    rng = random.Random(4)
    parents = {f"n{i}": f"n{rng.randrange(60)}" for i in range(60)} | {f"m{i}": f"m{max(i - rng.randint(1, 3), 0)}" for i in range(40)} | {f"r{i}": f"r{(i + 1) % 16}" for i in range(16)} | {"m0": None, "in": "r3", "x": "gone", "self": "self"}
    nodes = spark.createDataFrame(list(parents.items()), "node string, parent string")
    got = {r.node: (r.root, r.depth) for r in lineage.roots(nodes, stop_before_seen=stop_before_seen).collect()}
    assert got == {n: walked(parents, n, stop_before_seen) for n in parents}


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    tables, real = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda df: tables.append(1) or real(df))
    n = 3000
    ring = spark.range(n).select("id", ((F.col("id") + 1) % n).alias("up"))
    got = lineage.roots(ring, "id", "up").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("a"), F.max("depth").alias("b"), F.sum((F.col("root") == (F.col("node") + n - 1) % n).cast("int")).alias("right")).first()
    assert tuple(got) == (n, n - 1, n - 1, n) and len(tables) < 40


def test_dominance_is_a_fold(spark):
    rows = spark.createDataFrame([("k", 1, 6, 1, 5), ("k", 2, 6, 2, 4), ("k", 3, 8, 2, 6)], "k string, seq int, total long, a long, b long")
    (row,) = reconcile.dominance_fold(rows, ["k"], ["seq"], "total", ["a", "b"]).collect()
    assert (row.a, row.b) == (2, 6)


def test_stream_reads_each_file_once(spark, tmp_path):
    zone, seen = tmp_path / "zone", []
    zone.mkdir()
    (zone / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n{"cut')
    run = lambda: ingest(spark, str(zone), str(tmp_path / "check"), lambda df, n: seen.extend((r.file.rsplit("/", 1)[1], r.ordinal) for r in df.collect())).awaitTermination()
    run()
    (zone / "b.jsonl").write_text('{"x": 3}\n')
    run()
    run()
    assert sorted(seen) == [("a.jsonl", 0), ("a.jsonl", 1), ("b.jsonl", 0)]


@pytest.mark.parametrize(("now", "hours"), [(datetime(2026, 3, 10, 12, tzinfo=UTC), 167), (datetime(2026, 11, 3, 12, tzinfo=UTC), 169)])
def test_windows_follow_daylight_saving(now, hours):
    lo, hi = tokens.window_bounds("7d", ZoneInfo("America/New_York"), now)
    assert (hi - lo) // 3_600_000_000_000 == hours


def test_window_arguments():
    with pytest.raises(ValueError):
        tokens.window_bounds(0, UTC, datetime.now(UTC))
    with pytest.raises(ValueError):
        tokens.window_bounds(7, UTC, datetime(2026, 1, 1))
    assert tokens.window_bounds("all", UTC, datetime.now(UTC)) is None


CARD = {"schema_version": 1, "currency": "USD", "unit_tokens": 1000000, "provider_aliases": {}, "models": [{"provider": "openai", "model": "gpt", "retrieved_at": "2026-01-01", "aliases": ["g"], "prices": [
    {"effective_from": "2026-01-01T00:00:00Z", "input": 2, "cached_input": 0.2, "cache_write": 3, "cache_write_5m": 4, "cache_write_1h": 5, "output": 10,
     "long_context": {"above_input_tokens": 100, "inclusive": False, "input": 4, "output": 15}, "tier_multipliers": {"fast": 2}, "region_multipliers": {"eu": 1.1}, "time_multipliers": [{"weekdays": [0], "start_hour_utc": 2, "end_hour_utc": 3, "multiplier": 0.5}]}]}]}
COLUMNS = "source string, granularity string, provider string, resolved_model string, requested_model string, occurred_at_ns long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, cache_write_5m_tokens long, cache_write_1h_tokens long, reasoning_tokens long, reported_total_tokens long, derived_total_tokens long, total_cost_nanos long, service_tier string, speed string, inference_region string"


def row(**x):
    base = dict.fromkeys((c.split()[0] for c in COLUMNS.split(", ")), None) | {"source": "pi", "granularity": "model_call", "provider": "openai", "resolved_model": "gpt", "occurred_at_ns": 1767225600 * 10**9}
    return tuple((base | x).values())


def test_prices(spark, tmp_path):
    path = tmp_path / "card.json"
    path.write_text(json.dumps(CARD))
    rates = pricing.load_rate_card(spark, str(path))
    assert pricing.card_checks(rates).count() == 0
    monday = int(datetime(2026, 1, 5, 2, tzinfo=UTC).timestamp()) * 10**9
    cases = [
        (row(input_tokens=1000000, granularity="counter_delta"), 2_000_000_000),
        (row(resolved_model="(unknown)", requested_model="OpenAI/G", provider=None, output_tokens=100000), 1_000_000_000),
        (row(source="codex", provider=None, input_tokens=100, cache_read_tokens=40, output_tokens=10), 228_000),
        (row(input_tokens=60, cache_read_tokens=40, output_tokens=10), 228_000),
        (row(cache_write_tokens=10, cache_write_5m_tokens=4, cache_write_1h_tokens=3), 40_000),
        (row(input_tokens=101, output_tokens=10, speed="fast", inference_region="eu", occurred_at_ns=monday), 609_400),
        (row(input_tokens=101, granularity="counter_delta"), 202_000),
        (row(input_tokens=1, reported_total_tokens=5), None),
        (row(input_tokens=1, speed="fast", service_tier="flex"), None),
        (row(input_tokens=1, occurred_at_ns=None), None),
        (row(input_tokens=1, total_cost_nanos=7), 7),
        (row(source="claude", provider=None, input_tokens=1), None),
    ]
    df = spark.createDataFrame([(*r, i) for i, (r, _) in enumerate(cases)], COLUMNS + ", i int")
    got = {r.i: r.est_nanos for r in pricing.price(df, rates).collect()}
    assert [got[i] for i in range(len(cases))] == [n for _, n in cases]


def test_a_unit_that_does_not_divide_a_billion(spark):
    card = CARD | {"unit_tokens": 3_000_000}
    rates = pricing.rate_tables(spark.createDataFrame([(json.dumps(card),)], "value string").selectExpr(f"from_json(value, '{pricing.CARD}') AS card"))
    df = spark.createDataFrame([(*row(input_tokens=3_000_000, granularity="counter_delta"), 0)], COLUMNS + ", i int")
    assert abs(pricing.price(df, rates).first().est_nanos - 2_000_000_000) <= 3000  # rates are kept to a millionth of a nanodollar a token


def test_card_checks_find_problems(spark, tmp_path):
    bad = json.loads(json.dumps(CARD))
    price = bad["models"][0]["prices"][0]
    bad["models"][0]["prices"] += [price | {"effective_from": "2026-02-01T00:00:00Z"}, {"effective_from": "2025-01-01T00:00:00Z", "effective_until": "2025-01-01T00:00:00Z"}]
    bad["provider_aliases"] = {"openai": ["x"], "other": ["x"]}
    bad["models"] += [{"provider": "p", "model": "none", "prices": []}, {"provider": "p", "model": "zone", "retrieved_at": "2026-01-01", "prices": [{"effective_from": "2026-01-01T00:00:00", "input": 1}, {"effective_from": "soon", "input": 1}]}]
    rates = pricing.rate_tables(spark.createDataFrame([(json.dumps(bad),)], "value string").selectExpr(f"from_json(value, '{pricing.CARD}') AS card"))
    assert {r.problem for r in pricing.card_checks(rates).collect()} >= {"provider alias twice", "overlapping periods", "empty period", "no rate", "no prices", "date without a zone", "not a time", "no date of retrieval", "undated period"}
    path = tmp_path / "card.json"
    path.write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="not sound"):
        pricing.load_rate_card(spark, str(path))


def test_demo_card_is_sound(spark):
    assert pricing.card_checks(demo.rate_card(spark)).count() == 0


PRIVATE = ["/opt/app/x", "see ..\\a", "a/../b", "D:notes", "/etc/passwd", "/home/a/b", "~/x", "FILE:x", "..", "\\\\host\\share"]
PUBLIC = ["fine", "a..b", "https://x.org/a", "12:30", "a/b", "", "~x", None]


def test_private_strings_at_any_depth(spark):
    rows = [(i, v, [(v,)], {"k": v}) for i, v in enumerate(PRIVATE + PUBLIC)]
    schema = "n int, note string, inner array<struct<deep: string>>, named map<string, string>"
    df = spark.createDataFrame(rows, schema)
    for columns in (["n", "note"], ["n", "inner"], ["n", "named"]):
        assert sorted(r.n for r in safety.private_strings(df.select(*columns)).collect()) == list(range(len(PRIVATE)))
    assert safety.private_strings(df.select(F.col("note").alias("url"))).count() == 0
    assert safety.forbidden_keys(spark.createDataFrame([(1, 2, (3,))], "n int, session_count int, inner struct<File_Path: int>")) == ["session_count", "inner.File_Path"]


def test_payloads_are_published_only_if_clean(spark, tmp_path):
    of = lambda *x: spark.createDataFrame([(json.dumps(v) if not isinstance(v, str) else v,) for v in x], "value string")
    bad = {"a": [{"b": {"Session_Id": 1}}, ["x", ["/etc/passwd"]]], "url": "/fine", "c": {"canonical_url": "~/fine", "d": None}}
    assert sorted(map(tuple, safety.payload_problems(of(bad, "{")).collect())) == [("", "no JSON"), (".a[].b.Session_Id", "forbidden key"), (".a[][][]", "private string")]
    target = str(tmp_path / "out")
    safety.publish(of({"a": 1}), target, "a int")
    for wrong in (bad, {"a": 1, "more": 2}, {"a": "text"}):
        with pytest.raises(ValueError):
            safety.publish(of(wrong), target, "a int")
    assert [r.value for r in spark.read.text(target).collect()] == ['{"a": 1}'] and len(list(tmp_path.iterdir())) == 1
    safety.publish(of({"a": 2}), target, "a int")
    assert [r.value for r in spark.read.text(target).collect()] == ['{"a": 2}']


def test_scrub_and_contract(spark):
    df = spark.createDataFrame([(1,), (3,)], "n int")
    same, broken = safety.contract(df, df.schema, {"small": F.col("n") < 3})
    assert same and [r.n for r in broken.collect()] == [3]
    usage = ['{"a": 1, "b": "secret", "c": true, "in": {"d": 1.5, "list": [1, {"x": 2}], "reasoning": 7}}', '{"a": {"b": {"Raw_Cwd": 1, "reasoning": "text", "z": 2}}}', "[]"]
    rows = spark.createDataFrame(list(enumerate(usage)), "n int, u string").select("n", F.parse_json("u").alias("u"))
    leaves, rejected = safety.scrubbed(rows, ["n"], "u")
    assert sorted(map(tuple, leaves.collect())) == [(0, ".a", "1"), (0, ".c", "true"), (0, ".in.d", "1.5"), (0, ".in.reasoning", "7"), (1, ".a.b.z", "2")]
    assert sorted(map(tuple, rejected.collect())) == [(1, ".a.b.Raw_Cwd"), (1, ".a.b.reasoning")]
