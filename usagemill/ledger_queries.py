"""Registered queries over synced ledgers: reports over four sources, streams, merges, issues, published payloads. Logs are derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill import demo, sync
from usagemill.functions import safety
from usagemill.functions.tables import new_path
from usagemill.ledger import Ledger
from usagemill.plans import ledger_reports as reports
from usagemill.plans import reporting
from usagemill.queries import _FOLDED, NOW, SHIFT, ZONE, _folder, query, rows_of
from usagemill.streaming.ingest import sync_stream

_COUNTED = ["event_count", *reporting.STATS, "total_tokens", "cost_nanos", "cost_covered_events"]
_PI = """l AS (SELECT l_orderkey AS k, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n, CAST(l_quantity AS BIGINT) AS i, CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT) AS o FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY n) AS seq FROM l), f AS (SELECT k, line, seq, i, o FROM r WHERE seq = 1 UNION ALL SELECT f.k, f.line, r.seq, CASE WHEN r.i >= f.i AND r.o >= f.o THEN r.i ELSE f.i END, CASE WHEN r.i >= f.i AND r.o >= f.o THEN r.o ELSE f.o END FROM f JOIN r ON r.k = f.k AND r.line = f.line AND r.seq = f.seq + 1)"""
_ALL = (
    demo.ctes("counter", "snapshot") + ", " + _FOLDED.format(where="TRUE") + ", " + _PI + f""",
first AS (SELECT owner, fp, min(observed_at) AS seen FROM b GROUP BY ALL),
every AS (
  SELECT 'codex' AS source, '(unknown)' AS model, seen * 1000000000 AS ns, coalesce(t['i'], 0) AS input_tokens, coalesce(t['o'], 0) AS output_tokens, 0 AS cache_read_tokens, 0 AS cache_write_tokens, 0 AS reasoning_tokens, CAST(NULL AS BIGINT) AS cost FROM w JOIN first USING (owner, fp) WHERE greatest(coalesce(t['i'], 0), coalesce(t['o'], 0)) > 0
  UNION ALL SELECT 'claude', 'model', NULL, coalesce(max(input_tokens), 0), coalesce(max(output_tokens), 0), 0, 0, 0, NULL FROM v_snapshot WHERE seq % 5 <> 4 GROUP BY message
  UNION ALL SELECT 'pi', 'm', NULL, arg_max(i, seq), arg_max(o, seq), 0, 0, 0, (SELECT max(i) FROM r WHERE r.k = f.k AND r.line = f.line) * 1000000 FROM f GROUP BY k, line
  UNION ALL SELECT 'opencode', 'm', CAST(floor(epoch(o_orderdate)) AS BIGINT) * 1000000, CAST(l_quantity AS BIGINT), l_linenumber + 1, 0, 0, 1, NULL FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber % 2 = 1
  UNION ALL SELECT 'opencode', 'm', CAST(floor(epoch(o_orderdate)) AS BIGINT) * 1000000, o_orderkey % 1000, 1, 2, 3, 0, NULL FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 1)),
dated AS (SELECT *, input_tokens + output_tokens + cache_read_tokens + cache_write_tokens AS tokens, coalesce(CAST(DATE '1970-01-01' + CAST(floor((floor(ns / 1e9) + {SHIFT}) / 86400) AS INTEGER) AS VARCHAR), '(unknown)') AS day FROM every)"""
)
_GROUPED = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS usage_group, count(*) AS event_count, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in reporting.STATS) + f", CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(cost) AS BIGINT) AS cost_nanos, count(cost) AS cost_covered_events FROM dated GROUP BY {d}"
    for d in ("source", "model", "day")
)


def _four_sources(spark: SparkSession, sf_dir: str) -> Ledger:
    """A ledger after a sync of all four sources."""
    ledger, inputs = Ledger(spark, new_path(spark, "ledger")), {}
    for source, logs in (("codex", demo.codex_logs), ("claude", demo.claude_logs), ("pi", demo.pi_logs)):
        inputs[source] = [_folder(spark)]
        demo.write_logs(logs(spark, sf_dir), inputs[source][0])
    sync.sync_all(spark, ledger, inputs | {"opencode": demo.opencode_tables(spark, sf_dir)}, strict=True)
    return ledger


@query("a13_ledger_reports", f"{_ALL} {_GROUPED}")
def a13_ledger_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C3, E3-E5 over a ledger of four synced sources."""
    ledger = _four_sources(spark, sf_dir)
    found = [reports.stats(ledger, d, ZONE).select(F.lit(d).alias("dimension"), "usage_group", *_COUNTED) for d in ("source", "model", "day")]
    return reduce(DataFrame.unionByName, found)


@query(
    "i5_stream_sync",
    demo.ctes("counter") + ", " + _FOLDED.format(where="TRUE").replace("SELECT *, ordinal % 7 = 0 AS phase", "SELECT *, FALSE AS phase")
    + " SELECT CAST(owner AS VARCHAR) AS owner, CASE WHEN greatest(coalesce(t['i'], 0), coalesce(t['o'], 0)) > 0 THEN 'canonical' ELSE 'excluded' END AS status, count(*) AS events, CAST(sum(t['i']) AS BIGINT) AS input_tokens, CAST(2 AS BIGINT) AS version FROM w GROUP BY ALL",
)
def i5_stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder whose files come in two micro-batches, each one commit; a third run finds nothing."""
    zone, check, ledger = _folder(spark), new_path(spark, "check"), Ledger(spark, new_path(spark, "ledger"))
    rows = demo.codex_lines(spark, sf_dir).withColumns({"artifact": F.substring_index("file", "/", 1), "owner": F.substring_index("file", "/", -1).cast("long")})
    logs = rows.select(F.concat_ws("-", "artifact", (F.col("owner") % demo.SHARDS).cast("string")).alias("log"), F.struct("owner", "ordinal").alias("place"), "line")
    for part in (F.col("log") < "2", F.col("log") >= "2", None):
        if part is not None:
            demo.write_logs(logs.where(part), zone)
        sync_stream(spark, ledger, "codex", zone, check).awaitTermination()
    found = sync.events(ledger, "codex").groupBy(F.col("source_session_id").alias("owner"), "status").agg(F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens"))
    return found.withColumn("version", F.lit(ledger.version()).cast("long"))


@query(
    "d23_lasting_merges",
    demo.ctes("snapshot")
    + """, e AS (SELECT message, max(input_tokens) AS i, max(output_tokens) AS o FROM v_snapshot WHERE seq % 5 <> 4 GROUP BY message), p AS (SELECT a.message AS survivor, b.message AS absorbed FROM e a JOIN e b ON b.message = a.message + 1 WHERE a.message % 3 = 0)
SELECT 'claude:m' || e.message AS event_key, CASE WHEN p.survivor IS NULL THEN 'canonical' ELSE 'excluded' END AS status, 'claude:m' || p.survivor AS merged_into, coalesce(e.i, g.i) AS input_tokens, coalesce(e.o, g.o) AS output_tokens FROM e LEFT JOIN p ON p.absorbed = e.message LEFT JOIN p q ON q.survivor = e.message LEFT JOIN e g ON g.message = q.absorbed""",
)
def d23_lasting_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message absorbs the next one; the merges hold after a sync that touches all messages, and after a rebuild."""
    ledger, folder = Ledger(spark, new_path(spark, "ledger")), _folder(spark)
    logs = demo.claude_logs(spark, sf_dir)
    demo.write_logs(logs.where("place.ordinal % 5 <> 0"), folder)
    demo.write_logs(logs.where("place.ordinal % 5 = 0"), late := _folder(spark))
    sync.sync(spark, ledger, "claude", [folder, late])
    number = F.substring("evidence_key", 2, 20).cast("long")
    known = sync.events(ledger, "claude").select("event_key", number.alias("n"))
    pairs = known.where("n % 3 = 0").select(F.col("event_key").alias("survivor"), (F.col("n") + 1).alias("n")).join(known.withColumnRenamed("event_key", "absorbed"), "n")
    sync.merge(ledger, "claude", pairs.select("survivor", "absorbed"))
    demo.write_logs(logs, folder)
    sync.sync(spark, ledger, "claude", [folder, late])
    sync.rebuild(spark, ledger, ["claude"])
    return sync.events(ledger, "claude").select("event_key", "status", "merged_into", "input_tokens", "output_tokens")


@query("d24_issue_validity", demo.ctes("snapshot") + " SELECT CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS opened, CAST(NULL AS BIGINT) AS resolved, 'invalid_usage' AS category, count(*) AS issues FROM v_snapshot WHERE seq % 5 = 4 GROUP BY ALL")
def d24_issue_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the version that found them; a later sync of appended lines opens its own and repeats none."""
    ledger, folder = Ledger(spark, new_path(spark, "ledger")), _folder(spark)
    logs = demo.claude_logs(spark, sf_dir).withColumn("place", F.struct((F.col("place.ordinal") % 3 == 0).alias("late"), "place.message", "place.ordinal"))
    for rows in (logs.where("NOT place.late"), logs, logs):
        demo.write_logs(rows, folder)
        sync.sync(spark, ledger, "claude", [folder])
    return reports.entity(ledger, "issues").groupBy("opened", "resolved", "category").agg(F.count(F.lit(1)).alias("issues"))


_STRINGS = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '/opt/' || o_orderpriority WHEN 1 THEN 'see ..' || chr(92) || o_orderpriority WHEN 2 THEN 'a/../' || o_orderpriority WHEN 3 THEN 'D:' || o_orderpriority WHEN 4 THEN o_orderpriority WHEN 5 THEN '~/' || o_orderpriority WHEN 6 THEN 'FILE:' || o_orderpriority ELSE 'https://a/' || o_orderpriority END AS note,
  CASE o_orderkey % 5 WHEN 0 THEN 'Session_Count' WHEN 1 THEN 'file_path' WHEN 2 THEN 'tokens' WHEN 3 THEN 'urls' ELSE 'rerun_identity' END AS field FROM """


@query("k2_private_strings", f"WITH s AS ({_STRINGS} orders) SELECT id FROM s WHERE note[1] = '/' OR note[2] = ':' OR contains(note, chr(92)) OR contains(note, '/../') OR lower(note) LIKE 'file:%' OR note LIKE '~/%'")
def k2_private_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a local address two levels down; and none in the export."""
    rows = spark.sql(_STRINGS + f"parquet.`{sf_dir}/orders.parquet`").select("id", F.array(F.struct(F.lit("fine").alias("a"), F.col("note").alias("b"))).alias("inner"), F.struct(F.col("note").alias("url")).alias("address"))
    assert not safety.payload_problems(reporting.export_payload(rows_of(spark, sf_dir), ZONE, NOW.isoformat())).where("problem <> 'forbidden key' OR place NOT LIKE '%event_count'").count()
    return safety.private_strings(rows).select("id")


@query(
    "k1_payload_problems",
    f"""WITH s AS ({_STRINGS} orders), p AS (SELECT field, note[1] = '/' OR note[2] = ':' OR contains(note, chr(92)) OR contains(note, '/../') OR lower(note) LIKE 'file:%' OR note LIKE '~/%' AS private FROM s)
SELECT '.rows[].' || field AS place, 'forbidden key' AS problem, count(*) AS n FROM p WHERE field IN ('Session_Count', 'file_path', 'rerun_identity') GROUP BY ALL UNION ALL SELECT '.rows[].' || field, 'private string', count(*) FROM p WHERE private AND field NOT IN ('Session_Count', 'file_path', 'rerun_identity') GROUP BY ALL""",
)
def k1_payload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a forbidden part and private strings in JSON payloads, one for each order."""
    rows = spark.sql(_STRINGS + f"parquet.`{sf_dir}/orders.parquet`")
    payload = F.to_json(F.struct(F.array(F.create_map("field", "note")).alias("rows")))
    return safety.payload_problems(rows.select(payload.alias("value"))).groupBy("place", "problem").agg(F.count(F.lit(1)).alias("n"))
