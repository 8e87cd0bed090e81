"""The registered queries of the accounting operators over the driver's tables, each with the SQL that it has to equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill import demo, sync
from usagemill.functions import tokens
from usagemill.functions.models import creator, family
from usagemill.functions.tables import new_path, removed, written
from usagemill.ledger import Ledger, dangling, merge_events
from usagemill.operators import evidence, lineage, reconcile
from usagemill.plans import pricing, profile, reporting
from usagemill.sources import claude, codex, opencode, pi
from usagemill.sources.lines import MANIFEST, corrupt_gate, latest_generation, lines, listing, next_manifest, read_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ZONE, TZ, SHIFT = "+05:30", timezone(timedelta(hours=5, minutes=30)), 19_800
NOW, DAYS = datetime(2001, 10, 30, 12, tzinfo=UTC), 28
END = NOW.astimezone(TZ).date()
FIRST = END - timedelta(days=DAYS - 1)
LO, HI = tokens.window_bounds(DAYS, TZ, NOW)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- the same rows on both sides -----------------------------------------------------------------------------------------


def rows_of(spark: SparkSession, sf_dir: str, agent_key: bool = False, window: tuple[int, int] | None = None) -> DataFrame:
    return reporting.reporting(*(demo.view(spark, sf_dir, n) for n in ("usage", "runs", "sessions")), agent_key=agent_key, window=window)


def measured_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.measured(rows_of(spark, sf_dir, True), ZONE)


def recent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.measured(rows_of(spark, sf_dir, True, (LO, HI)), ZONE)


def condensed_recent_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.condensed(recent_of(spark, sf_dir))


def condensed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.condensed(measured_of(spark, sf_dir), (LO, HI))


USAGE = demo.ctes("usage") + ", c AS (SELECT * FROM v_usage WHERE status IN ('canonical', 'provisional')) "
ROWS = (
    demo.ctes("usage", "runs", "sessions")
    + f""", t AS (
SELECT e.source, e.granularity, coalesce(e.provider, r.provider, s.provider) AS provider, coalesce(e.response_model, e.model, r.model, s.current_model, s.initial_model, '(unknown)') AS resolved_model,
  coalesce(e.model, r.model, s.current_model, s.initial_model) AS requested_model,
  coalesce(e.started_at_ns, e.completed_at_ns, r.started_at_ns, r.completed_at_ns, s.started_at_ns, s.updated_at_ns, s.completed_at_ns) AS occurred_at_ns,
  e.input_tokens, e.output_tokens, e.cache_read_tokens, e.cache_write_tokens, e.cache_write_5m_tokens, e.cache_write_1h_tokens, e.reasoning_tokens, e.reported_total_tokens, e.derived_total_tokens, e.total_cost_nanos,
  coalesce(e.service_tier, s.service_tier) AS service_tier, e.speed, e.inference_region,
  CASE WHEN r.parent_run_id IS NOT NULL THEN e.source || ':run:' || e.source_run_id WHEN coalesce(e.source_session_id, r.source_session_id) IS NOT NULL THEN e.source || ':session:' || coalesce(e.source_session_id, r.source_session_id) END AS agent_key,
  coalesce(e.reported_total_tokens, e.derived_total_tokens, coalesce(e.input_tokens, 0) + coalesce(e.output_tokens, 0) + coalesce(e.cache_write_tokens, 0) + CASE WHEN e.source = 'codex' THEN 0 ELSE coalesce(e.cache_read_tokens, 0) END) AS tokens
FROM v_usage e LEFT JOIN v_runs r ON r.source_run_id = e.source_run_id LEFT JOIN v_sessions s ON s.source_session_id = coalesce(e.source_session_id, r.source_session_id)
WHERE e.status IN ('canonical', 'provisional')
), m AS (
SELECT source, resolved_model AS model, CASE lower(trim(provider)) WHEN 'openai' THEN 'openai' WHEN 'anthropic' THEN 'anthropic' WHEN 'google' THEN 'google' END AS creator, agent_key, occurred_at_ns,
  DATE '1970-01-01' + CAST(floor((floor(occurred_at_ns / 1e9) + {SHIFT}) / 86400) AS INTEGER) AS day, tokens FROM t
), w AS (SELECT * FROM m WHERE occurred_at_ns >= {LO} AND occurred_at_ns < {HI}), a AS (SELECT * FROM w WHERE agent_key IS NOT NULL AND tokens > 0) """
)
_STATS = "CAST(count(*) AS BIGINT) AS event_count, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in reporting.STATS) + ", CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, CAST(sum(total_cost_nanos) AS BIGINT) AS cost_nanos, count(total_cost_nanos) AS cost_covered_events"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [*tokens.TOKENS, "total_cost_nanos"])
_DAY = "coalesce(CAST(day AS VARCHAR), '(unknown)')"
_TM = ROWS + f", d AS (SELECT t.*, DATE '1970-01-01' + CAST(floor((floor(occurred_at_ns / 1e9) + {SHIFT}) / 86400) AS INTEGER) AS day FROM t) "


# ---- reporting -----------------------------------------------------------------------------------------------------------

for _d in reporting.DIMENSIONS:
    QUERIES[f"e1_totals_by_{_d}"] = lambda spark, sf_dir, d=_d: reporting.totals_by(demo.view(spark, sf_dir, "usage"), d)
    ORACLES[f"e1_totals_by_{_d}"] = USAGE + f"SELECT {_d} AS group_value, {_SUMS} FROM c GROUP BY {_d}"

QUERIES["e1_totals"] = lambda spark, sf_dir: reporting.totals_by(demo.view(spark, sf_dir, "usage"))
ORACLES["e1_totals"] = USAGE + f"SELECT {_SUMS}, CAST(NULL AS VARCHAR) AS group_value FROM c HAVING count(*) > 0"
QUERIES["e1_totals_by_all_dimensions"] = lambda spark, sf_dir: reporting.totals_by_all(demo.view(spark, sf_dir, "usage"))
ORACLES["e1_totals_by_all_dimensions"] = USAGE + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS group_value, {_SUMS} FROM c GROUP BY {d}" for d in reporting.DIMENSIONS)
QUERIES["e2_source_total"] = lambda spark, sf_dir: reporting.source_total(demo.view(spark, sf_dir, "usage"), "pi")
ORACLES["e2_source_total"] = USAGE + f"SELECT {_SUMS}, 'pi' AS group_value FROM c WHERE source = 'pi'"

for _n, _g, _c in (("e3_usage_by_source", "source", "source"), ("e4_usage_by_model", "model", "resolved_model"), ("e5_usage_by_day", "day", _DAY)):
    QUERIES[_n] = lambda spark, sf_dir, g=_g: reporting.usage_stats(rows_of(spark, sf_dir), g, ZONE)
    ORACLES[_n] = _TM + f"SELECT {_c} AS usage_group, {_STATS} FROM d GROUP BY 1"
QUERIES["b29_report_window"] = lambda spark, sf_dir: reporting.usage_stats(rows_of(spark, sf_dir, window=(LO, HI)), "day", ZONE)
ORACLES["b29_report_window"] = _TM + f"SELECT {_DAY} AS usage_group, {_STATS} FROM d WHERE occurred_at_ns >= {LO} AND occurred_at_ns < {HI} GROUP BY 1"
QUERIES["e6_usage_overall"] = lambda spark, sf_dir: reporting.usage_overall(rows_of(spark, sf_dir))
ORACLES["e6_usage_overall"] = _TM + f"SELECT 'all' AS usage_group, {_STATS} FROM d"
QUERIES["b30_visible"] = lambda spark, sf_dir: reporting.visible(reporting.usage_stats(rows_of(spark, sf_dir), "model", ZONE))
ORACLES["b30_visible"] = _TM + f"SELECT resolved_model AS usage_group, {_STATS} FROM d GROUP BY 1 HAVING sum(tokens) > 0"
QUERIES["c1_reporting_rows"] = lambda spark, sf_dir: rows_of(spark, sf_dir, True)
ORACLES["c1_reporting_rows"] = ROWS + "SELECT t.* EXCLUDE (tokens) FROM t"
QUERIES["b27_counted"] = lambda spark, sf_dir: demo.view(spark, sf_dir, "usage").where(tokens.counted()).groupBy("source", "status").agg(F.count(F.lit(1)).alias("events"))
ORACLES["b27_counted"] = USAGE + "SELECT source, status, count(*) AS events FROM c GROUP BY ALL"
QUERIES["b28_event_total"] = lambda spark, sf_dir: rows_of(spark, sf_dir).select("source", "resolved_model", "occurred_at_ns", tokens.event_total().alias("tokens"))
ORACLES["b28_event_total"] = ROWS + "SELECT source, resolved_model, occurred_at_ns, CAST(tokens AS BIGINT) AS tokens FROM t"
QUERIES["e21_counts"] = lambda spark, sf_dir: demo.view(spark, sf_dir, "usage").groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("source_session_id", "source_run_id").alias("keys"))
ORACLES["e21_counts"] = demo.ctes("usage") + " SELECT source, count(*) AS events, count(DISTINCT CASE WHEN source_session_id IS NOT NULL AND source_run_id IS NOT NULL THEN source_session_id || '|' || source_run_id END) AS keys FROM v_usage GROUP BY source"


_GROUPED = ", ".join(f"x_{k} AS (SELECT {g} AS \"group\", count(*) AS event_count, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM d GROUP BY 1)" for k, g in (("source", "source"), ("model", "resolved_model"), ("day", _DAY), ("overall", "'all'")))
_LISTED = ", ".join(f"'by_{k}': coalesce((SELECT list({{'group': \"group\", 'event_count': event_count, 'total_tokens': total_tokens}} ORDER BY \"group\") FROM x_{k}), [])" for k in ("source", "model", "day"))


@query("a14_export_json", _TM + f", {_GROUPED} SELECT CAST(to_json({{'generated_at': '{NOW.isoformat()}', 'timezone': '{ZONE}', 'overall': (SELECT {{'group': \"group\", 'event_count': event_count, 'total_tokens': total_tokens}} FROM x_overall), {_LISTED}}}) AS VARCHAR) AS value")
def a14_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.export_payload(rows_of(spark, sf_dir), ZONE, NOW.isoformat())


# ---- pricing -------------------------------------------------------------------------------------------------------------

_CARD = """, mk(provider, mid, alias) AS (VALUES ('openai', 'o', 'economy'), ('openai', 'o', 'promo'), ('anthropic', 'a', 'economy'), ('google', 'g', 'standard'), ('google', 'g', 'brand#2'), ('google', 'g', 'medium')),
uq AS (SELECT alias, min(provider) AS provider, min(mid) AS mid FROM mk GROUP BY alias HAVING count(*) = 1),
pp(mid, lo, hi, i, c, w, w5, w1, o, lc, li, lcc, lw, lw5, lw1, lo2) AS (VALUES
  ('o', DATE '1990-01-01', DATE '1998-01-01', 1000, 100, 1250, 1500, 2000, 4000, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('o', DATE '1998-01-01', NULL, 2000, 200, 3000, 4000, 5000, 10000, 2500, 4000, 400, 6000, 8000, 10000, 15000),
  ('a', DATE '1990-01-01', NULL, 3000, 300, 3750, 3750, NULL, 15000, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('g', DATE '1996-01-01', DATE '2001-01-01', 500, NULL, NULL, NULL, NULL, 2000, NULL, NULL, NULL, NULL, NULL, NULL, NULL)),
q AS (SELECT *, coalesce(lower(trim(provider)), CASE source WHEN 'codex' THEN 'openai' WHEN 'claude' THEN 'anthropic' END) AS own,
  coalesce(input_tokens, 0) - CASE WHEN source = 'codex' THEN coalesce(cache_read_tokens, 0) ELSE 0 END AS ti, coalesce(cache_read_tokens, 0) AS tc,
  coalesce(cache_write_tokens, 0) - coalesce(cache_write_5m_tokens, 0) - coalesce(cache_write_1h_tokens, 0) AS tw, coalesce(cache_write_5m_tokens, 0) AS t5, coalesce(cache_write_1h_tokens, 0) AS t1, coalesce(output_tokens, 0) AS tout FROM t),
x AS (SELECT q.*, coalesce(a1.mid, u1.mid, a2.mid, u2.mid) AS mid, coalesce(a1.provider, u1.provider, a2.provider, u2.provider) AS mp FROM q
  LEFT JOIN mk a1 ON a1.provider = own AND a1.alias = lower(trim(resolved_model)) LEFT JOIN uq u1 ON own IS NULL AND u1.alias = lower(trim(resolved_model))
  LEFT JOIN mk a2 ON a2.provider = own AND a2.alias = lower(trim(requested_model)) LEFT JOIN uq u2 ON own IS NULL AND u2.alias = lower(trim(requested_model))),
y AS (SELECT x.*, p.* EXCLUDE (mid), p.mid AS priced_by, granularity = 'model_call' AND coalesce(ti + tc + tw + t5 + t1 > lc, FALSE) AS is_long,
  coalesce(list_distinct(list_filter([lower(trim(speed)), lower(trim(service_tier))], lambda v: v IS NOT NULL AND v NOT IN ('auto', 'default', 'not_available', 'standard'))), []) AS tiers,
  CASE WHEN inference_region IS NULL OR inference_region IN ('global') THEN 1.0 WHEN p.mid = 'o' AND lo >= DATE '1998-01-01' THEN 1.1 WHEN p.mid = 'a' THEN 1.25 END AS region,
  CASE WHEN p.mid = 'o' AND lo >= DATE '1998-01-01' AND (CAST(floor(floor(occurred_at_ns / 1e9) / 86400) AS BIGINT) + 3) % 7 IN (0, 1, 2) AND CAST(floor(occurred_at_ns / 1e9) AS BIGINT) % 86400 < 28800 THEN 0.5 ELSE 1.0 END AS timed
  FROM x LEFT JOIN pp p ON p.mid = x.mid AND occurred_at_ns >= epoch(lo) * 1000000000 AND (hi IS NULL OR occurred_at_ns < epoch(hi) * 1000000000)),
z AS (SELECT y.*, CASE WHEN len(tiers) = 0 THEN 1.0 WHEN len(tiers) = 1 THEN CASE WHEN mid = 'o' AND lo >= DATE '1998-01-01' THEN CASE tiers[1] WHEN 'fast' THEN 2.0 WHEN 'priority' THEN 1.5 END WHEN mid = 'a' THEN CASE tiers[1] WHEN 'priority' THEN 2.0 END END END AS tier,
  CASE WHEN is_long THEN ti * li + tc * lcc + tw * lw + t5 * lw5 + t1 * lw1 + tout * lo2 ELSE
    CASE WHEN (ti <> 0 AND i IS NULL) OR (tc <> 0 AND c IS NULL) OR (tw <> 0 AND w IS NULL) OR (t5 <> 0 AND w5 IS NULL) OR (t1 <> 0 AND w1 IS NULL) OR (tout <> 0 AND o IS NULL) THEN NULL
    ELSE ti * coalesce(i, 0) + tc * coalesce(c, 0) + tw * coalesce(w, 0) + t5 * coalesce(w5, 0) + t1 * coalesce(w1, 0) + tout * coalesce(o, 0) END END AS base FROM y),
e AS (SELECT z.*, CASE WHEN total_cost_nanos IS NOT NULL THEN total_cost_nanos
  WHEN priced_by IS NOT NULL AND tw >= 0 AND ti >= 0 AND ti + tc + tw + t5 + t1 + tout = tokens THEN CAST(floor(CAST(base AS DECIMAL(20, 2)) * CAST(tier * region * timed AS DECIMAL(10, 4)) + 0.5) AS BIGINT) END AS est,
  CASE WHEN total_cost_nanos IS NOT NULL THEN coalesce(lower(trim(provider)), source) ELSE mp END AS payer FROM z) """


def priced_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a table: joined with the rates in one stage, the generated code would be too long to be compiled
    return pricing.price(written(rows_of(spark, sf_dir)), demo.rate_card(spark))


QUERIES["e7_api_value"] = lambda spark, sf_dir: pricing.api_value(priced_of(spark, sf_dir))
ORACLES["e7_api_value"] = ROWS + _CARD + """SELECT CAST(coalesce(sum(est), 0) AS BIGINT) AS cost_nanos, CAST(coalesce(sum(tokens) FILTER (WHERE est IS NOT NULL), 0) AS BIGINT) AS priced_tokens, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
  count(est) AS priced_events, count(*) AS total_events, sum(tokens) > 0 AND sum(tokens) FILTER (WHERE est IS NOT NULL) * 100 >= sum(tokens) * 95 AS shown FROM e"""
QUERIES["e8_api_value_by_provider"] = lambda spark, sf_dir: pricing.api_value_by_provider(priced_of(spark, sf_dir))
ORACLES["e8_api_value_by_provider"] = ROWS + _CARD + "SELECT payer AS provider, CAST(sum(est) AS BIGINT) AS cost_nanos, CAST(sum(tokens) AS BIGINT) AS priced_tokens, count(*) AS priced_events FROM e WHERE est IS NOT NULL GROUP BY 1"
QUERIES["g_priced_rows"] = lambda spark, sf_dir: priced_of(spark, sf_dir).select("source", "resolved_model", "occurred_at_ns", "input_tokens", "output_tokens", "est_provider", "est_nanos")
ORACLES["g_priced_rows"] = ROWS + _CARD + "SELECT source, resolved_model, occurred_at_ns, input_tokens, output_tokens, CASE WHEN est IS NOT NULL THEN payer END AS est_provider, est AS est_nanos FROM e"

# ---- profile -------------------------------------------------------------------------------------------------------------

QUERIES["e9_profile_totals"] = lambda spark, sf_dir: profile.totals(measured_of(spark, sf_dir), (LO, HI))
ORACLES["e9_profile_totals"] = ROWS + "SELECT CAST((SELECT coalesce(sum(tokens), 0) FROM w) AS BIGINT) AS total_tokens, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS all_time_tokens FROM m"
_PRIMARY = ", pm AS (SELECT model, creator FROM (SELECT model, creator, row_number() OVER (PARTITION BY model ORDER BY sum(tokens) DESC, creator) AS k FROM w WHERE tokens > 0 AND creator IS NOT NULL GROUP BY model, creator) WHERE k = 1) "
QUERIES["e10_model_totals"] = lambda spark, sf_dir: profile.model_totals(condensed_recent_of(spark, sf_dir))
ORACLES["e10_model_totals"] = ROWS + _PRIMARY + "SELECT w.model, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(pm.creator) AS creator FROM w LEFT JOIN pm ON pm.model = w.model GROUP BY w.model HAVING sum(tokens) > 0"
QUERIES["e11_primary_provider"] = lambda spark, sf_dir: profile.primary_provider(recent_of(spark, sf_dir))
ORACLES["e11_primary_provider"] = ROWS + _PRIMARY + "SELECT model, creator FROM pm"
QUERIES["e12_harness_totals"] = lambda spark, sf_dir: profile.harness_totals(recent_of(spark, sf_dir))
ORACLES["e12_harness_totals"] = ROWS + "SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM w GROUP BY source HAVING sum(tokens) > 0"
QUERIES["e13_agent_count"] = lambda spark, sf_dir: profile.agent_count(recent_of(spark, sf_dir))
ORACLES["e13_agent_count"] = ROWS + "SELECT count(DISTINCT agent_key) AS agents FROM a"
_AGENT = ", ag AS (SELECT agent_key, model FROM (SELECT agent_key, model, row_number() OVER (PARTITION BY agent_key ORDER BY sum(tokens) DESC, model) AS k FROM a GROUP BY agent_key, model) WHERE k = 1) "
QUERIES["e14_agent_primary_model"] = lambda spark, sf_dir: profile.agents_by_model(recent_of(spark, sf_dir))
ORACLES["e14_agent_primary_model"] = ROWS + _AGENT + "SELECT model, count(*) AS agents FROM ag GROUP BY model"
_SPINE = lambda first, days: f"SELECT DATE '{first}' + CAST(i AS INTEGER) AS day FROM range({days}) r(i)"
QUERIES["e15_daily_tokens"] = lambda spark, sf_dir: profile.daily_tokens(condensed_recent_of(spark, sf_dir), FIRST, DAYS).select("day", "tokens", F.size("models").alias("models"), F.get("models", F.lit(0)).model.alias("first_model"), F.get("models", F.lit(0)).creator.alias("first_creator"))
_DAILY = """, dm AS (SELECT day, model, sum(tokens) AS t FROM {rows} GROUP BY day, model HAVING sum(tokens) > 0), dp AS (SELECT day, model, creator FROM (SELECT day, model, creator, row_number() OVER (PARTITION BY day, model ORDER BY sum(tokens) DESC, creator) AS k FROM {rows} WHERE tokens > 0 AND creator IS NOT NULL GROUP BY day, model, creator) WHERE k = 1),
dt AS (SELECT day, sum(tokens) AS t FROM {rows} GROUP BY day), top AS (SELECT dm.day, dm.model, dp.creator, count(*) OVER (PARTITION BY dm.day) AS n, row_number() OVER (PARTITION BY dm.day ORDER BY dm.t DESC, dm.model) AS k FROM dm LEFT JOIN dp ON dp.day = dm.day AND dp.model = dm.model)
SELECT s.day, CAST(coalesce(dt.t, 0) AS BIGINT) AS tokens, CAST(coalesce(top.n, 0) AS INTEGER) AS models, top.model AS first_model, top.creator AS first_creator FROM ({spine}) s LEFT JOIN dt ON dt.day = s.day LEFT JOIN top ON top.day = s.day AND top.k = 1"""
ORACLES["e15_daily_tokens"] = ROWS + _DAILY.format(rows="w", spine=_SPINE(FIRST, DAYS))
_YEAR = END - timedelta(days=profile.ACTIVITY_DAYS - 1)
QUERIES["e16_activity_364"] = lambda spark, sf_dir: profile.daily_tokens(condensed_of(spark, sf_dir), _YEAR, profile.ACTIVITY_DAYS).select("day", "tokens", F.size("models").alias("models"), F.get("models", F.lit(0)).model.alias("first_model"), F.get("models", F.lit(0)).creator.alias("first_creator"))
ORACLES["e16_activity_364"] = ROWS + _DAILY.format(rows="m", spine=_SPINE(_YEAR, profile.ACTIVITY_DAYS))
QUERIES["e17_daily_agents"] = lambda spark, sf_dir: profile.daily_agents(condensed_recent_of(spark, sf_dir), FIRST, DAYS).select("day", "agents", F.size("models").alias("models"), F.get("models", F.lit(0)).model.alias("first_model"))
ORACLES["e17_daily_agents"] = ROWS + _AGENT + f""", dd AS (SELECT DISTINCT day, agent_key FROM a), dn AS (SELECT day, model, count(*) AS n FROM dd JOIN ag USING (agent_key) GROUP BY day, model),
dk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, model) AS k, sum(n) OVER (PARTITION BY day) AS total, count(*) OVER (PARTITION BY day) AS models FROM dn)
SELECT s.day, CAST(coalesce(dk.total, 0) AS BIGINT) AS agents, CAST(coalesce(dk.models, 0) AS INTEGER) AS models, dk.model AS first_model FROM ({_SPINE(FIRST, DAYS)}) s LEFT JOIN dk ON dk.day = s.day AND dk.k = 1"""
QUERIES["e18_peak_usage"] = lambda spark, sf_dir: profile.peak(condensed_recent_of(spark, sf_dir))
ORACLES["e18_peak_usage"] = ROWS + "SELECT CAST((SELECT coalesce(max(t), 0) FROM (SELECT sum(tokens) AS t FROM w GROUP BY day)) AS BIGINT) AS peak_usage, (SELECT count(*) FROM (SELECT model FROM w GROUP BY model HAVING sum(tokens) > 0)) AS model_count, (SELECT min(day) FROM w) AS first_tracked_day"
QUERIES["e19_group_small"] = lambda spark, sf_dir: profile.daily_tokens(condensed_recent_of(spark, sf_dir), FIRST, DAYS).select("day", F.explode_outer(profile.group_small(F.col("models"), F.col("tokens"), "tokens")).alias("x")).select("day", "x.name", "x.tokens")
ORACLES["e19_group_small"] = ROWS + f""", dm AS (SELECT day, model, sum(tokens) AS t, sum(sum(tokens)) OVER (PARTITION BY day) AS total FROM w GROUP BY day, model),
g AS (SELECT day, CASE WHEN t * 100 < total * 5 THEN 'other models' ELSE CASE WHEN model = '(unknown)' THEN 'unknown models' ELSE model END END AS name, sum(t) AS t FROM dm WHERE t > 0 GROUP BY ALL)
SELECT s.day, g.name, CAST(g.t AS BIGINT) AS tokens FROM ({_SPINE(FIRST, DAYS)}) s LEFT JOIN g ON g.day = s.day"""
QUERIES["e20_awards"] = lambda spark, sf_dir: profile.awards(condensed_of(spark, sf_dir))
ORACLES["e20_awards"] = ROWS + """, u AS (SELECT * FROM m WHERE tokens > 0), bd AS (SELECT day, sum(tokens) AS t, count(DISTINCT agent_key) AS n FROM u WHERE day IS NOT NULL GROUP BY day),
ad AS (SELECT DISTINCT day FROM u WHERE day IS NOT NULL AND agent_key IS NOT NULL), isl AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS i FROM ad), pl AS (SELECT day, row_number() OVER (PARTITION BY i ORDER BY day) AS p FROM isl)
SELECT 'ten-billion' AS key, CAST(sum(tokens) AS BIGINT) AS metric_value, CAST(NULL AS DATE) AS earned_on FROM m HAVING sum(tokens) >= 10000000000
UNION ALL SELECT * FROM (SELECT 'billion-day', CAST(t AS BIGINT), day FROM bd WHERE t >= 1000000000 ORDER BY day LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'fleet-commander', CAST(n AS BIGINT), day FROM bd WHERE n >= 250 ORDER BY day LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'hot-streak', CAST(14 AS BIGINT), day FROM pl WHERE p >= 14 ORDER BY day LIMIT 1)
UNION ALL SELECT 'model-collector', count(DISTINCT model), NULL FROM u HAVING count(DISTINCT model) >= 10
UNION ALL SELECT 'all-systems-go', count(DISTINCT source), NULL FROM u HAVING count(DISTINCT source) >= 4"""
QUERIES["e22_conservation_check"] = lambda spark, sf_dir: profile.conservation_check(condensed_recent_of(spark, sf_dir), FIRST, DAYS).agg(F.count(F.lit(1)).alias("days_off"))
ORACLES["e22_conservation_check"] = "SELECT CAST(0 AS BIGINT) AS days_off"
QUERIES["f4_longest_streak"] = lambda spark, sf_dir: profile.longest_streak(recent_of(spark, sf_dir))
ORACLES["f4_longest_streak"] = ROWS + ", ad AS (SELECT DISTINCT day FROM a), isl AS (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS i FROM ad) SELECT CAST(coalesce(max(n), 0) AS INTEGER) AS longest_streak FROM (SELECT count(*) AS n FROM isl GROUP BY i)"
QUERIES["f7_activity_level"] = lambda spark, sf_dir: profile.activity_levels(profile.daily_tokens(condensed_of(spark, sf_dir), _YEAR, profile.ACTIVITY_DAYS))
_LEVELS = f""", dt AS (SELECT day, sum(tokens) AS t FROM m WHERE day BETWEEN DATE '{_YEAR}' AND DATE '{END}' GROUP BY day HAVING sum(tokens) > 0), rk AS (SELECT *, row_number() OVER (ORDER BY t, day) - 1 AS i, count(*) OVER () AS n FROM dt),
ct AS (SELECT max(t) FILTER (WHERE i = least(n - 1, n // 4)) AS c1, max(t) FILTER (WHERE i = least(n - 1, n * 2 // 4)) AS c2, max(t) FILTER (WHERE i = least(n - 1, n * 3 // 4)) AS c3 FROM rk),
lv AS (SELECT day, CAST(least(4, 1 + CAST(t >= c1 AS INTEGER) + CAST(t >= c2 AS INTEGER) + CAST(t >= c3 AS INTEGER)) AS INTEGER) AS level FROM dt, ct) """
ORACLES["f7_activity_level"] = ROWS + _LEVELS + "SELECT day, level FROM lv"
QUERIES["f10_activity_state"] = lambda spark, sf_dir: (lambda m: profile.activity(profile.daily_tokens(m, _YEAR, profile.ACTIVITY_DAYS), m.agg(F.min("day").alias("first_tracked_day"))).select("day", "tokens", "state", "level"))(condensed_of(spark, sf_dir))
ORACLES["f10_activity_state"] = ROWS + _LEVELS + f"SELECT s.day, CAST(coalesce(dt.t, 0) AS BIGINT) AS tokens, CASE WHEN coalesce(dt.t, 0) <> 0 THEN 'active' WHEN s.day >= (SELECT min(day) FROM m) THEN 'quiet' ELSE 'untracked' END AS state, coalesce(lv.level, 0) AS level FROM ({_SPINE(_YEAR, profile.ACTIVITY_DAYS)}) s LEFT JOIN dt ON dt.day = s.day LEFT JOIN lv ON lv.day = s.day"
QUERIES["c16_calendar_fill"] = lambda spark, sf_dir: profile.daily_tokens(condensed_recent_of(spark, sf_dir), FIRST, DAYS).select("day", "tokens")
ORACLES["c16_calendar_fill"] = ROWS + f"SELECT s.day, CAST(coalesce(sum(w.tokens), 0) AS BIGINT) AS tokens FROM ({_SPINE(FIRST, DAYS)}) s LEFT JOIN w ON w.day = s.day GROUP BY s.day"
QUERIES["c17_creator_map"] = lambda spark, sf_dir: demo.view(spark, sf_dir, "usage").select("provider", "model", creator(F.col("provider")).alias("creator"), family(F.col("provider"), F.coalesce("model", F.lit("unknown"))).alias("family")).groupBy("provider", "model", "creator", "family").agg(F.count(F.lit(1)).alias("events"))
ORACLES["c17_creator_map"] = demo.ctes("usage") + """ SELECT provider, model, CASE lower(trim(provider)) WHEN 'openai' THEN 'openai' WHEN 'anthropic' THEN 'anthropic' WHEN 'google' THEN 'google' END AS creator,
CASE WHEN model IS NULL THEN 'generic' ELSE CASE lower(trim(provider)) WHEN 'openai' THEN 'openai' WHEN 'anthropic' THEN 'claude' WHEN 'google' THEN 'google' ELSE 'generic' END END AS family, count(*) AS events FROM v_usage GROUP BY ALL"""


@query("a15_profile_payload")
def a15_profile_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.public_payload(profile.profile(rows_of(spark, sf_dir, True), TZ, ZONE, NOW, DAYS), DAYS, END)


# ---- reconciliation ------------------------------------------------------------------------------------------------------

_FIELDS = ["input", "output"]


def deltas_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "counter").withColumn("fingerprint", F.sha2(F.concat_ws("|", "owner", F.expr("observed_at div 3600"), "total_input"), 256))
    return reconcile.counter_delta(rows, _FIELDS)


_DELTA = demo.ctes("counter") + """, b AS (SELECT *, sha256(CAST(owner AS VARCHAR) || '|' || CAST(observed_at // 3600 AS VARCHAR) || '|' || CAST(total_input AS VARCHAR)) AS fingerprint,
  lag(ordinal) OVER s AS po, lag(total_input) OVER s AS pi, lag(total_output) OVER s AS pp FROM v_counter WINDOW s AS (PARTITION BY owner, artifact ORDER BY ordinal)),
dl AS (SELECT *, po IS NULL OR coalesce(total_input < pi, FALSE) OR coalesce(total_output < pp, FALSE) AS reset FROM b),
df AS (SELECT owner, artifact, ordinal, fingerprint, CASE WHEN reset THEN last_input WHEN total_input IS NOT NULL THEN CASE WHEN pi IS NOT NULL THEN total_input - pi ELSE last_input END END AS input,
  CASE WHEN reset THEN last_output WHEN total_output IS NOT NULL THEN CASE WHEN pp IS NOT NULL THEN total_output - pp ELSE last_output END END AS output FROM dl),
oc AS (SELECT *, CAST(sum(again) OVER (PARTITION BY owner, artifact, fingerprint ORDER BY ordinal) AS BIGINT) AS occurrence FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY owner, artifact, fingerprint ORDER BY ordinal) > 1 AND greatest(coalesce(input, 0), coalesce(output, 0)) > 0 THEN 1 ELSE 0 END AS again FROM df)) """
QUERIES["d1_counter_delta"] = lambda spark, sf_dir: deltas_of(spark, sf_dir).select("owner", "artifact", "ordinal", "fingerprint", *_FIELDS)
ORACLES["d1_counter_delta"] = _DELTA + "SELECT owner, artifact, ordinal, fingerprint, input, output FROM df"
QUERIES["d2_repeat_occurrence"] = lambda spark, sf_dir: reconcile.repeat_occurrence(deltas_of(spark, sf_dir), _FIELDS).select("owner", "artifact", "ordinal", "occurrence")
ORACLES["d2_repeat_occurrence"] = _DELTA + "SELECT owner, artifact, ordinal, occurrence FROM oc"
QUERIES["d3_fingerprint_dedupe"] = lambda spark, sf_dir: reconcile.counter_events(reconcile.repeat_occurrence(deltas_of(spark, sf_dir), _FIELDS), _FIELDS)
ORACLES["d3_fingerprint_dedupe"] = _DELTA + """, fa AS (SELECT owner, fingerprint, occurrence, artifact, arg_min((input, output), ordinal) AS t, min(ordinal) AS o FROM oc GROUP BY ALL),
wn AS (SELECT owner, fingerprint, occurrence, arg_min(t, (artifact, o)) AS t, count(DISTINCT t) > 1 AS conflict FROM fa GROUP BY ALL)
SELECT owner, fingerprint, occurrence, t[1] AS input, t[2] AS output, conflict, CASE WHEN greatest(coalesce(t[1], 0), coalesce(t[2], 0)) > 0 THEN 'canonical' ELSE 'excluded' END AS status FROM wn"""


@query("d6_retire_stale", demo.ctes("counter") + " SELECT owner AS event_key, CASE WHEN max(total_input) > 95 THEN 'canonical' ELSE 'excluded' END AS status FROM v_counter GROUP BY owner")
def d6_retire_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "counter").withColumnRenamed("owner", "event_key")
    events = rows.select("event_key").distinct().withColumn("status", F.lit("canonical"))
    return reconcile.retire_stale(events, rows.where("total_input > 95"))


_TOK = ["input_tokens", "output_tokens"]
QUERIES["d7_claude_component_max"] = lambda spark, sf_dir: reconcile.component_max(demo.view(spark, sf_dir, "snapshot"), ["message"], _TOK)
ORACLES["d7_claude_component_max"] = demo.ctes("snapshot") + " SELECT message, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens FROM v_snapshot GROUP BY message"
QUERIES["d8_claude_iteration_max"] = lambda spark, sf_dir: reconcile.component_max(demo.view(spark, sf_dir, "snapshot").withColumn("is_advisor", F.col("role") == "system"), ["message", "idx"], [*_TOK, "is_advisor"])
ORACLES["d8_claude_iteration_max"] = demo.ctes("snapshot") + " SELECT message, idx, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, bool_or(role = 'system') AS is_advisor FROM v_snapshot GROUP BY ALL"


def outer_and_iterations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = demo.view(spark, sf_dir, "snapshot")
    return rows.where("role = 'user'"), rows.where("role <> 'user'").withColumn("is_advisor", F.col("role") == "system")


@query(
    "d9_claude_residual",
    demo.ctes("snapshot")
    + """, o AS (SELECT message, max(input_tokens) AS i, max(output_tokens) AS p FROM v_snapshot WHERE role = 'user' GROUP BY message), n AS (SELECT message, sum(input_tokens) AS i, sum(output_tokens) AS p FROM v_snapshot WHERE role = 'assistant' GROUP BY message),
d AS (SELECT message, CAST(coalesce(o.i, 0) - coalesce(n.i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(o.p, 0) - coalesce(n.p, 0) AS BIGINT) AS output_tokens FROM o LEFT JOIN n USING (message))
SELECT *, least(input_tokens, output_tokens) < 0 AS conflict, greatest(input_tokens, output_tokens) > 0 AND least(input_tokens, output_tokens) >= 0 AS has_residual FROM d""",
)
def d9_claude_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer, iterations = outer_and_iterations(spark, sf_dir)
    return reconcile.residual(reconcile.component_max(outer, ["message"], _TOK), iterations, "message", _TOK)


@query(
    "d10_coherent_prefix",
    demo.ctes("snapshot")
    + """, o AS (SELECT message, seq, max(input_tokens) OVER u AS input_tokens, max(output_tokens) OVER u AS output_tokens FROM v_snapshot WINDOW u AS (PARTITION BY message ORDER BY seq)),
sl AS (SELECT DISTINCT message, idx FROM v_snapshot WHERE role <> 'user'), gr AS (SELECT o.message, o.seq, sl.idx, max(v.role = 'system') OVER u AS is_advisor, max(v.input_tokens) OVER u AS i, max(v.output_tokens) OVER u AS p
  FROM o JOIN sl USING (message) LEFT JOIN v_snapshot v ON v.message = o.message AND v.seq = o.seq AND v.idx = sl.idx AND v.role <> 'user' WINDOW u AS (PARTITION BY o.message, sl.idx ORDER BY o.seq)),
g AS (SELECT * FROM gr WHERE is_advisor IS NOT NULL), sm AS (SELECT message, seq, sum(i) AS i, sum(p) AS p FROM g WHERE NOT is_advisor GROUP BY ALL),
st AS (SELECT o.message, o.seq, coalesce(sm.i, 0) > coalesce(o.input_tokens, 0) OR coalesce(sm.p, 0) > coalesce(o.output_tokens, 0) AS bad FROM o LEFT JOIN sm USING (message, seq)),
ch AS (SELECT message, max(seq) AS last, max(seq) FILTER (WHERE NOT bad) AS good FROM st GROUP BY message)
SELECT message, idx, is_advisor, i AS input_tokens, p AS output_tokens, good IS NULL AND NOT is_advisor AS conflict FROM g JOIN ch USING (message) WHERE (NOT is_advisor AND seq = coalesce(good, last)) OR (is_advisor AND seq = last)
UNION ALL SELECT message, NULL, FALSE, input_tokens, output_tokens, good IS NULL FROM o JOIN ch USING (message) WHERE seq = coalesce(good, last)""",
)
def d10_coherent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "snapshot")
    _, iterations = outer_and_iterations(spark, sf_dir)
    return reconcile.coherent_state(rows.select("message", "seq", *_TOK), iterations.select("message", "seq", "idx", "is_advisor", *_TOK), "message", "seq", _TOK)


QUERIES["d11_claude_status"] = lambda spark, sf_dir: d10_coherent_prefix(spark, sf_dir).withColumn("status", reconcile.iteration_status()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
QUERIES["d12_first_known_time"] = lambda spark, sf_dir: reconcile.first_known_time(demo.view(spark, sf_dir, "snapshot"), ["message"], "observed_at", "seq")
ORACLES["d11_claude_status"] = f"SELECT CASE WHEN is_advisor OR NOT conflict THEN 'canonical' ELSE 'conflicted' END AS status, count(*) AS n FROM ({ORACLES['d10_coherent_prefix']}) GROUP BY 1"
ORACLES["d12_first_known_time"] = demo.ctes("snapshot") + " SELECT message, arg_min(observed_at, seq) FILTER (WHERE observed_at > 0) AS observed_at FROM v_snapshot GROUP BY message"
_KEY = ["order_key", "line"]


@query(
    "d13_pi_dominance",
    demo.ctes("revision")
    + """, r AS (SELECT *, input_tokens + output_tokens AS total FROM v_revision), f AS (SELECT order_key, line, seq, total, input_tokens, output_tokens FROM r WHERE seq = 1
UNION ALL SELECT f.order_key, f.line, r.seq, CASE WHEN r.total >= f.total AND r.input_tokens >= f.input_tokens AND r.output_tokens >= f.output_tokens THEN r.total ELSE f.total END,
  CASE WHEN r.total >= f.total AND r.input_tokens >= f.input_tokens AND r.output_tokens >= f.output_tokens THEN r.input_tokens ELSE f.input_tokens END,
  CASE WHEN r.total >= f.total AND r.input_tokens >= f.input_tokens AND r.output_tokens >= f.output_tokens THEN r.output_tokens ELSE f.output_tokens END
FROM f JOIN r ON r.order_key = f.order_key AND r.line = f.line AND r.seq = f.seq + 1)
SELECT order_key, line, arg_max(total, seq) AS total, arg_max(input_tokens, seq) AS input_tokens, arg_max(output_tokens, seq) AS output_tokens FROM f GROUP BY ALL""",
)
def d13_pi_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "revision").withColumn("total", F.col("input_tokens") + F.col("output_tokens"))
    return reconcile.dominance_fold(rows, _KEY, ["seq"], "total", _TOK)


@query("d14_pi_cost_max", demo.ctes("revision") + " SELECT order_key, line, max(cost_nanos) AS cost_nanos, max(output_tokens) AS output_tokens, arg_min({'d': CASE WHEN cost_nanos % 2 = 0 THEN CAST(cost_nanos AS VARCHAR) END}, (-cost_nanos, cost_nanos % 2 <> 0, seq)) FILTER (WHERE cost_nanos IS NOT NULL)['d'] AS decimal, arg_min(seq, (-cost_nanos, cost_nanos % 2 <> 0, seq)) FILTER (WHERE cost_nanos IS NOT NULL) AS seq_of FROM v_revision GROUP BY ALL")
def d14_pi_cost_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "revision").withColumns({"decimal": F.when(F.col("cost_nanos") % 2 == 0, F.col("cost_nanos").cast("string")), "seq_of": F.col("seq")})
    return reconcile.cost_max(rows, _KEY, ["seq"], "cost_nanos", "decimal", ["output_tokens"], ["seq_of"])


@query("d15_subagent_select", demo.ctes("revision") + " SELECT order_key, line, arg_max(output_tokens, (terminal, seq)) AS output_tokens, arg_max(observed_at, (terminal, seq)) AS observed_at, min(input_tokens) AS input_tokens, bool_or(terminal) AS terminal, greatest(arg_max(observed_at, (terminal, seq)) - min(input_tokens), 0) AS duration FROM v_revision GROUP BY ALL")
def d15_subagent_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.terminal_first(demo.view(spark, sf_dir, "revision"), _KEY, "terminal", ["seq"], ["output_tokens"], "input_tokens", "observed_at")


@query(
    "d17_opencode_revision",
    demo.ctes("revision")
    + """, o AS (SELECT * FROM v_revision WHERE seq = 1), n AS (SELECT * FROM v_revision WHERE seq = 2), j AS (SELECT order_key, line, o.seq AS os, n.seq AS ns, o.input_tokens AS oi, o.output_tokens AS oo, n.input_tokens AS ni, n.output_tokens AS no, o.cost_nanos AS oc, n.cost_nanos AS nc, o.observed_at AS ot, n.observed_at AS nt FROM o FULL JOIN n USING (order_key, line))
SELECT order_key, line, CASE WHEN os IS NULL OR (ns IS NOT NULL AND ni >= oi AND no >= oo) THEN ni ELSE oi END AS input_tokens, CASE WHEN os IS NULL OR (ns IS NOT NULL AND ni >= oi AND no >= oo) THEN no ELSE oo END AS output_tokens, greatest(oc, nc) AS cost_nanos, coalesce(ot, nt) AS observed_at FROM j""",
)
def d17_opencode_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "revision")
    return reconcile.revise(rows.where("seq = 1"), rows.where("seq = 2"), _KEY, _TOK, "cost_nanos", "observed_at")


@query(
    "d18_parts_vs_fallback",
    demo.ctes("parts", "fallback")
    + """, p AS (SELECT message, sum(input_tokens) AS i, sum(output_tokens) AS o FROM v_parts GROUP BY message), j AS (SELECT message, p.i AS pi, p.o AS po, f.input_tokens AS fi, f.output_tokens AS fo, f.counted, p.message IS NOT NULL AS hp, f.message IS NOT NULL AS hf FROM v_fallback f FULL JOIN p USING (message)),
k AS (SELECT *, CASE WHEN NOT hp THEN 'fallback' WHEN NOT hf OR (pi >= fi AND po >= fo) THEN 'parts' WHEN fi >= pi AND fo >= po THEN 'fallback' WHEN counted THEN 'fallback' ELSE 'parts' END AS counts FROM j)
SELECT message, counts, CAST(CASE WHEN counts = 'parts' THEN pi ELSE fi END AS BIGINT) AS input_tokens, CAST(CASE WHEN counts = 'parts' THEN po ELSE fo END AS BIGINT) AS output_tokens FROM k""",
)
def d18_parts_vs_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.parts_or_fallback(demo.view(spark, sf_dir, "parts"), demo.view(spark, sf_dir, "fallback"), "message", _TOK, "counted")


QUERIES["d20_coalesce_upsert"] = lambda spark, sf_dir: reconcile.coalesce_upsert(demo.view(spark, sf_dir, "upsert"), ["id"], ["kind", "amount", "seen_at"])
ORACLES["d20_coalesce_upsert"] = demo.ctes("upsert") + " SELECT id, arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL) AS kind, arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount, arg_max(seen_at, seq) AS seen_at FROM v_upsert GROUP BY id"
QUERIES["d21_replace_usage_upsert"] = lambda spark, sf_dir: reconcile.replace_upsert(demo.view(spark, sf_dir, "upsert"), ["id"], ["kind", "amount", "seen_at"])
ORACLES["d21_replace_usage_upsert"] = demo.ctes("upsert") + " SELECT id, kind, amount, seen_at FROM v_upsert QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"
QUERIES["d22_link_insert"] = lambda spark, sf_dir: reconcile.keep_first(demo.view(spark, sf_dir, "upsert"), ["id", "kind"], ["amount", "seen_at"])
ORACLES["d22_link_insert"] = demo.ctes("upsert") + " SELECT id, kind, amount, seen_at FROM v_upsert QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY seq) = 1"


@query("d24_issue_upsert", demo.ctes("upsert") + ", i AS (SELECT id, kind, min(seen_at) AS first_seen FROM v_upsert WHERE amount < 30 GROUP BY ALL), c AS (SELECT DISTINCT id, kind FROM v_upsert WHERE amount > 97) SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = i.id AND c.kind IS NOT DISTINCT FROM i.kind)")
def d24_issue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "upsert").withColumnRenamed("seen_at", "first_seen")
    return reconcile.issue_upsert(rows.where("amount < 20"), rows.where("amount >= 20 AND amount < 30"), rows.where("amount > 97"), ["id", "kind"])


@query("d27_change_set", demo.ctes("upsert") + " SELECT id FROM v_upsert WHERE amount > 97 UNION SELECT id FROM v_upsert WHERE kind IS NULL AND amount < 2")
def d27_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "upsert")
    return reconcile.change_set(rows.where("amount > 97").select("id"), rows.where("kind IS NULL AND amount < 2").select("id"))


@query("d29_write_stats", demo.ctes("upsert") + ", s AS (SELECT id, max(seq) AS m FROM v_upsert GROUP BY id), b AS (SELECT id, max(seq) AS m FROM v_upsert WHERE amount < 98 GROUP BY id HAVING count(*) > 40) SELECT count(*) FILTER (WHERE b.id IS NULL) AS inserted, count(*) FILTER (WHERE b.id IS NOT NULL AND s.m <> b.m) AS updated FROM s LEFT JOIN b USING (id)")
def d29_write_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "upsert")
    before = rows.where("amount < 98").groupBy("id").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 40")
    return reconcile.write_stats(before, rows.groupBy("id").agg(F.max("seq").alias("m")), ["id"], ["m"])


# ---- joins and closures --------------------------------------------------------------------------------------------------


@query(
    "c6_opencode_root",
    demo.ctes("sessions")
    + """, k AS (SELECT source_session_id AS node, parent_session_id AS parent FROM v_sessions), f AS (SELECT node, node AS here, CAST(0 AS BIGINT) AS depth FROM k UNION ALL SELECT f.node, k.parent, f.depth + 1 FROM f JOIN k ON k.node = f.here WHERE k.parent IS NOT NULL)
SELECT node, arg_max(here, depth) AS root, max(depth) AS depth FROM f GROUP BY node""",
)
def c6_opencode_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.roots(demo.view(spark, sf_dir, "sessions").select(F.col("source_session_id").alias("node"), F.col("parent_session_id").alias("parent")))


@query("c3_session_run_ids", ROWS.split(", t AS (")[0] + """, k AS (SELECT source_session_id AS node, parent_session_id AS parent FROM v_sessions), f AS (SELECT node, node AS here, CAST(0 AS BIGINT) AS depth FROM k UNION ALL SELECT f.node, k.parent, f.depth + 1 FROM f JOIN k ON k.node = f.here WHERE k.parent IS NOT NULL), r AS (SELECT node, arg_max(here, depth) AS root FROM f GROUP BY node),
e AS (SELECT u.source_run_id AS run, coalesce(u.source_session_id, r.source_session_id) AS session FROM v_usage u LEFT JOIN v_runs r ON r.source_run_id = u.source_run_id) SELECT run, session, s.parent_session_id AS parent, r.root, count(*) AS events FROM e LEFT JOIN v_sessions s ON s.source_session_id = session LEFT JOIN r ON r.node = session GROUP BY ALL""")
def c3_session_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage, runs, sessions = (demo.view(spark, sf_dir, n) for n in ("usage", "runs", "sessions"))
    keys = usage.groupBy("source_run_id", "source_session_id").agg(F.count(F.lit(1)).alias("n"))  # events of one run and session have one answer
    found = evidence.session_of_runs(keys, runs, sessions)
    return found.groupBy(F.col("source_run_id").alias("run"), "session", "parent", "root").agg(F.sum("n").alias("events"))


@query("c7_opencode_fallback", demo.ctes("parts", "fallback") + " SELECT f.message, f.input_tokens, f.output_tokens FROM v_fallback f WHERE NOT EXISTS (SELECT 1 FROM v_parts p WHERE p.message = f.message)")
def c7_opencode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.view(spark, sf_dir, "fallback").join(demo.view(spark, sf_dir, "parts"), "message", "left_anti").drop("counted")


@query("c8_provisional_keys", demo.ctes("usage") + " SELECT DISTINCT source_session_id FROM v_usage WHERE status = 'provisional' AND source_session_id IS NOT NULL")
def c8_provisional_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.keys_with_status(demo.view(spark, sf_dir, "usage"), "source_session_id")


_METHODS = "WITH k AS (SELECT DISTINCT l_orderkey || '/' || l_linenumber AS o, l_orderkey AS e, l_suppkey AS owner, CASE WHEN l_suppkey % 3 = 0 THEN 'legacy' WHEN l_linenumber % 2 = 0 THEN 'legacy' ELSE 'semantic' END AS method, CASE WHEN l_linenumber % 3 = 0 THEN 'hook' ELSE 'disk' END AS channel FROM lineitem) "


def _methods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with a method, observations with an owner and a channel, and events: lines of orders as evidence for the orders."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("observation_key")
    method = F.when((F.col("l_suppkey") % 3 == 0) | (F.col("l_linenumber") % 2 == 0), "legacy").otherwise("semantic")
    links = lines.select(key, F.col("l_orderkey").alias("event_key"), method.alias("method")).distinct()
    observations = lines.select(key, F.col("l_suppkey").alias("owner"), F.when(F.col("l_linenumber") % 3 == 0, "hook").otherwise("disk").alias("channel")).distinct()
    events = orders.select(F.col("o_orderkey").alias("event_key"), F.when(F.col("o_orderstatus") == "P", "excluded").otherwise("canonical").alias("status"))
    return links, observations, events


@query("c9_legacy_owners", _METHODS + "SELECT owner FROM k JOIN orders ON o_orderkey = e WHERE o_orderstatus <> 'P' GROUP BY owner HAVING min(method) = 'legacy' AND max(method) = 'legacy'")
def c9_legacy_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, observations, events = _methods(spark, sf_dir)
    return evidence.legacy_owners(events, links, observations, "legacy")


@query("c10_stale_messages", demo.ctes("snapshot") + """, o AS (SELECT message, message % 50 AS path, seq % 3 AS generation FROM v_snapshot), a AS (SELECT path, generation, path % 4 = 0 AND generation = 2 AS missing FROM (SELECT DISTINCT path, generation FROM o)),
l AS (SELECT path, max(generation) AS generation, arg_max(missing, generation) AS missing FROM a GROUP BY path), c AS (SELECT DISTINCT message FROM v_snapshot WHERE role = 'assistant')
SELECT message FROM c WHERE NOT EXISTS (SELECT 1 FROM o JOIN l USING (path, generation) WHERE o.message = c.message AND NOT l.missing) OR EXISTS (SELECT 1 FROM o JOIN l USING (path, generation) WHERE o.message = c.message AND l.missing)""")
def c10_stale_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "snapshot")
    observations = rows.select("message", (F.col("message") % 50).alias("path_hash"), (F.col("seq") % 3).alias("generation"))
    artifacts = observations.select("path_hash", "generation").distinct().withColumn("is_missing", (F.col("path_hash") % 4 == 0) & (F.col("generation") == 2))
    return evidence.stale_messages(observations, artifacts, rows.where("role = 'assistant'"))


@query("c18_event_channels", _METHODS + "SELECT DISTINCT e AS event_key, channel FROM k")
def c18_event_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, observations, _ = _methods(spark, sf_dir)
    return evidence.event_channels(links, observations)


@query("c19_opencode_step_join", demo.ctes("parts", "fallback", "sessions") + " SELECT p.message, p.line, p.input_tokens, f.output_tokens AS message_tokens, s.current_model AS agent FROM v_parts p JOIN v_fallback f ON f.message = p.message JOIN v_sessions s ON s.source_session_id = CAST(f.message AS VARCHAR)")
def c19_opencode_step_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, messages, sessions = (demo.view(spark, sf_dir, n) for n in ("parts", "fallback", "sessions"))
    m = messages.select("message", F.col("output_tokens").alias("message_tokens"))
    s = sessions.select(F.col("source_session_id").cast("long").alias("message"), F.col("current_model").alias("agent"))
    return parts.select("message", "line", "input_tokens").join(m, "message").join(s, "message")


@query("c20_date_anchor", demo.ctes("snapshot") + ", d AS (SELECT message, arg_min(observed_at, seq) FILTER (WHERE observed_at > 0) AS first_at FROM v_snapshot GROUP BY message) SELECT v.message, v.seq, coalesce(v.observed_at, d.first_at) AS dated FROM v_snapshot v JOIN d USING (message)")
def c20_date_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dated(demo.view(spark, sf_dir, "snapshot"), ["message"], "observed_at", "seq").select("message", "seq", "dated")


@query("c21_fk_check", "SELECT o_custkey AS customer, count(*) AS dangling FROM orders WHERE o_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def c21_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    lost = dangling(orders.where("o_orderkey % 2 = 1"), "o_orderkey", lines.where("l_returnflag = 'R'"), "l_orderkey")
    return lost.groupBy(F.col("o_custkey").alias("customer")).agg(F.count(F.lit(1)).alias("dangling"))


@query("f9_latest_generation", demo.ctes("revision") + " SELECT order_key, line, max(seq) AS seq, arg_max(output_tokens, seq) AS output_tokens FROM v_revision GROUP BY ALL")
def f9_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_generation(demo.view(spark, sf_dir, "revision").select(*_KEY, "seq", "output_tokens"), _KEY, "seq")


# ---- ingestion, over logs that Spark derives from the tables ---------------------------------------------------------------


@query("a9_corrupt_gate", demo.ctes("counter") + ", l AS (SELECT artifact, owner, ordinal, total_input = 50 AS bad FROM v_counter), f AS (SELECT artifact, owner, min(ordinal) FILTER (WHERE bad) AS first FROM l GROUP BY ALL) SELECT (SELECT count(*) FROM l JOIN f USING (artifact, owner) WHERE first IS NULL OR ordinal < first) AS good, (SELECT count(first) FROM f) AS issues")
def a9_corrupt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "counter").select(F.concat_ws("/", F.col("artifact").cast("string"), F.col("owner").cast("string")).alias("file"), "ordinal", F.when(F.col("total_input") == 50, "{cut").otherwise('{"x": 1}').alias("line"))
    good, issues = corrupt_gate(rows, "codex")
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(issues.agg(F.count(F.lit(1)).alias("issues")))  # one row each


@query("b1_codex_token_count", demo.ctes("counter") + " SELECT CAST(owner AS VARCHAR) AS owner, artifact || '/' || owner AS file, ordinal + 1 AS ordinal, CAST(row_number() OVER (PARTITION BY owner, artifact ORDER BY ordinal) - 1 AS BIGINT) AS sequence, observed_at * 1000000000 AS observed_at_ns, total_input AS total_input_tokens, total_output AS total_output_tokens, last_input AS last_input_tokens, last_output AS last_output_tokens FROM v_counter")
def b1_codex_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = codex.parse(demo.codex_lines(spark, sf_dir))["observations"]
    return out.select("owner", "file", "ordinal", F.col("sequence").cast("long").alias("sequence"), "observed_at_ns", "total_input_tokens", "total_output_tokens", "last_input_tokens", "last_output_tokens")


_FOLDED = """b AS (SELECT *, owner || '|' || observed_at || '|' || total_input || '|' || coalesce(total_output, -1) || '|' || last_input || '|' || coalesce(last_output, -1) AS fp, lag(ordinal) OVER s AS po, lag(total_input) OVER s AS pi, lag(total_output) OVER s AS pp FROM (SELECT *, ordinal % 7 = 0 AS phase FROM v_counter WHERE {where}) WINDOW s AS (PARTITION BY owner, artifact ORDER BY phase, ordinal)),
dl AS (SELECT *, po IS NULL OR coalesce(total_input < pi, FALSE) OR coalesce(total_output < pp, FALSE) AS reset FROM b),
df AS (SELECT owner, artifact, ordinal, phase, fp, CASE WHEN reset THEN last_input ELSE total_input - pi END AS i, CASE WHEN reset THEN last_output WHEN total_output IS NOT NULL THEN CASE WHEN pp IS NOT NULL THEN total_output - pp ELSE last_output END END AS o FROM dl),
again AS (SELECT *, sum(CASE WHEN n > 1 AND greatest(coalesce(i, 0), coalesce(o, 0)) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY owner, artifact, fp ORDER BY phase, ordinal) AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY owner, artifact, fp ORDER BY phase, ordinal) AS n FROM df)),
one AS (SELECT owner, fp, occurrence, artifact, arg_min({{'i': i, 'o': o}}, (phase, ordinal)) AS t FROM again GROUP BY ALL),
w AS (SELECT owner, fp, occurrence, arg_min(t, artifact) AS t, count(DISTINCT t) > 1 AS conflict FROM one GROUP BY ALL)"""
_EVENTS_OF = "SELECT owner, fp, occurrence, t['i'] AS i, t['o'] AS o, conflict FROM w"


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "logs")


def _synced(spark: SparkSession, source: str, logs: DataFrame) -> Ledger:
    """A new ledger after a sync of logs that Spark derives from the tables."""
    folder, ledger = _folder(spark), Ledger(spark, new_path(spark, "ledger"))
    demo.write_logs(logs, folder)
    sync.sync(spark, ledger, source, [folder])
    return ledger


@query(
    "d26_codex_rebuild",
    demo.ctes("counter") + ", " + _FOLDED.format(where="TRUE")
    + " SELECT CAST(owner AS VARCHAR) AS owner, CASE WHEN greatest(coalesce(t['i'], 0), coalesce(t['o'], 0)) > 0 THEN 'canonical' ELSE 'excluded' END AS status, count(*) AS events, CAST(sum(t['i']) AS BIGINT) AS input_tokens, CAST(sum(t['o']) AS BIGINT) AS output_tokens FROM w GROUP BY ALL",
)
def d26_codex_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _synced(spark, "codex", demo.codex_logs(spark, sf_dir))
    sync.rebuild(spark, ledger, ["codex"])
    return sync.events(ledger, "codex").groupBy(F.col("source_session_id").alias("owner"), "status").agg(F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(
    "i1_incremental_sync",
    demo.ctes("counter") + ", was AS (WITH " + _FOLDED.format(where="ordinal % 7 <> 0") + f" {_EVENTS_OF}), now AS (WITH " + _FOLDED.format(where="TRUE") + f""" {_EVENTS_OF}),
j AS (SELECT was.owner IS NULL AS fresh, was.i IS DISTINCT FROM now.i OR was.o IS DISTINCT FROM now.o OR was.conflict <> now.conflict AS differs FROM now LEFT JOIN was ON was.owner = now.owner AND was.fp = now.fp AND was.occurrence = now.occurrence),
h AS (SELECT count(*) FILTER (WHERE phase = 0) AS a, count(*) FILTER (WHERE phase = 1) AS b FROM (SELECT DISTINCT owner, artifact, ordinal % 7 = 0 AS phase FROM v_counter)), c AS (SELECT count(*) FILTER (WHERE ordinal % 7 <> 0) AS a, count(*) FILTER (WHERE ordinal % 7 = 0) AS b FROM v_counter)
SELECT 1 AS step, c.a + h.a AS lines_read, c.a + h.a AS observations, (SELECT count(*) FROM was) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(1 AS BIGINT) AS version FROM c, h
UNION ALL SELECT 2, 0, 0, 0, 0, 1 UNION ALL SELECT 3, c.b + h.b, c.b + h.b, (SELECT count(*) FILTER (WHERE fresh) FROM j), (SELECT count(*) FILTER (WHERE NOT fresh AND differs) FROM j), 2 FROM c, h""",
)
def i1_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync of all logs, one of the same logs, and one after every seventh row has been appended to them."""
    folder, ledger = _folder(spark), Ledger(spark, new_path(spark, "ledger"))
    steps = []
    for n, later in ((1, False), (2, None), (3, True)):
        if later is not None:
            demo.write_logs(demo.codex_logs(spark, sf_dir, later), folder)
        steps.append(sync.sync(spark, ledger, "codex", [folder]).select(F.lit(n).alias("step"), "lines_read", "observations", "inserted", "updated", "version"))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query(
    "i2_retained_history",
    demo.ctes("counter") + ", " + _FOLDED.format(where="TRUE")
    + f""" SELECT (SELECT count(DISTINCT owner % {demo.SHARDS}) FROM v_counter WHERE artifact = 2) AS missing, (SELECT count(DISTINCT artifact || '/' || owner % {demo.SHARDS}) FROM v_counter) AS files, count(*) AS events, CAST(sum(t['i']) AS BIGINT) AS input_tokens FROM w""",
)
def i2_retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a sync, a third of the files vanish; the next sync marks them and keeps all usage."""
    folder, ledger = _folder(spark), Ledger(spark, new_path(spark, "ledger"))
    demo.write_logs(demo.codex_logs(spark, sf_dir), folder)
    sync.sync(spark, ledger, "codex", [folder])
    for n in range(demo.SHARDS):
        removed(spark, f"{folder}/2-{n}.jsonl")
    sync.sync(spark, ledger, "codex", [folder])
    files = ledger.read("codex/artifacts").agg(F.count(F.when(F.col("is_missing"), 1)).alias("missing"), F.count(F.lit(1)).alias("files"))
    return files.crossJoin(sync.events(ledger, "codex").agg(F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens")))  # one row each


@query("a10_file_manifest", demo.ctes("counter") + f" SELECT artifact || '-' || owner % {demo.SHARDS} AS log, count(*) + count(DISTINCT owner || '/' || (ordinal % 7 = 0)) AS lines, 0 AS generation FROM v_counter GROUP BY ALL")
def a10_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of listed logs and the lines that they have."""
    folder = _folder(spark)
    demo.write_logs(demo.codex_logs(spark, sf_dir), folder)
    state = next_manifest(spark.createDataFrame([], MANIFEST), listing(spark, [folder]))
    counts = lines(read_files(spark, [folder])).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    same = lambda c: F.regexp_extract(c, "([^/]+)[.]jsonl$", 1).alias("log")
    return counts.select(same("file"), "lines").join(state.where("changed").select(same("file"), "generation"), "log")


@query("b6_claude_assistant", demo.ctes("snapshot") + " SELECT 'm' || message AS message, CAST(message AS VARCHAR) AS source_session_id, seq AS ordinal, input_tokens, output_tokens FROM v_snapshot WHERE seq % 5 <> 4")
def b6_claude_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claude.parse(demo.claude_lines(spark, sf_dir))["observations"].select("message", "source_session_id", "ordinal", "input_tokens", "output_tokens")


@query("d26_claude_rebuild", demo.ctes("snapshot") + " SELECT 'claude:m' || message AS event_key, 'canonical' AS status, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens FROM v_snapshot WHERE seq % 5 <> 4 GROUP BY message")
def d26_claude_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _synced(spark, "claude", demo.claude_logs(spark, sf_dir))
    sync.rebuild(spark, ledger, ["claude"])
    return sync.events(ledger, "claude").select("event_key", "status", "input_tokens", "output_tokens")


@query(
    "d26_pi_rebuild",
    """WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n, CAST(l_quantity AS BIGINT) AS i, CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT) AS o FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY n) AS seq FROM l), f AS (SELECT k, line, seq, i, o FROM r WHERE seq = 1 UNION ALL SELECT f.k, f.line, r.seq, CASE WHEN r.i >= f.i AND r.o >= f.o THEN r.i ELSE f.i END, CASE WHEN r.i >= f.i AND r.o >= f.o THEN r.o ELSE f.o END FROM f JOIN r ON r.k = f.k AND r.line = f.line AND r.seq = f.seq + 1)
SELECT 'pi:s0:' || k || '-' || line || ':assistant' AS event_key, arg_max(i, seq) AS input_tokens, arg_max(o, seq) AS output_tokens, (SELECT max(i) FROM r WHERE r.k = f.k AND r.line = f.line) * 1000000 AS total_cost_nanos FROM f GROUP BY k, line""",
)
def d26_pi_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in a chain of parents, whose entries are copied with other usage: the fold's tokens and the largest cost."""
    ledger = _synced(spark, "pi", demo.pi_logs(spark, sf_dir))
    sync.rebuild(spark, ledger, ["pi"])
    return sync.events(ledger, "pi").where("status = 'canonical'").select("event_key", "input_tokens", "output_tokens", "total_cost_nanos")


@query(
    "d26_opencode_rebuild",
    """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS i FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) SELECT o_custkey AS customer, CAST(sum(coalesce(n, 1)) AS BIGINT) AS events, CAST(sum(coalesce(i, o_orderkey % 1000)) AS BIGINT) AS input_tokens FROM orders LEFT JOIN p ON k = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def d26_opencode_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, new_path(spark, "ledger"))
    sync.sync(spark, ledger, "opencode", demo.opencode_tables(spark, sf_dir))
    sync.rebuild(spark, ledger, ["opencode"])
    found = sync.events(ledger, "opencode").where("status = 'canonical'")
    return found.groupBy(F.col("source_session_id").cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens"))


@query("b31_quarantine", demo.ctes("snapshot") + " SELECT CAST(message AS VARCHAR) AS file, seq AS ordinal, 'invalid_usage' AS category, 'claude' AS source, 'error' AS severity, message || ':' || seq AS identifier, CAST(seq AS VARCHAR) AS field_path, 'OBJECT' AS value_type FROM v_snapshot WHERE seq % 5 = 4")
def b31_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claude.parse(demo.claude_lines(spark, sf_dir))["issues"]


@query("b12_pi_direct", "SELECT CAST(l_orderkey AS VARCHAR) AS file, 's' || l_orderkey AS session_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT)) AS BIGINT) AS output_tokens, CAST(sum(l_linenumber) AS BIGINT) AS cache_read_tokens, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6 GROUP BY ALL")
def b12_pi_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = pi.parse(demo.pi_lines(spark, sf_dir))["direct"]
    return direct.groupBy("file", "session_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")], F.count(F.lit(1)).alias("n"))


@query(
    "b20_opencode_parts",
    """SELECT 'part' AS kind, CAST(l_orderkey AS VARCHAR) AS message_id, CAST(o_custkey AS VARCHAR) AS session_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber + 1) AS BIGINT) AS output_tokens, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber % 2 = 1 GROUP BY ALL
UNION ALL SELECT 'message', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderkey % 1000, 1, 1 FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 1)""",
)
def b20_opencode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = opencode.observations(*demo.opencode_tables(spark, sf_dir))
    return rows.groupBy("kind", "message_id", "session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("n"))


@query(
    "d19_opencode_recover",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_linenumber + 1) AS o FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
r AS (SELECT o_orderkey, n, o_orderkey % 1000 AS fi, coalesce(i, 0) AS pi, coalesce(o, 0) AS po FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS canonical_messages, CAST(coalesce(sum(n), 0) AS BIGINT) AS canonical_parts FROM r""",
)
def d19_opencode_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    retained = written(opencode.observations(*demo.opencode_tables(spark, sf_dir)))
    events = opencode.events(retained, ["observation_key"]).where("status = 'canonical'")
    return events.agg(F.count(F.when(F.col("event_key").startswith("opencode:message:"), 1)).alias("canonical_messages"), F.count(F.when(F.col("event_key").startswith("opencode:part:"), 1)).alias("canonical_parts"))


@query("d23_merge_events", demo.ctes("sessions") + """, k AS (SELECT source_session_id AS node, parent_session_id AS parent FROM v_sessions), f AS (SELECT node, node AS here, 0 AS depth FROM k UNION ALL SELECT f.node, k.parent, f.depth + 1 FROM f JOIN k ON k.node = f.here WHERE k.parent IS NOT NULL),
r AS (SELECT node, arg_max(here, depth) AS root FROM f GROUP BY node), e AS (SELECT s.source_session_id AS node, s.provider, r.root FROM v_sessions s JOIN r ON r.node = s.source_session_id)
SELECT node AS event_key, CASE WHEN root <> node THEN 'excluded' ELSE 'canonical' END AS status, CASE WHEN root <> node THEN root END AS merged_into, coalesce(provider, (CASE WHEN root = node THEN (SELECT arg_min(x.provider, x.node) FROM e x WHERE x.root = e.node AND x.node <> e.node) END)) AS provider FROM e""")
def d23_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = demo.view(spark, sf_dir, "sessions")
    events = s.select(F.col("source_session_id").alias("event_key"), F.lit("canonical").alias("status"), "provider")
    pairs = s.where("parent_session_id IS NOT NULL").select(F.col("parent_session_id").alias("survivor"), F.col("source_session_id").alias("absorbed"))
    links = s.select(F.col("source_session_id").alias("observation"), F.col("source_session_id").alias("event_key"))
    return merge_events(events, links, pairs, ["provider"])[0].select("event_key", "status", "merged_into", "provider")


@query("d28_metadata_change", demo.ctes("revision") + " SELECT order_key, line, seq FROM (SELECT *, lag(cost_nanos) OVER w AS c, lag(terminal) OVER w AS t, lag(seq) OVER w AS s FROM v_revision WINDOW w AS (PARTITION BY order_key, line ORDER BY seq)) WHERE s IS NOT NULL AND (c IS DISTINCT FROM cost_nanos OR t IS DISTINCT FROM terminal)")
def d28_metadata_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.metadata_changes(demo.view(spark, sf_dir, "revision"), _KEY, "seq", ["cost_nanos", "terminal"]).select(*_KEY, "seq")


@query("f5_streak_award_day", ROWS + ", u AS (SELECT DISTINCT day FROM m WHERE tokens > 0 AND agent_key IS NOT NULL AND day IS NOT NULL), i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM u), p AS (SELECT day, row_number() OVER (PARTITION BY island ORDER BY day) AS place FROM i) SELECT min(day) AS day FROM p WHERE place >= 14")
def f5_streak_award_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.islands(measured_of(spark, sf_dir)).where("place >= 14").agg(F.min("day").alias("day"))


# ---- evidence ------------------------------------------------------------------------------------------------------------


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links from lines to orders: an observation is live unless it was returned; orders of status P aren't events."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("observation_key")
    links = lines.select(key, F.col("l_orderkey").alias("event_key")).distinct()
    observations = lines.where("l_linenumber <> 2").groupBy(key).agg(F.max(F.col("l_returnflag") != "R").alias("live"))
    events = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_key"), F.when(F.col("o_orderstatus") == "F", "canonical").otherwise("provisional").alias("status"))
    return links, observations, events


_EVIDENCE = "WITH k AS (SELECT DISTINCT l_orderkey || '/' || l_linenumber AS observation_key, l_orderkey AS event_key FROM lineitem), o AS (SELECT l_orderkey || '/' || l_linenumber AS observation_key, max(l_returnflag <> 'R') AS live FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1), e AS (SELECT o_orderkey AS event_key FROM orders WHERE o_orderstatus <> 'P') "


@query("c2_link_resolve", _EVIDENCE + "SELECT count(*) FILTER (WHERE o.observation_key IS NOT NULL AND e.event_key IS NOT NULL) AS resolved, count(*) FILTER (WHERE o.observation_key IS NULL OR e.event_key IS NULL) AS dangling FROM k LEFT JOIN o USING (observation_key) LEFT JOIN e ON e.event_key = k.event_key")
def c2_link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, dangling = evidence.resolved_links(*_evidence(spark, sf_dir))
    return good.agg(F.count(F.lit(1)).alias("resolved")).crossJoin(dangling.agg(F.count(F.lit(1)).alias("dangling")))  # one row each


@query("c11_stale_pi_events", _EVIDENCE + "SELECT event_key FROM e WHERE NOT EXISTS (SELECT 1 FROM k JOIN o USING (observation_key) WHERE o.live AND k.event_key = e.event_key)")
def c11_stale_pi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, observations, events = _evidence(spark, sf_dir)
    return evidence.stale_events(events, links, observations)


@query("c12_legacy_overlap", "WITH p AS (SELECT DISTINCT l_orderkey AS m FROM lineitem WHERE l_linenumber = 1), v AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_quantity = 50) SELECT CASE WHEN p.m IS NOT NULL THEN 'suppressed' WHEN v.s IS NOT NULL THEN 'ambiguous' ELSE 'kept' END AS decision, count(*) AS n FROM orders LEFT JOIN p ON p.m = o_orderkey LEFT JOIN v ON v.s = o_custkey GROUP BY 1")
def c12_legacy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    parts = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("message_id"))
    legacy = lines.where("l_quantity = 50").select(F.col("l_suppkey").alias("session_id"), F.lit(None).cast("long").alias("message_id"))
    found = evidence.legacy_overlap(orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("session_id")), parts, legacy)
    return found.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("d25_sample_insert", demo.ctes("upsert") + " SELECT id, kind, count(*) AS n FROM (SELECT DISTINCT id, kind FROM v_upsert WHERE kind IS NOT NULL AND amount IS NOT NULL) GROUP BY ALL")
def d25_sample_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo.view(spark, sf_dir, "upsert").where("kind IS NOT NULL AND amount IS NOT NULL").select("id", "kind", "amount")
    old = rows.where("amount < 30").groupBy("id", "kind").agg(F.min("amount").alias("amount"))
    return evidence.insert_new(old, rows, ["id", "kind"]).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("d16_subagent_run_upsert", demo.ctes("runs", "sessions") + " SELECT r.source_run_id AS run_key, CASE WHEN r.source_session_id LIKE '%7' THEN 'old' WHEN s.source_session_id IS NOT NULL THEN s.source_session_id ELSE r.source_session_id END AS session, coalesce(r.model, CASE WHEN r.source_session_id LIKE '%7' THEN 'old-model' END) AS model FROM v_runs r LEFT JOIN v_sessions t ON t.source_session_id = r.source_session_id LEFT JOIN v_sessions s ON s.source_session_id = t.parent_session_id")
def d16_subagent_run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, sessions = demo.view(spark, sf_dir, "runs"), demo.view(spark, sf_dir, "sessions")
    none = F.lit(None).cast("string")
    parents = sessions.select("source_session_id", F.col("parent_session_id").alias("root"))
    snapshots = runs.join(parents, "source_session_id", "left").select(F.col("source_run_id").alias("run_key"), F.col("source_session_id").alias("session_id"), "root", none.alias("role"), "model", none.alias("provider"), none.alias("effort"), none.alias("status"), "started_at_ns", "completed_at_ns")
    old = snapshots.where("session_id LIKE '%7'").select("run_key", F.lit("old").alias("session"), "role", F.lit("old-model").alias("model"), "provider", "effort", "status", "started_at_ns", "completed_at_ns")
    return evidence.subagent_runs(snapshots, sessions, old).select("run_key", "session", "model")


from usagemill import ledger_queries  # noqa: E402, F401  registers its queries
