"""Reporting rows within a window."""

from usagemill.functions.tokens import TOKENS
from usagemill.plans import reporting


def test_windows_hold_before_the_joins(spark):
    """Events whose own time lies outside the window don't reach the joins; those without one take their session's time after them."""
    usage = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in {**dict.fromkeys(["provider", "response_model", "model", "service_tier", "speed", "inference_region"], "string"), **dict.fromkeys([*TOKENS, "total_cost_nanos", "completed_at_ns"], "long")}.items())
    events = spark.sql(f"SELECT 'pi' AS source, 'canonical' AS status, 'model_call' AS granularity, CAST(NULL AS string) AS source_run_id, {usage}, * FROM VALUES ('s', 5L), ('s', 50L), ('s', NULL), ('t', NULL) AS t(source_session_id, started_at_ns)")
    runs = spark.sql("SELECT CAST(NULL AS string) AS source_run_id, CAST(NULL AS string) AS source_session_id, CAST(NULL AS string) AS parent_run_id, CAST(NULL AS string) AS model, CAST(NULL AS string) AS provider, 1L AS started_at_ns, 1L AS completed_at_ns").where("false")
    sessions = spark.sql("SELECT source_session_id, CAST(NULL AS string) AS provider, CAST(NULL AS string) AS current_model, CAST(NULL AS string) AS initial_model, CAST(NULL AS string) AS service_tier, started_at_ns, CAST(NULL AS long) AS updated_at_ns, CAST(NULL AS long) AS completed_at_ns FROM VALUES ('s', 20L), ('t', 90L) AS t(source_session_id, started_at_ns)")
    every, inside = (reporting.reporting(events, runs, sessions, window=w) for w in (None, (10, 60)))
    assert sorted(r.occurred_at_ns for r in every.collect()) == [5, 20, 50, 90] and sorted(r.occurred_at_ns for r in inside.collect()) == [20, 50]
