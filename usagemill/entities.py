"""The ledger's entities under one schema for all sources, and how new rows of them meet the old ones.

Sessions and runs keep each column's last known value, issues are intervals of versions, events and links are replaced with what a recompute gives.
Keys are natural: (source, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagemill.functions.tokens import TOKENS
from usagemill.operators import reconcile

COSTS = ["input_cost_nanos", "output_cost_nanos", "cache_read_cost_nanos", "cache_write_cost_nanos", "total_cost_nanos"]
_TEXT, _LONG = "string", "long"
SESSION = {"source": _TEXT, "source_session_id": _TEXT, "parent_session_id": _TEXT, "harness_version": _TEXT, "provider": _TEXT, "initial_model": _TEXT, "current_model": _TEXT, "reasoning_effort": _TEXT, "service_tier": _TEXT, "workspace_hash": _TEXT, "started_at_ns": _LONG, "updated_at_ns": _LONG, "completed_at_ns": _LONG}
RUN = {"source": _TEXT, "source_run_id": _TEXT, "source_session_id": _TEXT, "parent_run_id": _TEXT, "role": _TEXT, "model": _TEXT, "provider": _TEXT, "effort": _TEXT, "status": _TEXT, "started_at_ns": _LONG, "completed_at_ns": _LONG}
TURN = {"source": _TEXT, "source_turn_id": _TEXT, "source_session_id": _TEXT, "status": _TEXT, "started_at_ns": _LONG, "completed_at_ns": _LONG, "duration_ns": _LONG}
EVENT = (
    {"source": _TEXT, "event_key": _TEXT, "evidence_key": _TEXT, "granularity": _TEXT, "status": _TEXT, "source_session_id": _TEXT, "source_run_id": _TEXT, "provider": _TEXT, "api": _TEXT, "model": _TEXT, "response_model": _TEXT, "service_tier": _TEXT, "speed": _TEXT, "inference_region": _TEXT, "effort": _TEXT}
    | {"stop_reason": _TEXT, "success": "boolean", "error_category": _TEXT, "original_decimal": _TEXT, "conflict": "boolean"}
    | dict.fromkeys([*TOKENS, *COSTS, "web_search_count", "web_fetch_count", "started_at_ns", "completed_at_ns", "duration_ns"], _LONG)
)
LINK = {"source": _TEXT, "evidence_key": _TEXT, "observation_key": _TEXT, "event_key": _TEXT, "method": _TEXT, "role": _TEXT}
ISSUE = {"source": _TEXT, "scope": _TEXT, "category": _TEXT, "severity": _TEXT, "identifier": _TEXT, "field_path": _TEXT, "value_type": _TEXT, "opened": _LONG, "resolved": _LONG}
#: What tells issues apart, nulls included.
IDENTITY = ["source", "category", "identifier", "field_path"]
KEYS = {"sessions": "source_session_id", "runs": "source_run_id", "turns": "source_turn_id", "events": "evidence_key", "links": "evidence_key", "issues": "scope"}
SCHEMAS = {"sessions": SESSION, "runs": RUN, "turns": TURN, "events": EVENT, "links": LINK, "issues": ISSUE}


def conform(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """rows with exactly the columns of a schema; those that rows hasn't are null."""
    has = set(rows.columns)
    return rows.selectExpr(*[f"CAST({f'`{c}`' if c in has else 'NULL'} AS {kind}) AS `{c}`" for c, kind in schema.items()])


def last_known(old: DataFrame | None, new: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Old rows of an entity and new ones in their order as one row for each key, each column with its last known value."""
    schema, key = SCHEMAS[entity], KEYS[entity]
    columns = [c for c in schema if c not in ("source", key)]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in schema.items()], at.alias("_at"))
    if old is not None:
        rows = rows.unionByName(conform(old, schema).withColumn("_at", F.lit(None).cast(rows.schema["_at"].dataType)))
    seq = F.struct(F.col("_at").isNotNull(), "_at")  # what was there before comes first
    return conform(reconcile.coalesce_upsert(rows.where(F.col(key).isNotNull()).withColumn("_seq", seq), ["source", key], columns, "_seq"), schema)


def issue_intervals(old: DataFrame | None, raised: DataFrame, judged: DataFrame | None, version: int) -> DataFrame:
    """ISSUE rows after a sync. An identity has one open row at most.

    old: the rows of the scopes that are touched. raised: what this sync has found (ISSUE without opened and resolved). judged: (scope), whose open
    issues are resolved if they aren't raised again; those of other scopes stay open. An issue that is raised after it was resolved opens a row
    of its own.
    """
    fields = [c for c in ISSUE if c not in ("opened", "resolved")]
    about = [c for c in fields if c not in IDENTITY]
    new = conform(raised, ISSUE).groupBy(*IDENTITY).agg(F.max(F.struct(*about)).alias("n"))  # groups by null-safe identity
    if old is None:
        return conform(new.select(*IDENTITY, "n.*", F.lit(version).alias("opened")), ISSUE)
    old = conform(old, ISSUE)
    closing = F.coalesce(F.col("_judged"), F.lit(False)) if judged is not None else F.lit(False)
    standing = old.where("resolved IS NULL")
    if judged is not None:
        standing = standing.join(judged.select("scope").distinct().withColumn("_judged", F.lit(True)), "scope", "left")
    a, b = standing.alias("a"), new.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY]
    joined = a.join(b, same, "full")
    again, fresh = F.col("b.n").isNotNull(), F.col("a.opened").isNull()
    rows = joined.select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in IDENTITY], *[F.when(again, F.col(f"b.n.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in about],
        F.when(fresh, F.lit(version)).otherwise(F.col("a.opened")).alias("opened"), F.when(~again & closing, F.lit(version)).alias("resolved"),
    )
    return conform(rows, ISSUE).unionByName(old.where("resolved IS NOT NULL"))
