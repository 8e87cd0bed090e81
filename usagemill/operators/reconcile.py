"""From observations to one counted usage event each: counters, snapshots, dominance folds and upserts.

All rules are windows, aggregates and folds by a semantic key. A key's rows are the revisions of one event or one stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagemill.functions.tokens import dominates

# ---- counters ------------------------------------------------------------------------------------------------------------


def counter_delta(rows: DataFrame, fields: list[str], owner: str = "owner", artifact: str = "artifact", ordinal: str = "ordinal") -> DataFrame:
    """Rows (total_<field>, last_<field>) of cumulative counters with the tokens <field> that each row adds.

    A stream is an owner's rows in an artifact. Its first row, and one on which a field that both rows have fell, count their `last` values.
    Else a field counts the difference to the row before, or its `last` value where the row before hadn't the field.
    """
    stream = Window.partitionBy(owner, artifact).orderBy(ordinal)
    before = F.lag(F.struct(*[F.col(f"total_{f}").alias(f) for f in fields])).over(stream)
    out = rows.withColumn("_before", before)
    fell = F.lit(False)
    for f in fields:
        fell = fell | F.coalesce(F.col(f"total_{f}") < F.col(f"_before.{f}"), F.lit(False))
    reset = F.col("_before").isNull() | fell
    delta = lambda f: F.when(reset, F.col(f"last_{f}")).when(F.col(f"total_{f}").isNotNull(), F.when(F.col(f"_before.{f}").isNotNull(), F.col(f"total_{f}") - F.col(f"_before.{f}")).otherwise(F.col(f"last_{f}")))
    return out.withColumns({f: delta(f) for f in fields}).drop("_before")


def fingerprint(columns: list[str]) -> Column:
    """D3: the semantic key of an observation."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def repeat_occurrence(rows: DataFrame, fields: list[str], key: str = "fingerprint", owner: str = "owner", artifact: str = "artifact", ordinal: str = "ordinal") -> DataFrame:
    """Rows with occurrence: how often the key has come back in the artifact with a positive delta so far."""
    order = Window.partitionBy(owner, artifact, key).orderBy(ordinal)
    positive = F.coalesce(F.greatest(*[F.col(f) for f in fields], F.lit(0)), F.lit(0)) > 0
    again = ((F.row_number().over(order) > 1) & positive).cast("int")
    numbered = rows.withColumn("_again", again)
    return numbered.withColumn("occurrence", F.sum("_again").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_again")


def counter_events(rows: DataFrame, fields: list[str], key: str = "fingerprint", owner: str = "owner", artifact: str = "artifact", ordinal: str = "ordinal") -> DataFrame:
    """One event for each owner, key and occurrence: the earliest artifact's tokens, whether artifacts disagree, and its status."""
    tokens = F.struct(*fields)
    first = rows.groupBy(owner, key, "occurrence", artifact).agg(F.min_by(tokens, ordinal).alias("t"), F.min(ordinal).alias("o"))
    won = first.groupBy(owner, key, "occurrence").agg(F.min_by("t", F.struct(artifact, "o")).alias("t"), (F.countDistinct("t") > 1).alias("conflict"))
    positive = F.coalesce(F.greatest(*[F.col(f"t.{f}") for f in fields], F.lit(0)), F.lit(0)) > 0
    return won.select(owner, key, "occurrence", *[F.col(f"t.{f}").alias(f) for f in fields], "conflict", F.when(positive, "canonical").otherwise("excluded").alias("status"))


def retire_stale(events: DataFrame, produced: DataFrame, key: str = "event_key") -> DataFrame:
    """Events with status excluded where their key isn't produced any more."""
    now = produced.select(key).distinct().withColumn("_live", F.lit(True))
    return events.join(now, key, "left").withColumn("status", F.when(F.col("_live"), F.col("status")).otherwise("excluded")).drop("_live")


# ---- snapshots -----------------------------------------------------------------------------------------------------------


def component_max(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Component-wise maximum; what no row has stays null."""
    return rows.groupBy(*keys).agg(*[F.max(f).alias(f) for f in fields])


def first_known_time(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The first positive time in order, so that revisions don't move the day."""
    return rows.groupBy(*keys).agg(F.min_by(F.when(F.col(at) > 0, F.col(at)), F.when(F.col(at) > 0, F.col(order))).alias(at))


def residual(outer: DataFrame, iterations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Outer minus the sum of the normal iterations; conflict if any component is negative, residual if any is positive."""
    sums = iterations.where(~F.col("is_advisor")).groupBy(key).agg(*[F.sum(f).alias(f"_s_{f}") for f in fields])
    joined = outer.join(sums, key, "left")
    rest = {f: F.coalesce(F.col(f), F.lit(0)) - F.coalesce(F.col(f"_s_{f}"), F.lit(0)) for f in fields}
    out = joined.select(key, *[r.alias(f) for f, r in rest.items()])
    conflict, positive = F.least(*[F.col(f) for f in fields], F.lit(0)) < 0, F.greatest(*[F.col(f) for f in fields], F.lit(0)) > 0
    return out.withColumns({"conflict": conflict, "has_residual": positive & ~conflict})


def coherent_state(snapshots: DataFrame, iterations: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, idx, is_advisor, fields, conflict) and the outer row (idx null): the running maxima at the last coherent snapshot.

    snapshots: (key, order, fields); iterations: (key, order, idx, is_advisor, fields). If the final state conflicts, it rolls back to the last snapshot
    at which the sum of normal iterations didn't exceed the outer tokens; advisors are taken from the final state.
    """
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = snapshots.select(key, order, *[F.max(f).over(upto).alias(f) for f in fields])
    slots = iterations.select(key, "idx").distinct()
    grid = outer.select(key, order).join(slots, key).join(iterations, [key, "idx", order], "left")
    run = Window.partitionBy(key, "idx").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col("is_advisor").isNotNull(), F.col("is_advisor"))).over(run)
    grid = grid.select(key, order, "idx", seen.alias("is_advisor"), *[F.max(f).over(run).alias(f) for f in fields]).where("is_advisor IS NOT NULL")
    sums = grid.where("NOT is_advisor").groupBy(key, order).agg(*[F.sum(f).alias(f"_s_{f}") for f in fields])
    state = outer.join(sums, [key, order], "left")
    bad = F.lit(False)
    for f in fields:
        bad = bad | (F.coalesce(F.col(f"_s_{f}"), F.lit(0)) > F.coalesce(F.col(f), F.lit(0)))
    chosen = state.groupBy(key).agg(F.max(order).alias("_last"), F.max(F.when(~bad, F.col(order))).alias("_good"))
    chosen = chosen.withColumns({"_at": F.coalesce("_good", "_last"), "conflict": F.col("_good").isNull()})
    normal = grid.join(chosen, key).where((~F.col("is_advisor") & (F.col(order) == F.col("_at"))) | (F.col("is_advisor") & (F.col(order) == F.col("_last"))))
    rows = normal.select(key, "idx", "is_advisor", *fields, (F.col("conflict") & ~F.col("is_advisor")).alias("conflict"))
    whole = outer.join(chosen, key).where(F.col(order) == F.col("_at")).select(key, F.lit(None).cast("long").alias("idx"), F.lit(False).alias("is_advisor"), *fields, "conflict")
    return rows.unionByName(whole)


def iteration_status() -> Column:
    """Advisors always count; normal iterations of a conflict don't."""
    return F.when(F.col("is_advisor") | ~F.col("conflict"), "canonical").otherwise("conflicted")


# ---- dominance -----------------------------------------------------------------------------------------------------------


def dominance_fold(rows: DataFrame, keys: list[str], order: list[str], total: str, fields: list[str]) -> DataFrame:
    """Revisions in order; one replaces the state if its total and every component are at least the state's.

    A fold, not a maximum. A key's revisions are gathered, so keys have to be those of single events.
    """
    entry = F.struct(*order, F.col(total), *fields)
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    names = [total, *fields]
    return listed.select(*keys, fold(F.col("_rows"), names).alias("_s")).select(*keys, *[F.col(f"_s.{n}").alias(n) for n in names])


def fold(revisions: Column, names: list[str]) -> Column:
    """The revision that stands after all of an array, which is in order."""
    better = lambda a, x: dominates([x[n] for n in names], [a[n] for n in names])
    return F.aggregate(F.slice(revisions, F.lit(2), F.greatest(F.size(revisions) - 1, F.lit(0))), F.get(revisions, F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))


def folded_revisions(rows: DataFrame, keys: list[str], order: list[str], total: str, fields: list[str], cost: str, at: str) -> DataFrame:
    """The last row of each key with the tokens that `dominance_fold` gives, the largest cost and the first positive time.

    Rows are dealt and sorted by key once; only keys with several revisions are folded.
    """
    upto = Window.partitionBy(*keys).orderBy(*order)
    every = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [total, *fields]
    first = F.first(F.when(F.col(at) > 0, F.col(at)), ignorenulls=True).over(every)
    listed = rows.withColumns({"_place": F.row_number().over(upto), "_n": F.count(F.lit(1)).over(every), "_rows": F.collect_list(F.struct(*names)).over(every), "_cost": F.max(cost).over(every), "_at": first})
    last = listed.where("_place = _n").withColumn("_s", F.when(F.col("_n") > 1, fold(F.col("_rows"), names)).otherwise(F.struct(*names)))
    return last.withColumns({n: F.col(f"_s.{n}") for n in names} | {cost: F.col("_cost"), at: F.col("_at")}).drop("_place", "_n", "_rows", "_cost", "_at", "_s")


def cost_max(rows: DataFrame, keys: list[str], order: list[str], total: str, decimal: str, components: list[str], provenance: list[str]) -> DataFrame:
    """Maxima of the cost components; the provenance of the row that first had the largest total, one with its decimal text before one without."""
    first = F.struct(-F.col(total), F.col(decimal).isNull(), *order)
    picked = F.min_by(F.struct(decimal, *provenance), F.when(F.col(total).isNotNull(), first)).alias("_p")
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in [*components, total]], picked).select(*keys, *components, total, "_p.*")


def terminal_first(rows: DataFrame, keys: list[str], terminal: str, order: list[str], fields: list[str], start: str, end: str) -> DataFrame:
    """The latest terminal snapshot, else the latest; start is the earliest, and duration isn't negative."""
    rank = F.struct(F.col(terminal), *order)
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields, F.col(end)), rank).alias("_r"), F.min(start).alias(start), F.max(terminal).alias(terminal))
    return out.select(*keys, "_r.*", start, terminal).withColumn("duration", F.greatest(F.col(end) - F.col(start), F.lit(0)))


def revise(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], cost: str, at: str) -> DataFrame:
    """Tokens replaced where the new ones dominate; the larger cost and the first date stay."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*fields, cost, at]], F.lit(True).alias("_has_new"))
    o = old.withColumn("_has_old", F.lit(True))
    joined = o.join(n, keys, "full")
    take = F.col("_has_old").isNull() | (F.coalesce(F.col("_has_new"), F.lit(False)) & dominates([F.col(f"_n_{f}") for f in fields], [F.col(f) for f in fields]))
    return joined.select(*keys, *[F.when(take, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields], F.greatest(cost, f"_n_{cost}").alias(cost), F.coalesce(at, f"_n_{at}").alias(at))


def side(parts: list[Column], fallback: list[Column], has_parts: Column, has_fallback: Column, now: Column | None = None) -> Column:
    """Parts or fallback: the only side there is, else the one that dominates, else what counts now (true for fallback), else parts."""
    now = F.lit(False) if now is None else now
    return F.when(~has_parts, "fallback").when(~has_fallback, "parts").when(dominates(parts, fallback), "parts").when(dominates(fallback, parts), "fallback").when(now, "fallback").otherwise("parts")


def parts_or_fallback(parts: DataFrame, fallback: DataFrame, key: str, fields: list[str], current: str | None = None) -> DataFrame:
    """Per message, the sum of its parts or its fallback, whichever dominates; else what counts now (column current of fallback: true for fallback), else parts."""
    sums = parts.groupBy(key).agg(*[F.sum(f).alias(f"_p_{f}") for f in fields], F.count(F.lit(1)).alias("_parts"))
    joined = fallback.withColumn("_has", F.lit(True)).join(sums, key, "full")
    p, f = [F.col(f"_p_{x}") for x in fields], [F.col(x) for x in fields]
    now = F.coalesce(F.col(current), F.lit(False)) if current else F.lit(False)
    choice = side(p, f, F.col("_parts").isNotNull(), F.col("_has").isNotNull(), now)
    return joined.withColumn("counts", choice).select(key, "counts", *[F.when(F.col("counts") == "parts", a).otherwise(b).alias(x) for x, a, b in zip(fields, p, f, strict=True)])


# ---- upserts -------------------------------------------------------------------------------------------------------------


def coalesce_upsert(rows: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """Each column's last non-null value by seq."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def replace_upsert(rows: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """All columns of the last row, nulls included."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_r")).select(*keys, "_r.*")


def keep_first(rows: DataFrame, keys: list[str], columns: list[str], seq: str = "seq") -> DataFrame:
    """The first row of a key; later ones are ignored."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), seq).alias("_r")).select(*keys, "_r.*")


def issue_upsert(active: DataFrame, found: DataFrame, cleared: DataFrame, keys: list[str]) -> DataFrame:
    """One active issue for each identity, null-safe; those that are cleared go."""
    every = active.select(*keys, "first_seen").unionByName(found.select(*keys, "first_seen")).groupBy(*keys).agg(F.min("first_seen").alias("first_seen")).alias("i")
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return every.join(cleared.select(*keys).distinct().alias("c"), same, "left_anti")


def write_stats(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row of inserted and updated counts between two states of a table."""
    b = before.select(*keys, F.struct(*columns).alias("_b"), F.lit(True).alias("_was"))
    joined = after.select(*keys, F.struct(*columns).alias("_a")).join(b, keys, "left")
    return joined.agg(F.count(F.when(F.col("_was").isNull(), 1)).alias("inserted"), F.count(F.when(F.col("_was") & ~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("updated"))


def change_set(*keys: DataFrame) -> DataFrame:
    """The distinct keys of several one-column frames."""
    out = keys[0]
    for more in keys[1:]:
        out = out.unionByName(more)
    return out.distinct()
