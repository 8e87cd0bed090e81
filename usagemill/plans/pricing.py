"""API-equivalent value of events by a dated rate card.

A rate card is JSON. Its tables (aliases, models, price periods) are small by nature, since people write them, and they are checked
to be under MAX_CARD_ROWS before they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from usagemill.functions.tables import written
from usagemill.functions.tokens import NANOS, event_total, in_window

RATES = ["input", "cached_input", "cache_write", "cache_write_5m", "cache_write_1h", "output"]
MAX_CARD_ROWS = 20_000
FOREVER = 2**63 - 1
# Tiers and regions that cost nothing extra, and providers that a source implies.
DEFAULT_TIERS = ["auto", "default", "not_available", "standard"]
DEFAULT_REGIONS = ["default", "global", "not_available"]
SOURCE_PROVIDERS = {"codex": "openai", "claude": "anthropic"}

_RATE = "decimal(18,9)"
_RATE_FIELDS = ", ".join(f"{r}: {_RATE}" for r in RATES)
_TIME = f"array<struct<weekdays: array<int>, start_hour_utc: int, end_hour_utc: int, multiplier: {_RATE}>>"
_PRICE = f"struct<effective_from: string, effective_until: string, {_RATE_FIELDS}, long_context: struct<above_input_tokens: bigint, inclusive: boolean, {_RATE_FIELDS}>, tier_multipliers: map<string, {_RATE}>, region_multipliers: map<string, {_RATE}>, time_multipliers: {_TIME}>"
CARD = f"struct<schema_version: int, currency: string, unit_tokens: bigint, provider_aliases: map<string, array<string>>, models: array<struct<provider: string, model: string, pricing_url: string, retrieved_at: string, aliases: array<string>, prices: array<{_PRICE}>>>>"


@dataclass(frozen=True)
class RateTables:
    """provider_aliases (alias, provider); models (provider, alias, model_id); periods (model_id, n, from_us, until_us, price); unit_tokens.

    spans (model_id, from_us, until_us, price) are the stretches of time that exactly one period of a model covers.
    """

    provider_aliases: DataFrame
    models: DataFrame
    periods: DataFrame
    spans: DataFrame
    unit_tokens: int
    #: (problem, what) of what the tables don't show.
    problems: DataFrame


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def load_rate_card(spark: SparkSession, path: str) -> RateTables:
    """The tables of a rate card file; raises if a check finds a problem."""
    rates = rate_tables(spark.read.text(path, wholetext=True).select(F.from_json("value", CARD).alias("card")))
    if problems := [f"{r.problem}: {r.what}" for r in card_checks(rates).limit(20).collect()]:
        raise ValueError(f"the rate card is not sound: {'; '.join(problems)}")
    return rates


def _micros(text: str | None) -> int | None:
    """Microseconds of an ISO time; null for anything else. A time without a zone counts as UTC (and is a problem of the card)."""
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def rate_tables(card: DataFrame) -> RateTables:
    """The tables of a one-row DataFrame with the column card. A card is a file that people write, so it is read at the driver, in one job."""
    spark, first = card.sparkSession, card.select("card").first()
    own = first["card"] if first is not None else None
    if own is None or own["schema_version"] != 1 or own["currency"] != "USD" or not own["unit_tokens"] or own["unit_tokens"] <= 0:
        raise ValueError("not a rate card: schema_version 1, currency USD and unit_tokens over 0 are needed")
    key = lambda x: x.strip(" ").lower()
    aliases = [(key(x), key(provider)) for provider, more in (own["provider_aliases"] or {}).items() for x in dict.fromkeys([provider, *(more or [])])]
    models, periods, problems = [], [], []
    for m in own["models"] or []:
        provider, model = key(m["provider"]), key(m["model"])
        name = f"{provider}/{model}"
        models += [(provider, key(x), name) for x in dict.fromkeys([model, *(m["aliases"] or [])])]
        periods += [(name, n, _micros(p["effective_from"]), _micros(p["effective_until"]), p) for n, p in enumerate(m["prices"] or [])]
        dates = [p[c] for p in m["prices"] or [] for c in ("effective_from", "effective_until") if p[c] is not None]
        problems += [("no prices", name)] * (not m["prices"]) + [("date without a zone", name)] * any(_micros(d) is not None and not datetime.fromisoformat(d).tzinfo for d in dates)
        problems += [("not a time", name)] * any(_micros(d) is None for d in dates) + [("no date of retrieval", name)] * (_micros(m["retrieved_at"]) is None)
    if max(len(aliases), len(models), len(periods)) > MAX_CARD_ROWS:
        raise ValueError(f"a rate card has at most {MAX_CARD_ROWS} rows a table")
    price_type = card.schema["card"].dataType["models"].dataType.elementType["prices"].dataType.elementType
    span = StructType([StructField("model_id", StringType()), StructField("from_us", LongType()), StructField("until_us", LongType()), StructField("price", price_type)])
    period = StructType([span["model_id"], StructField("n", IntegerType()), span["from_us"], span["until_us"], span["price"]])
    rows = [dict(zip(("model_id", "n", "from_us", "until_us", "price"), p, strict=True)) for p in periods]
    return RateTables(
        spark.createDataFrame(aliases, "alias string, provider string"), spark.createDataFrame(models, "provider string, alias string, model_id string"), spark.createDataFrame(periods, period),
        spark.createDataFrame(_spans(rows), span), own["unit_tokens"], spark.createDataFrame(problems, "problem string, what string"),
    )


def _spans(periods: list) -> list[tuple]:
    """C14: an instant has a price only if exactly one period of its model holds it; periods without an end go on for good."""
    out = []
    for model in sorted({p["model_id"] for p in periods}):
        own = [(p["from_us"], FOREVER if p["until_us"] is None else p["until_us"], p["price"]) for p in periods if p["model_id"] == model and p["from_us"] is not None]
        cuts = sorted({x for lo, hi, _ in own for x in (lo, hi)})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            held = [price for a, b, price in own if a <= lo and hi <= b]
            if len(held) == 1:
                out.append((model, lo, hi, held[0]))
    return out


def card_checks(rates: RateTables) -> DataFrame:
    """(problem, what); no row for a sound card."""
    p = rates.periods
    a, b = p.alias("a"), p.alias("b")
    before = lambda x, y: F.coalesce(F.col(f"{x}.from_us") < F.col(f"{y}.until_us"), F.lit(True))
    overlap = a.join(b, (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.n") < F.col("b.n")) & before("a", "b") & before("b", "a")).select(F.lit("overlapping periods").alias("problem"), F.col("a.model_id").alias("what"))
    twice = lambda t, keys, problem: t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(problem).alias("problem"), F.concat_ws("/", *keys).alias("what"))
    empty = p.where("until_us <= from_us").select(F.lit("empty period").alias("problem"), F.col("model_id").alias("what"))
    undated = p.where("from_us IS NULL").select(F.lit("undated period").alias("problem"), F.col("model_id").alias("what"))
    no_rate = p.where(F.coalesce(*[F.col(f"price.{r}") for r in RATES]).isNull()).select(F.lit("no rate").alias("problem"), F.col("model_id").alias("what"))
    rules = p.select("model_id", F.posexplode("price.time_multipliers").alias("i", "r"), F.col("price.time_multipliers").alias("all"))
    clash = rules.where(F.exists("all", lambda x: (x != F.col("r")) & F.arrays_overlap(x.weekdays, F.col("r.weekdays")) & (x.start_hour_utc < F.col("r.end_hour_utc")) & (F.col("r.start_hour_utc") < x.end_hour_utc)))
    clashing = clash.select(F.lit("overlapping time rules").alias("problem"), F.col("model_id").alias("what")).distinct()
    out = twice(rates.provider_aliases.select("alias"), ["alias"], "provider alias twice")
    for more in (rates.problems, twice(rates.models, ["provider", "alias"], "model alias twice"), overlap, empty, undated, no_rate, clashing):
        out = out.unionByName(more)
    return out


_NAMES = ["source", "provider", "resolved_model", "requested_model"]


def _resolved(rows: DataFrame, rates: RateTables) -> DataFrame:
    """Rows with model_id and model_provider of the first of resolved and requested model that the card knows.

    Distinct names are resolved once, as a written table, which is then joined by one key; names are few, but their number is checked.
    """
    key = lambda: F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in _NAMES])
    names = written(_names_resolved(rows.select(*_NAMES).distinct(), rates).withColumn("_names", key()).select("_names", *[F.col(c).alias(f"_n_{c}") for c in _NAMES], "model_id", "model_provider", "_card_provider"))
    few = names.limit(MAX_CARD_ROWS + 1).count() <= MAX_CARD_ROWS
    same = F.col("_names") == F.col("_key")
    for c in _NAMES:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    return rows.withColumn("_key", key()).join(F.broadcast(names) if few else names, same, "left").drop("_key", "_names", *[f"_n_{c}" for c in _NAMES])


def _names_resolved(rows: DataFrame, rates: RateTables) -> DataFrame:
    alias = rates.provider_aliases.select(F.col("alias").alias("_alias"), F.col("provider").alias("_canonical"))
    by_provider = rates.models.select(F.col("provider").alias("_mp"), F.col("alias").alias("_ma"), F.col("model_id").alias("_mid"))
    single = rates.models.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.first("provider").alias("_up"), F.first("model_id").alias("_uid")).where("n = 1").select(F.col("alias").alias("_ua"), "_up", "_uid")
    own = F.coalesce("provider", *[F.when(F.col("source") == s, F.lit(p)) for s, p in SOURCE_PROVIDERS.items()])
    out = rows.withColumn("_own", _key(own)).join(F.broadcast(alias), F.col("_own") == F.col("_alias"), "left")
    out = out.withColumn("_own", F.coalesce("_canonical", "_own")).drop("_alias", "_canonical")
    found, maker = [], []
    for i, name in enumerate(("resolved_model", "requested_model")):
        key = _key(F.col(name))
        scoped = F.contains(key, F.lit("/"))
        out = out.withColumns({f"_p{i}": F.when(scoped, F.substring_index(key, "/", 1)), f"_m{i}": F.when(scoped, F.substr(key, F.instr(key, "/") + 1, F.length(key))).otherwise(key)})
        out = out.join(F.broadcast(alias), F.col(f"_p{i}") == F.col("_alias"), "left")
        out = out.withColumn(f"_p{i}", F.coalesce(F.nullif("_own", F.lit("")), F.coalesce("_canonical", f"_p{i}"))).drop("_alias", "_canonical")
        out = out.join(F.broadcast(by_provider), (F.col(f"_p{i}") == F.col("_mp")) & (F.col(f"_m{i}") == F.col("_ma")), "left")
        out = out.join(F.broadcast(single), F.col(f"_p{i}").isNull() & (F.col(f"_m{i}") == F.col("_ua")), "left")
        out = out.withColumns({f"_f{i}": F.coalesce("_mid", "_uid"), f"_w{i}": F.coalesce("_mp", "_up")}).drop("_mp", "_ma", "_mid", "_ua", "_up", "_uid")
        found.append(f"_f{i}")
        maker.append(f"_w{i}")
    out = out.withColumns({"model_id": F.coalesce(*found), "model_provider": F.when(F.col("_f0").isNotNull(), F.col("_w0")).otherwise(F.col("_w1"))})
    return out.withColumn("_card_provider", F.when(F.col("provider").isNotNull(), F.col("_own"))).drop("_own", *[f"_{k}{i}" for k in "pmfw" for i in (0, 1)])


def _multiplier(values: list[str], defaults: list[str], configured: Column) -> Column:
    """1 if only defaults are named, the rate of the one other name, null for two or an unknown one."""
    named = F.array_except(F.array_distinct(F.array_compact(F.array(*[_key(F.col(v)) for v in values]))), F.array(*[F.lit(d) for d in defaults]))
    return F.when(F.size(named) == 0, F.lit(1).cast(_RATE)).when(F.size(named) == 1, F.try_element_at(configured, F.get(named, F.lit(0))))


def price(rows: DataFrame, rates: RateTables) -> DataFrame:
    """Reporting rows with est_provider and est_nanos: the reported cost, else the rate card's; null if neither is known."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    codex = F.col("source") == "codex"
    fine, hour = zero("cache_write_5m_tokens"), zero("cache_write_1h_tokens")
    fresh = zero("input_tokens") - F.when(codex, zero("cache_read_tokens")).otherwise(F.lit(0))
    parts = {"input": fresh, "cached_input": zero("cache_read_tokens"), "cache_write": zero("cache_write_tokens") - fine - hour, "cache_write_5m": fine, "cache_write_1h": hour, "output": zero("output_tokens")}
    context = zero("input_tokens") + zero("cache_write_tokens") + F.when(codex, F.lit(0)).otherwise(zero("cache_read_tokens"))
    total = sum(parts.values(), F.lit(0))
    at = F.expr("(occurred_at_ns - pmod(occurred_at_ns, 1000)) div 1000")
    rows = _resolved(rows, rates)
    spans = F.broadcast(rates.spans.select(F.col("model_id").alias("_pid"), F.col("from_us").alias("_from"), F.col("until_us").alias("_until"), F.col("price").alias("_price")))
    out = rows.withColumn("_at", at)
    inside = (F.col("model_id") == F.col("_pid")) & (F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_until"))
    out = out.join(spans, inside, "left")
    long_one = F.col("_price.long_context")
    is_long = long_one.isNotNull() & (F.col("granularity") == "model_call") & ((context > long_one.above_input_tokens) | (F.coalesce(long_one.inclusive, F.lit(False)) & (context == long_one.above_input_tokens)))
    cost, known = F.lit(0).cast("decimal(25,6)"), F.lit(True)
    exact = NANOS % rates.unit_tokens == 0
    scale = F.lit(Decimal(NANOS // rates.unit_tokens) if exact else Decimal(NANOS) / rates.unit_tokens).cast("decimal(10,0)" if exact else "decimal(20,10)")
    for name, tokens in parts.items():
        rate = F.when(is_long, long_one.getField(name)).otherwise(F.col(f"_price.{name}"))
        per_token = (rate * scale).cast("decimal(15,6)")
        cost = (cost + F.coalesce(tokens.cast("decimal(15,0)") * per_token, F.lit(0))).cast("decimal(25,6)")
        known = known & ((tokens == 0) | rate.isNotNull())
    minute = F.timestamp_micros(F.col("_at"))
    rule = F.filter("_price.time_multipliers", lambda r: F.array_contains(r.weekdays, F.weekday(minute)) & (r.start_hour_utc <= F.hour(minute)) & (F.hour(minute) < r.end_hour_utc))
    timed = F.coalesce(F.get(rule, F.lit(0)).multiplier, F.lit(1).cast(_RATE))
    factor = (_multiplier(["speed", "service_tier"], DEFAULT_TIERS, F.col("_price.tier_multipliers")) * _multiplier(["inference_region"], DEFAULT_REGIONS, F.col("_price.region_multipliers"))).cast("decimal(12,6)")
    factor = (factor * timed.cast("decimal(12,6)")).cast("decimal(12,6)")
    sound = F.col("_price").isNotNull() & (fine + hour <= zero("cache_write_tokens")) & (~codex | (zero("cache_read_tokens") <= zero("input_tokens"))) & (total == event_total()) & known
    nanos = F.when(sound, F.round(cost * factor, 0).cast("long"))
    reported = F.col("total_cost_nanos").isNotNull()
    out = out.withColumn("est_nanos", F.when(reported, F.col("total_cost_nanos")).otherwise(nanos))
    provider = F.when(reported, F.coalesce(F.nullif("_card_provider", F.lit("")), F.col("source"))).otherwise(F.col("model_provider"))
    out = out.withColumn("est_provider", F.when(F.col("est_nanos").isNotNull(), provider))
    return out.drop("_pid", "_from", "_until", "_price", "_at", "model_id", "model_provider", "_card_provider")


def api_value(priced: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """One row of cost, priced and all tokens and events; G11: shown tells whether at least 95 % of tokens are priced."""
    rows = priced.where(in_window(window)).withColumn("_t", event_total())
    known = F.col("est_nanos").isNotNull()
    out = rows.agg(
        F.coalesce(F.sum("est_nanos"), F.lit(0)).alias("cost_nanos"),
        F.coalesce(F.sum(F.when(known, F.col("_t"))), F.lit(0)).alias("priced_tokens"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("total_tokens"),
        F.count("est_nanos").alias("priced_events"),
        F.count(F.lit(1)).alias("total_events"),
    )
    return out.withColumn("shown", (F.col("total_tokens") > 0) & (F.col("priced_tokens") * 100 >= F.col("total_tokens") * 95))


def api_value_by_provider(priced: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """The priced rows by provider."""
    rows = priced.where(in_window(window) & F.col("est_nanos").isNotNull()).withColumn("_t", event_total())
    return rows.groupBy(F.col("est_provider").alias("provider")).agg(F.sum("est_nanos").alias("cost_nanos"), F.sum("_t").alias("priced_tokens"), F.count(F.lit(1)).alias("priced_events"))
