"""Ledger-shaped views over the driver's tables, so that the registered queries work on given data.

Each view is one SELECT that Spark and DuckDB both read; its tables stand in braces. This is a test harness, not the product: the
operators take DataFrames of the shapes below from wherever they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # counted events of agents; keys repeat, which is fine for reporting
    "usage": """
SELECT CASE l_suppkey % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'pi' ELSE 'opencode' END AS source,
  CASE WHEN l_returnflag = 'A' THEN 'canonical' WHEN l_returnflag = 'N' THEN 'provisional' WHEN l_linestatus = 'O' THEN 'excluded' ELSE 'conflicted' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 'model_call' ELSE 'counter_delta' END AS granularity,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'OpenAI' WHEN p_size % 5 = 2 THEN 'anthropic' WHEN p_size % 5 = 3 THEN ' Google ' ELSE 'local' END AS provider,
  CASE WHEN l_linenumber % 3 = 0 THEN p_brand END AS response_model,
  CASE WHEN l_linenumber % 2 = 0 THEN p_type END AS model,
  CASE WHEN l_linenumber % 5 = 0 THEN 'priority' WHEN l_linenumber % 5 = 1 THEN 'default' END AS service_tier,
  CASE WHEN l_linenumber % 7 = 3 THEN 'fast' END AS speed,
  CASE WHEN l_suppkey % 11 = 0 THEN 'eu' WHEN l_suppkey % 11 = 1 THEN 'global' END AS inference_region,
  CASE WHEN l_suppkey % 3 = 0 THEN 'high' WHEN l_suppkey % 3 = 1 THEN 'low' END AS effort,
  CASE WHEN l_suppkey % 2 = 0 THEN 'responses' END AS api,
  CAST(l_quantity AS BIGINT) * 100 AS input_tokens,
  CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT) AS output_tokens,
  CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS BIGINT) * l_linenumber END AS cache_read_tokens,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS BIGINT) * 2 END AS cache_write_tokens,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS BIGINT) END AS cache_write_5m_tokens,
  CASE WHEN l_linenumber % 8 = 4 THEN CAST(l_quantity AS BIGINT) END AS cache_write_1h_tokens,
  CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) END AS reasoning_tokens,
  CASE WHEN l_linenumber > 5 THEN CAST(l_quantity AS BIGINT) * 1000 END AS reported_total_tokens,
  CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) * 500 END AS derived_total_tokens,
  CASE WHEN l_discount >= 0.05 THEN CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * 10000000 AS BIGINT) END AS total_cost_nanos,
  CASE WHEN l_linenumber <> 7 THEN {seconds(l_shipdate)} * 1000000000 + l_suppkey END AS started_at_ns,
  CAST(NULL AS BIGINT) AS completed_at_ns,
  CASE WHEN l_linenumber > 4 THEN CAST(l_orderkey AS {text}) || '/' || CAST(l_linenumber AS {text}) END AS source_run_id,
  CASE WHEN l_linenumber <> 6 THEN CAST(l_orderkey AS {text}) END AS source_session_id
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "sessions": """
SELECT CAST(o_orderkey AS {text}) AS source_session_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST({div(o_orderkey, 3)} AS {text}) END AS parent_session_id,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS current_model, CAST(NULL AS {text}) AS initial_model,
  CASE WHEN o_orderstatus = 'F' THEN 'openai' END AS provider, CASE WHEN o_orderkey % 4 = 0 THEN 'flex' END AS service_tier,
  {seconds(o_orderdate)} * 1000000000 AS started_at_ns, CAST(NULL AS BIGINT) AS updated_at_ns, CAST(NULL AS BIGINT) AS completed_at_ns
FROM {orders}""",
    "runs": """
SELECT DISTINCT CAST(l_orderkey AS {text}) || '/' || CAST(l_linenumber AS {text}) AS source_run_id, CAST(l_orderkey AS {text}) AS source_session_id,
  CASE WHEN l_linenumber > 5 THEN CAST(l_orderkey AS {text}) END AS parent_run_id, CASE WHEN l_linenumber = 7 THEN 'run-model' END AS model,
  CAST(NULL AS {text}) AS provider, CAST(NULL AS BIGINT) AS started_at_ns, CAST(NULL AS BIGINT) AS completed_at_ns
FROM {lineitem} WHERE l_linenumber > 4""",
    # cumulative counters of a stream
    "counter": """
SELECT user_id AS owner, event_id % 3 AS artifact, event_id AS ordinal, {seconds(ts)} AS observed_at,
  CAST({k(props)} AS BIGINT) AS total_input, CASE WHEN event_id % 5 <> 0 THEN {div(CAST({k(props)} AS BIGINT), 2)} END AS total_output,
  {div(CAST({k(props)} AS BIGINT), 2)} AS last_input, CASE WHEN event_id % 7 <> 0 THEN {div(CAST({k(props)} AS BIGINT), 4)} END AS last_output
FROM {events}""",
    # snapshots of a message
    "snapshot": """
SELECT conv_id AS message, turn AS seq, role, CAST(turn % 3 AS BIGINT) AS idx, CAST(length(text) AS BIGINT) AS output_tokens,
  CASE WHEN turn % 4 <> 1 THEN CAST(length(text) AS BIGINT) % 50 END AS input_tokens, CASE WHEN turn % 5 <> 2 THEN turn * 1000 END AS observed_at
FROM {conversations}""",
    # revisions of an event, with a full order
    "revision": """
SELECT l_orderkey AS order_key, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
  CAST(l_quantity AS BIGINT) AS input_tokens, CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT) AS output_tokens,
  CASE WHEN l_discount >= 0.05 THEN CAST(l_quantity AS BIGINT) * 7 END AS cost_nanos, l_returnflag = 'A' AS terminal, {seconds(l_shipdate)} AS observed_at
FROM {lineitem}""",
    "parts": """
SELECT l_orderkey AS message, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS input_tokens, CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 2))) AS BIGINT) AS output_tokens
FROM {lineitem}""",
    "fallback": """
SELECT o_orderkey AS message, CAST(o_custkey AS BIGINT) % 200 AS input_tokens, CAST(floor(CAST(o_totalprice AS DECIMAL(18, 2))) AS BIGINT) AS output_tokens, o_orderstatus = 'O' AS counted
FROM {orders}""",
    "upsert": """
SELECT user_id AS id, event_id AS seq, CASE WHEN event_type <> 'click' THEN event_type END AS kind, CASE WHEN event_id % 3 <> 0 THEN CAST({k(props)} AS BIGINT) END AS amount,
  {seconds(ts)} AS seen_at
FROM {events}""",
}

_SPARK = {"text": "STRING", "seconds": "unix_seconds(CAST({} AS TIMESTAMP))", "div": "({} div {})", "k": "get_json_object({}, '$.k')"}
_DUCK = {"text": "VARCHAR", "seconds": "CAST(floor(epoch({})) AS BIGINT)", "div": "({} // {})", "k": "json_extract_string({}, '$.k')"}
_TABLES = ("lineitem", "part", "orders", "events", "conversations")


def _filled(sql: str, engine: dict[str, str], table) -> str:
    import re

    for name in ("k", "seconds"):
        sql = re.sub(r"\{" + name + r"\((\w+)\)\}", lambda m, n=name: engine[n].format(m[1]), sql)
    sql = re.sub(r"\{div\((.+?), (\d+)\)\}", lambda m: engine["div"].format(m[1], m[2]), sql)
    sql = sql.replace("{text}", engine["text"])
    for name in _TABLES:
        sql = sql.replace("{" + name + "}", table(name))
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    return spark.sql(_filled(VIEWS[name], _SPARK, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def ctes(*names: str) -> str:
    """`WITH v_... AS (...)` of views for DuckDB, in the order given."""
    return "WITH RECURSIVE " + ", ".join(f"v_{n} AS ({_filled(VIEWS[n], _DUCK, lambda t: t)})" for n in names)


#: A small rate card in the shape of a rate card file.
RATE_CARD = {
    "schema_version": 1, "currency": "USD", "unit_tokens": 1_000_000,
    "provider_aliases": {"openai": ["open-ai"], "anthropic": ["claude"], "google": ["google-generative-ai"]},
    "models": [
        {"provider": "openai", "model": "economy", "retrieved_at": "1998-02-01", "aliases": ["promo"], "prices": [
            {"effective_from": "1990-01-01T00:00:00Z", "effective_until": "1998-01-01T00:00:00Z", "input": 1, "cached_input": 0.1, "cache_write": 1.25, "cache_write_5m": 1.5, "cache_write_1h": 2, "output": 4},
            {"effective_from": "1998-01-01T00:00:00Z", "input": 2, "cached_input": 0.2, "cache_write": 3, "cache_write_5m": 4, "cache_write_1h": 5, "output": 10,
             "long_context": {"above_input_tokens": 2500, "inclusive": False, "input": 4, "cached_input": 0.4, "cache_write": 6, "cache_write_5m": 8, "cache_write_1h": 10, "output": 15},
             "tier_multipliers": {"fast": 2, "priority": 1.5}, "region_multipliers": {"eu": 1.1},
             "time_multipliers": [{"weekdays": [0, 1, 2], "start_hour_utc": 0, "end_hour_utc": 8, "multiplier": 0.5}]}]},
        {"provider": "anthropic", "model": "economy", "retrieved_at": "1998-02-01", "aliases": [], "prices": [{"effective_from": "1990-01-01T00:00:00Z", "input": 3, "cached_input": 0.3, "cache_write": 3.75, "cache_write_5m": 3.75, "output": 15, "tier_multipliers": {"priority": 2}, "region_multipliers": {"eu": 1.25}}]},
        {"provider": "google", "model": "standard", "retrieved_at": "1998-02-01", "aliases": ["brand#2", "medium"], "prices": [{"effective_from": "1996-01-01T00:00:00Z", "effective_until": "2001-01-01T00:00:00Z", "input": 0.5, "output": 2}]},
    ],
}


def rate_card(spark: SparkSession):
    """The small rate card's tables."""
    import json

    from usagemill.plans.pricing import CARD, rate_tables

    return rate_tables(spark.createDataFrame([(json.dumps(RATE_CARD),)], "value string").selectExpr(f"from_json(value, '{CARD}') AS card"))


def codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ordinal, line): a rollout log for each owner and artifact of the counter view, a header first."""
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, "counter")
    usage = lambda p: F.struct(F.col(f"{p}_input").alias("input_tokens"), F.col(f"{p}_output").alias("output_tokens"))
    at = F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat_ws("/", F.col("artifact").cast("string"), F.col("owner").cast("string")).alias("file")
    info = F.struct(usage("total").alias("total_token_usage"), usage("last").alias("last_token_usage"))
    body = F.to_json(F.struct(at.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload")))
    counts = rows.select(name, (F.col("ordinal") + 1).alias("ordinal"), body.alias("line"))
    header = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("owner").cast("string").alias("id"), F.lit("p").alias("model_provider")).alias("payload")))
    return counts.unionByName(rows.select("artifact", "owner").distinct().select(name, F.lit(0).cast("long").alias("ordinal"), header.alias("line")))


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ordinal, line): a transcript for each message of the snapshot view; every fifth turn has an invalid count."""
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, "snapshot")
    usage = F.struct(F.when(F.col("seq") % 5 == 4, F.lit(-1)).otherwise(F.col("input_tokens")).alias("input_tokens"), "output_tokens")
    message = F.struct(F.concat(F.lit("m"), F.col("message").cast("string")).alias("id"), F.lit("model").alias("model"), usage.alias("usage"))
    body = F.to_json(F.struct(F.lit("assistant").alias("type"), F.col("message").cast("string").alias("sessionId"), message.alias("message")))
    return rows.select(F.col("message").cast("string").alias("file"), F.col("seq").alias("ordinal"), body.alias("line"))


def pi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ordinal, line): a session for each order with an assistant message for each of its lines."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.row_number().over(_lines_of_order()).alias("n"), F.col("l_quantity").cast("long").alias("q"), F.floor(F.col("l_extendedprice").cast("decimal(18,2)")).cast("long").alias("p"), "l_linenumber")
    usage = F.struct(F.col("q").alias("input"), F.col("p").alias("output"), F.col("l_linenumber").alias("cacheRead"), F.when(F.col("l_linenumber") < 7, F.lit(0)).alias("cacheWrite"), F.when(F.col("l_linenumber") == 1, F.col("p") + 1).alias("reasoning"))
    body = F.struct(F.lit("message").alias("type"), F.concat(F.lit("e"), F.col("n").cast("string")).alias("id"), F.struct(F.lit("assistant").alias("role"), F.lit("m").alias("model"), usage.alias("usage")).alias("message"))
    name = F.col("l_orderkey").cast("string")
    return rows.select(name.alias("file"), F.col("n").cast("long").alias("ordinal"), F.to_json(body).alias("line")).unionByName(rows.select(name.alias("file")).distinct().select("file", F.lit(0).cast("long").alias("ordinal"), F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("s"), "file").alias("id"))).alias("line")))


def _lines_of_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def opencode_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(session, message, part): a session for each customer, a message for each order, a part for each line with an odd number."""
    from pyspark.sql import functions as F

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    session = orders.select(F.col("o_custkey").cast("string").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("parent_id"), F.lit("1.0.0").alias("version"), F.lit("build").alias("agent"), F.lit(1).cast("long").alias("time_created"), F.lit(2).cast("long").alias("time_updated"))
    tokens = F.struct((F.col("o_orderkey") % 1000).alias("input"), F.lit(1).alias("output"), F.struct(F.lit(2).alias("read"), F.lit(3).alias("write")).alias("cache"))
    data = F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", "assistant").otherwise("user").alias("role"), F.lit("p").alias("providerID"), F.lit("m").alias("modelID"), tokens.alias("tokens")))
    message = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("session_id"), F.lit(1).cast("long").alias("time_created"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("time_updated"), data.alias("data"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    used = F.to_json(F.struct(F.when(F.col("l_linenumber") % 2 == 1, "step-finish").otherwise("text").alias("type"), F.struct(F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").alias("output"), F.lit(1).alias("reasoning")).alias("tokens")))
    part = lines.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.row_number().over(_lines_of_order()).cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("message_id"), F.lit("").alias("session_id"), F.lit(1).cast("long").alias("time_created"), F.lit(1).cast("long").alias("time_updated"), used.alias("data"))
    return session, message, part


#: Files that a log family's owners are dealt to.
SHARDS = 4


def write_logs(rows: DataFrame, folder: str) -> None:
    """Writes (log, place, line) as the files <log>.jsonl of a folder, lines by place; a log that is there already is replaced under its name."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.repartition("log").sortWithinPartitions("log", "place").select("log", "line").write.mode("overwrite").partitionBy("log").text(f"{folder}.parts")
    fs.mkdirs(hadoop(folder))
    for log in fs.listStatus(hadoop(f"{folder}.parts")):
        if "=" in log.getPath().getName():
            (part,) = fs.globStatus(hadoop(f"{log.getPath()}/part-*"))
            to = hadoop(f"{folder}/{log.getPath().getName().split('=', 1)[1]}.jsonl")
            fs.delete(to, False)
            fs.rename(part.getPath(), to)
    fs.delete(hadoop(f"{folder}.parts"), True)


def codex_logs(spark: SparkSession, sf_dir: str, later: bool = True) -> DataFrame:
    """(log, place, line) of codex_lines, several owners in a file: first the stretches of all rows but every seventh; these come after, if at all."""
    from pyspark.sql import functions as F

    rows = codex_lines(spark, sf_dir).withColumns({"artifact": F.substring_index("file", "/", 1), "owner": F.substring_index("file", "/", -1).cast("long")})
    headers, counts = rows.where("ordinal = 0"), rows.where("ordinal > 0").withColumn("phase", ((F.col("ordinal") - 1) % 7 == 0).cast("int"))
    both = headers.join(counts.select("file", "phase").distinct(), "file").select(*counts.columns).unionByName(counts)
    log = F.concat_ws("-", "artifact", (F.col("owner") % SHARDS).cast("string")).alias("log")
    return (both if later else both.where("phase = 0")).select(log, F.struct("phase", "owner", "ordinal").alias("place"), "line")


def claude_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, place, line) of claude_lines, several messages in a file."""
    from pyspark.sql import functions as F

    rows = claude_lines(spark, sf_dir)
    return rows.select((F.col("file").cast("long") % SHARDS).cast("string").alias("log"), F.struct(F.col("file").cast("long").alias("message"), "ordinal").alias("place"), "line")


def pi_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log, place, line): sessions s0 (the root) to s3, each a child of the one before, with the messages of all orders; costs grow with each copy of an entry."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.row_number().over(_lines_of_order()).cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), F.floor(F.col("l_extendedprice").cast("decimal(18,2)")).cast("long").alias("p"))
    cost = F.struct(F.lit(0).alias("input"), (F.col("q") * F.lit(0.001).cast("decimal(5,3)")).alias("total"))
    usage = F.struct(F.col("q").alias("input"), F.col("p").alias("output"), F.lit(0).alias("cacheRead"), F.lit(0).alias("cacheWrite"), cost.alias("cost"))
    entry = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    body = F.struct(F.lit("message").alias("type"), entry.alias("id"), F.struct(F.lit("assistant").alias("role"), F.lit("m").alias("model"), usage.alias("usage")).alias("message"))
    log = (F.col("l_orderkey") % SHARDS).cast("string").alias("log")
    lines = rows.select(log, F.struct(F.lit(1).alias("part"), "l_orderkey", "n").alias("place"), F.to_json(body).alias("line"))
    head = F.struct(F.lit("session").alias("type"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("s"), (F.col("id") - 1).cast("string"))).alias("parentSession"))
    first = spark.range(SHARDS).select(F.col("id").cast("string").alias("log"), F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("l_orderkey"), F.lit(0).cast("long").alias("n")).alias("place"), F.to_json(head).alias("line"))
    return first.unionByName(lines)

