"""Whole flows: batch enrichment, applying to a table, and the streaming operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.plans import limit_queries  # noqa: F401 - its SQL serves the streams too
from quillflow.plans.answer_queries import demo_client
from quillflow.plans.enrich import admit, apply_agents, dispatch, enrich, work_items
from quillflow.plans.registry import ORACLES, query
from quillflow.plans.views import (
    AGENTS, CHANGES, MOMENT_SQL, USAGE, changes_of, moment, spread, table, usage_of)
from quillflow.session import configure, shared_folder
from quillflow.sources.feed import read_changes
from quillflow.sources.tables import execution_rows, is_folder, stage_in
from quillflow.streaming.enrich import EnrichSink, start_enrich
from quillflow.streaming.targets import Target, TargetStore
from quillflow.streaming.windows import (
    STATE_CONF, BucketAdmission, BudgetGate, SlidingAdmission, WindowDedup, dedup_within, label_stream,
    run_to_table, usage_windows)

SCHEMA = {"type": "object", "required": ["length", "model"], "properties": {
    "length": {"type": "integer"}, "model": {"type": "string"}}}

FLOW_AGENTS = [replace(a, response_schema=SCHEMA, target_database="app", target_collection="users",
                       target_field=a.id)
               for a in AGENTS]

# Work items of the demo catalog, with duplicates of the same document content removed.
_MATCHED = CHANGES + """, matched AS (
  SELECT *, 'spend_watch' AS agent_id, 'Rate the ' || kind || ' of ' || CAST(value AS VARCHAR) AS prompt
  FROM changes WHERE collection = 'c0' AND operation IN ('insert', 'update') AND value > 50
  UNION ALL
  SELECT *, 'kind_watch', 'Sort ' || kind || ': ' || coalesce(note, 'none')
  FROM changes WHERE collection = 'c1' AND has_doc AND kind IN ('signup', 'purchase') AND (k >= 50 OR value < 10)
  UNION ALL
  SELECT *, 'text_watch', 'Read ' || kind FROM changes WHERE collection = 'c2' AND has_doc
    AND operation IN ('insert', 'update') AND regexp_matches(kind, '^(click|signup)$')
    AND k NOT IN (1, 2, 3) AND note IS NOT NULL
  UNION ALL
  SELECT *, 'all_watch', 'See ' || document_id || ': ' || coalesce(kind, 'gone')
  FROM changes WHERE collection = 'c0')"""
_ITEMS = _MATCHED + """,
items AS (SELECT * FROM matched QUALIFY agent_id = 'all_watch' OR row_number() OVER (
  PARTITION BY agent_id, document_id, kind, value, k ORDER BY ts, md5(agent_id || ':' || event_id)) = 1),
done AS (SELECT *, length(prompt) % 50 <> 49 AS ok FROM items)"""


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes_of(spread(spark, folder, "events"))
    items = dispatch(work_items(feed, FLOW_AGENTS))
    return enrich(items, FLOW_AGENTS, demo_client, stage=stage_in(shared_folder(spark, "enrich")))


@query("enrich_batch", f"""
WITH {_ITEMS}
SELECT event_id, agent_id, prompt, ok, CASE WHEN ok THEN length(prompt) END AS length
FROM done""")
def enrich_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _enriched(spark, folder).select(
        "event_id", "agent_id", "prompt", F.col("error_type").isNull().alias("ok"),
        F.when(F.col("error_type").isNull(), F.try_variant_get("answer", "$.length", "long"))
        .alias("length"))


# Settings that act: two fields of a document, a window of duplicates, limits by minute and hour.
_SETTINGS = {
    "spend_watch": {"prompt": "Rate the {{ document.kind }} of {{ document.value | default('?') }}",
                    "projection": ("kind", "k"), "token_limit": 2000, "deduplicate": False},
    "kind_watch": {"idempotency_key": "{{ document_id }}:{{ operation }}", "deduplicate_window_seconds": 6 * 3600},
    "text_watch": {"rate_limit_requests": 1, "deduplicate": False},
    "all_watch": {"cost_limit_usd": 0.2, "deduplicate": False},
}
LIMITED_AGENTS = [replace(a, **_SETTINGS[a.id]) for a in FLOW_AGENTS if a.id in _SETTINGS]


def _spent_sql(column: str) -> str:
    return (f"coalesce((SELECT sum(u.{column}) FROM usage u WHERE date_trunc('hour', u.ts) = date_trunc('hour', m.ts) "
            "AND u.ts < m.ts), 0)")


def _chain_sql(name: str, agent: str, keys: str, window: str) -> str:
    """Times that are accepted, each at least a window after the one before it."""
    return f"""{name} AS (
  SELECT {keys}, min(ts) AS ts FROM matched WHERE agent_id = '{agent}' GROUP BY {keys}
  UNION ALL
  SELECT {keys}, min(e.ts) FROM {name} c JOIN matched e USING ({keys})
  WHERE e.agent_id = '{agent}' AND e.ts >= c.ts + INTERVAL {window} GROUP BY {keys})"""


@query("enrich_settings", f"""
WITH RECURSIVE {USAGE}, {_MATCHED},
{_chain_sql('kinds', 'kind_watch', 'document_id, operation', '6 HOUR')},
{_chain_sql('texts', 'text_watch', 'agent_id', '60 SECOND')},
placed AS (SELECT *, row_number() OVER (PARTITION BY agent_id, ts, document_id, operation ORDER BY md5(agent_id || ':' || event_id)) AS same,
  row_number() OVER (PARTITION BY agent_id, ts ORDER BY md5(agent_id || ':' || event_id)) AS place FROM matched),
judged AS (
  SELECT event_id, agent_id, 'Rate the ' || kind || ' of ?' AS prompt,
    CASE WHEN {_spent_sql('total_tokens')} >= 2000 THEN 'token_limit' END AS refused
  FROM matched m WHERE agent_id = 'spend_watch'
  UNION ALL
  SELECT event_id, agent_id, prompt, CASE WHEN {_spent_sql('cost_usd')} >= 0.2 THEN 'cost_limit_usd' END
  FROM matched m WHERE agent_id = 'all_watch'
  UNION ALL
  SELECT event_id, agent_id, prompt, NULL FROM placed JOIN kinds USING (document_id, operation, ts)
  WHERE agent_id = 'kind_watch' AND same = 1
  UNION ALL
  SELECT event_id, p.agent_id, prompt, CASE WHEN t.ts IS NULL OR place > 1 THEN 'rate_limit_requests' END
  FROM placed p LEFT JOIN texts t ON t.ts = p.ts WHERE p.agent_id = 'text_watch')
SELECT event_id, agent_id, prompt, CASE WHEN refused IS NOT NULL THEN 'reached ' || refused
  WHEN length(prompt) % 50 = 49 THEN 'slow down' ELSE 'ok' END AS outcome FROM judged""")
def enrich_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Items under the settings of their agents; every usage row counts as spent by two of them."""
    events = spread(spark, folder, "events")
    stage = stage_in(shared_folder(spark, "settings"))
    items = stage(dispatch(work_items(changes_of(events), LIMITED_AGENTS), agents=LIMITED_AGENTS), "items")
    spent = usage_of(events).withColumn("agent_id", F.explode(F.array(F.lit("all_watch"), F.lit("spend_watch"))))
    results = enrich(admit(items, LIMITED_AGENTS, spent), LIMITED_AGENTS, demo_client, stage=stage)
    return results.select("event_id", "agent_id", "prompt", F.coalesce("error", F.lit("ok")).alias("outcome"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Match, render, call, parse, check and count executions by agent and status."""
    results = _enriched(spark, folder)
    history = execution_rows(results.withColumn("written", F.lit(True)))
    return history.groupBy("agent_id", "status").agg(
        F.count("*").alias("executions"),
        F.sum("total_tokens").alias("tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")), 6).cast("double").alias("cost_usd"))


query("enrich_history", f"""
WITH {_ITEMS}
SELECT agent_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, count(*) AS executions,
  CAST(sum(CASE WHEN ok THEN len(string_split(prompt, ' ')) + 4 ELSE 0 END) AS BIGINT) AS tokens,
  CAST(round(sum(CASE WHEN ok THEN 0.001 ELSE 0 END), 6) AS DOUBLE) AS cost_usd
FROM done GROUP BY ALL""")(flagship)


def users(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("user")).agg(
        F.count("*").alias("events"))


_USERS = _ITEMS + """, users AS (SELECT CAST(user_id AS VARCHAR) AS user, count(*) AS events
  FROM events GROUP BY 1),
last AS (SELECT document_id, agent_id, arg_max(length(prompt), (ts, md5(agent_id || ':' || event_id))) AS length
  FROM done WHERE ok GROUP BY ALL)
SELECT u.user, events, s.length AS spend, k.length AS kind, t.length AS text, a.length AS everything
FROM users u LEFT JOIN last s ON s.document_id = user AND s.agent_id = 'spend_watch'
LEFT JOIN last k ON k.document_id = user AND k.agent_id = 'kind_watch'
LEFT JOIN last t ON t.document_id = user AND t.agent_id = 'text_watch'
LEFT JOIN last a ON a.document_id = user AND a.agent_id = 'all_watch'"""


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.select(
        "user", "events", F.col("spend_watch.length").alias("spend"),
        F.col("kind_watch.length").alias("kind"), F.col("text_watch.length").alias("text"),
        F.col("all_watch.length").alias("everything"))


@query("enrich_apply", f"WITH {_USERS}")
def enrich_apply(spark: SparkSession, folder: str) -> DataFrame:
    results = _enriched(spark, folder)
    return _lengths(apply_agents(users(spark, folder), results, FLOW_AGENTS, "user", "app", "users"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    configure(spark)
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # One file is found by its name in the folder; a folder of files is the source itself.
    if is_folder(spark, path):
        return read_changes(spark, path, schema, "parquet", streaming=True)
    return read_changes(spark, folder, schema, "parquet", streaming=True,
                        pathGlobFilter="events.parquet")


def with_state_conf(spark: SparkSession) -> None:
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)


@query("stream_usage_windows", f"""
WITH {USAGE}
SELECT strftime(date_trunc('day', ts), {MOMENT_SQL}) AS window_start, agent_id,
  CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS requests
FROM usage GROUP BY date_trunc('day', ts), agent_id
HAVING date_trunc('day', usage.ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM usage) - INTERVAL 1 HOUR""")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = usage_windows(usage_of(event_stream(spark, folder)), "1 day", "1 hour", ("agent_id",))
    return run_to_table(rows).withColumn("window_start", moment("window_start")).withColumn(
        "cost_usd", F.col("cost_usd").cast("double"))


@query("stream_dedup", f"""
WITH {CHANGES} SELECT DISTINCT document_id || ':' || operation AS key FROM changes""")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    items = changes_of(event_stream(spark, folder)).select(
        "ts", F.concat_ws(":", "document_id", "operation").alias("key"))
    return run_to_table(dedup_within(items, "key", "ts", "60 days")).select("key")


# Files that the events are dealt into for the stateful streams, out of order, and files of a micro-batch.
STREAM_FILES, BATCH_FILES = 8, 2
CLOSING = "closing"


def shuffled_stream(rows: DataFrame, ts: str, purpose: str) -> DataFrame:
    """All rows as a stream of several files that each hold rows of all times.

    A last file of one row with a time after all others moves the watermark past them, as the
    next events of an endless stream would; its key is ``CLOSING``.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark, purpose)}/feed"
    dealt = rows.withColumn("file", F.pmod(F.xxhash64("id"), F.lit(STREAM_FILES)).cast("int"))
    last = dealt.agg((F.max(ts) + F.expr("INTERVAL 1001 DAYS")).alias("last")).first()["last"]
    closing = spark.range(1).select(*(
        F.lit(last).alias(f.name) if f.name == ts else F.lit(CLOSING).alias(f.name) if f.name == "key"
        else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    # One write per file time: a stream reads files by the time they were written.
    dealt.repartition(STREAM_FILES, "file").drop("file").write.parquet(folder)
    closing.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(folder)


def _labelled(spark: SparkSession, folder: str, key: str, processor, need: str | None = None) -> DataFrame:
    with_state_conf(spark)
    configure(spark)
    events = table(spark, folder, "events")
    rows = usage_of(events) if key == "agent_id" else changes_of(events).withColumn("id", F.col("event_id"))
    if need == "cost_units":
        rows = rows.withColumn(need, F.floor(F.col("cost_usd") * 1000))
    amount = F.lit(1.0) if need is None else F.col(need).cast("double")
    slim = rows.select(F.col(key).alias("key"), F.col("id").cast("long").alias("id"), "ts", amount.alias("need"))
    stream = shuffled_stream(slim, "ts", "labelled")
    labels = run_to_table(label_stream(stream, "key", "ts", "id", processor, "need", "1000 days"))
    return labels.where(F.col("key") != CLOSING).select("id", "admitted")


@query("stream_dedup_window", f"""
WITH RECURSIVE {CHANGES}, chain AS (
  SELECT document_id, min(ts) AS ts FROM changes GROUP BY document_id
  UNION ALL
  SELECT c.document_id, min(e.ts) FROM chain c JOIN changes e
    ON e.document_id = c.document_id AND e.ts >= c.ts + INTERVAL 6 HOUR GROUP BY c.document_id)
SELECT event_id AS id FROM chain JOIN changes USING (document_id, ts)""")
def stream_window(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "document_id", WindowDedup(6 * 3600)).where("admitted").select("id")


@query("stream_sliding_admission", ORACLES["sliding_admission"])
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "agent_id", SlidingAdmission(4, 6 * 3600))


@query("stream_bucket_admission", ORACLES["bucket_admission"])
def stream_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "agent_id", BucketAdmission(0.0005, 3.0))


@query("stream_budget_gate", f"""
WITH {USAGE}
SELECT id, coalesce(sum(floor(cost_usd * 1000)) OVER (PARTITION BY agent_id, date_trunc('day', ts)
  ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 750 AS admitted FROM usage""")
def stream_budget(spark: SparkSession, folder: str) -> DataFrame:
    """A daily budget in thousandths, whole numbers, so that sums are exact in any order."""
    return _labelled(spark, folder, "agent_id", BudgetGate(750.0, 24 * 3600), "cost_units")


# The agents of the stream: one writes to a second collection, one has no schema for its answers.
STREAM_AGENTS = [
    replace(a, target_collection="people") if a.id == "all_watch"
    else replace(a, response_schema=None) if a.id == "text_watch" else a for a in FLOW_AGENTS]
USERS_TARGET, PEOPLE_TARGET = Target("app", "users", "user"), Target("app", "people", "person")


def stream_store(spark: SparkSession, folder: str, root: str, buckets: int = 8) -> TargetStore:
    """Both targets of the stream, without answers yet."""
    store = TargetStore(root, (USERS_TARGET, PEOPLE_TARGET), buckets)
    rows = users(spark, folder)
    store.create(USERS_TARGET, rows)
    store.create(PEOPLE_TARGET, rows.select(F.col("user").alias("person")))
    return store


def stream_lengths(spark: SparkSession, store: TargetStore, agents: list) -> DataFrame:
    """What both targets hold, side by side."""
    people = store.read(spark, PEOPLE_TARGET, agents).select(
        F.col("person").alias("user"), F.col("all_watch.length").alias("everything"))
    rows = store.read(spark, USERS_TARGET, agents).join(people, "user", "left")
    return rows.select(
        "user", "events", F.col("spend_watch.length").alias("spend"),
        F.col("kind_watch.length").alias("kind"),
        F.try_variant_get(F.col("text_watch._fields"), "$.length", "long").alias("text"), "everything")


@query("stream_enrich", f"WITH {_USERS}")
def stream_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming flow into two tables, which equal the batch result."""
    configure(spark)
    root = shared_folder(spark, "enrich")
    store = stream_store(spark, folder, root)
    sink = EnrichSink(STREAM_AGENTS, demo_client, root, store)
    start_enrich(changes_of(event_stream(spark, folder)), sink, f"{root}/checkpoint",
                 available_now=True).awaitTermination()
    return stream_lengths(spark, store, STREAM_AGENTS)
