"""The library's input shapes as views over the given tables, in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillflow.session import configure, spread_small
from quillflow.sources.catalog import Agent


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table for work that is heavy per row: spread over all cores when it is small."""
    return spread_small(table(spark, folder, name))


def moment(ts: str | Column) -> Column:
    """Time as text with microseconds, the same in both engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


MOMENT_SQL = "'%Y-%m-%d %H:%M:%S.%f'"

OPERATION_OF = {"signup": "insert", "view": "update", "click": "update",
                "purchase": "replace", "error": "delete"}


def _case(column: str, mapping: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for key, value in mapping.items():
        result = F.when(F.col(column) == key, value).otherwise(result)
    return result


def _case_sql(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _note(k: Column) -> Column:
    return (F.when(k % 4 == 1, "x").when(k % 4 == 2, "y").when(k % 4 == 3, "Zed"))


def changes_of(events: DataFrame) -> DataFrame:
    """Change events of database ``app``; a delete has no document."""
    # The props are parsed once per row.
    events = events.withColumn("_k", _k())
    k = F.col("_k")
    document = F.struct(
        F.col("event_type").alias("kind"), "value", k.alias("k"), _note(k).alias("note"),
        F.struct(F.array(k, k + 1).alias("pair"), F.col("event_type").alias("kind")).alias("meta"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        _case("event_type", OPERATION_OF).alias("operation"),
        F.lit("app").alias("database"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"),
        F.col("user_id").cast("string").alias("document_id"),
        F.when(F.col("event_type") != "error", document).alias("full_document"))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes_of(table(spark, folder, "events"))


CHANGES = f"""changes AS (
  SELECT event_id, ts, {_case_sql('event_type', OPERATION_OF)} AS operation, 'app' AS database,
    'c' || (user_id % 3) AS collection, CAST(user_id AS VARCHAR) AS document_id,
    event_type <> 'error' AS has_doc,
    CASE WHEN event_type <> 'error' THEN event_type END AS kind,
    CASE WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN event_type <> 'error' THEN k END AS k,
    CASE WHEN event_type <> 'error' THEN
      CASE k % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'Zed' END END AS note
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

AGENTS = [
    Agent(id="spend_watch", database="app", collection="c0",
          prompt="Rate the {{ document.kind }} of {{ document.value }}",
          filter={"value": {"$gt": 50}}, temperature=0.0, model="gpt-4o-mini"),
    Agent(id="kind_watch", database="app", collection="c1",
          operations=("insert", "update", "replace", "delete"),
          prompt="Sort {{ document.kind }}: {{ document.note | default('none') }}",
          filter={"kind": {"$in": ["signup", "purchase"]},
                  "$or": [{"k": {"$gte": 50}}, {"value": {"$lt": 10}}]},
          temperature=0.0, model="claude-3-haiku", priority=5),
    Agent(id="text_watch", database="app", collection="c2",
          prompt="Read {{ document.meta.kind }}",
          system_prompt="You sort events.",
          filter={"meta.kind": {"$regex": "^(click|signup)$"}, "k": {"$nin": [1, 2, 3]},
                  "note": {"$exists": True}, "meta.pair.1": {"$type": "int"}},
          temperature=0.0, model="mistral-large", max_retries=1),
    Agent(id="all_watch", database="app", collection="c0",
          operations=("insert", "update", "replace", "delete"),
          prompt="See {{ document_id }}: {{ document.kind | default('gone') }}",
          model="o1-mini", deduplicate=False),
    Agent(id="off_watch", database="app", collection="c2", prompt="Never", enabled=False),
]

MODELS = ("gpt-4o-mini", "claude-3-haiku", "gemini-1.5-pro", "llama-3-70b", "mistral-large",
          "command-r", "openrouter/auto", "O1-mini", "grok-2")


def usage_of(events: DataFrame) -> DataFrame:
    """Usage records of model requests."""
    models = F.array(*[F.lit(m) for m in MODELS])
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("a"), (F.col("user_id") % 10).cast("string")).alias("agent_id"),
        F.get(models, (F.col("event_id") % len(MODELS)).cast("int")).alias("model"),
        (F.col("value") / 1000).cast("decimal(18,6)").alias("cost_usd"),
        F.floor(F.col("value") * 10).alias("total_tokens"),
        F.floor(F.col("value") * 7).alias("prompt_tokens"),
        F.floor(F.col("value") * 3).alias("completion_tokens"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), _k().cast("string")))
        .alias("error"),
        F.col("value").alias("latency_ms"),
        (_k() % 5 == 0).alias("is_retry"),
        F.col("ts").cast("timestamp").alias("ts"))


def usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage_of(table(spark, folder, "events"))


_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
USAGE = f"""usage AS (
  SELECT event_id AS id, 'a' || (user_id % 10) AS agent_id,
    ({_MODEL_LIST})[1 + event_id % {len(MODELS)}] AS model,
    CAST(value / 1000 AS DECIMAL(18,6)) AS cost_usd,
    CAST(floor(value * 10) AS BIGINT) AS total_tokens,
    CAST(floor(value * 7) AS BIGINT) AS prompt_tokens,
    CAST(floor(value * 3) AS BIGINT) AS completion_tokens, event_type <> 'error' AS ok,
    CASE WHEN event_type = 'error' THEN 'E' || json_extract_string(props, '$.k') END AS error,
    value AS latency_ms,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 = 0 AS is_retry, ts
  FROM events)"""

STATUS_OF = {"P": "processing", "O": "completed", "F": "failed"}


def executions(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 20).cast("string")).alias("agent_id"),
        F.col("o_custkey").cast("string").alias("document_id"),
        _case("o_orderstatus", STATUS_OF).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_totalprice").alias("duration_ms"),
        (F.col("o_orderkey") % 6).cast("int").alias("attempt"), F.lit(4).alias("max_attempts"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", F.get(
            F.array(F.lit("TimeoutError"), F.lit("AIRateLimitError"), F.lit("AIProviderError")),
            (F.col("o_orderkey") % 3).cast("int"))).alias("error_type"))


EXECUTIONS = f"""executions AS (
  SELECT o_orderkey AS id, 'a' || (o_custkey % 20) AS agent_id,
    CAST(o_custkey AS VARCHAR) AS document_id,
    {_case_sql('o_orderstatus', STATUS_OF)} AS status, o_orderdate AS started_at,
    o_totalprice AS duration_ms, CAST(o_orderkey % 6 AS INTEGER) AS attempt, 4 AS max_attempts,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
    CASE WHEN o_orderstatus = 'F' THEN
      (['TimeoutError', 'AIRateLimitError', 'AIProviderError'])[1 + o_orderkey % 3] END AS error_type
  FROM orders)"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers about documents, in six shapes."""
    labels = spread(spark, folder, "labels")
    plain = F.format_string('{"quality": %d, "mood": {"toxic": %d}, "tags": ["t%d", "t%d"]}',
                            "quality", "toxic", F.col("doc_id") % 7, F.col("doc_id") % 5)
    shapes = [
        plain,
        F.concat(F.lit("Sure:\n```json\n"), plain, F.lit("\n```\nDone.")),
        F.concat(F.lit("The answer is "), plain, F.lit(" as asked.")),
        F.format_string('Tags: ["t%d", "t%d"] only', F.col("doc_id") % 7, F.col("doc_id") % 5),
        F.format_string("{'quality': %d, mood: {'toxic': %d,}, tags: ['t%d'],}", "quality", "toxic",
                        F.col("doc_id") % 7),
        F.concat(F.lit("No idea about "), F.col("doc_id").cast("string")),
    ]
    content = shapes[-1]
    for number, shape in enumerate(shapes[:-1]):
        content = F.when(F.col("doc_id") % 6 == number, shape).otherwise(content)
    return labels.select("doc_id", content.alias("content"), "quality", "toxic")


ANSWERS = """answers AS (
  SELECT doc_id, quality, toxic, CASE doc_id % 6
    WHEN 0 THEN plain
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || plain || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN 'The answer is ' || plain || ' as asked.'
    WHEN 3 THEN printf('Tags: ["t%d", "t%d"] only', doc_id % 7, doc_id % 5)
    WHEN 4 THEN printf('{''quality'': %d, mood: {''toxic'': %d,}, tags: [''t%d''],}', quality, toxic, doc_id % 7)
    ELSE 'No idea about ' || doc_id END AS content
  FROM (SELECT *, printf('{"quality": %d, "mood": {"toxic": %d}, "tags": ["t%d", "t%d"]}',
          quality, toxic, doc_id % 7, doc_id % 5) AS plain FROM labels))"""

ANSWER_SCHEMA = {
    "type": "object",
    "required": ["quality", "mood", "reason"],
    "properties": {
        "quality": {"type": "integer", "enum": [1]},
        "mood": {"type": "object", "required": ["toxic"],
                 "properties": {"toxic": {"type": "boolean"}}},
        "tags": {"type": "array", "items": {"type": "string", "enum": ["t0", "t1", "t2", "t3"]}},
    },
}


def requests(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations")
    models = F.array(*[F.lit(m) for m in MODELS])
    return talks.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.get(models, (F.col("conv_id") % len(MODELS)).cast("int")).alias("model"),
        F.col("text").alias("prompt"),
        F.when(F.col("role") == "assistant", F.lit("Answer briefly.")).alias("system_prompt"),
        (F.col("turn") % 2).cast("double").alias("temperature"), "conv_id", "turn")


REQUESTS = f"""requests AS (
  SELECT conv_id * 1000 + turn AS id, ({_MODEL_LIST})[1 + conv_id % {len(MODELS)}] AS model,
    text AS prompt, CASE WHEN role = 'assistant' THEN 'Answer briefly.' END AS system_prompt,
    CAST(turn % 2 AS DOUBLE) AS temperature, conv_id, turn
  FROM conversations)"""


def target(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an array and a nested struct to update."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", "lang", "source", "n_chars",
        F.array(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")), F.col("lang")).alias("tags"),
        F.when(F.col("doc_id") % 3 > 0, F.struct(
            F.struct((F.col("n_chars") % 10).cast("int").alias("score")).alias("stats"),
            F.col("lang").alias("lang"))).alias("info"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(0)).alias("quality"))


TARGET = """target AS (
  SELECT doc_id, lang, source, n_chars, ['t' || (doc_id % 7), lang] AS tags,
    CASE WHEN doc_id % 3 > 0 THEN CAST(n_chars % 10 AS INTEGER) END AS info_score,
    CASE WHEN doc_id % 3 > 0 THEN lang END AS info_lang,
    CASE WHEN doc_id % 2 = 0 THEN 0 END AS quality
  FROM documents)"""
