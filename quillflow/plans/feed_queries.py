"""Queries over change feeds: parsing, matching, filters, keys, duplicates, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillflow.functions.filters import compile_filter
from quillflow.functions.keys import (
    ROUTE_STRATEGIES, dead_letter_route, dispatch_key, default_key, document_hash, hash_partition,
    hashed_key, provider_of_model, request_key, route_name)
from quillflow.operators.complete import template_key
from quillflow.operators.dedup import dedup_first, dedup_window, mark_first
from quillflow.operators.diff import distinct_namespaces, namespace_diff, snapshot_diff
from quillflow.operators.history import dispatch_stats, list_tagged
from quillflow.operators.match import match_agents, project_fields, resolve_agents
from quillflow.plans.registry import query
from quillflow.plans.views import (
    AGENTS, CHANGES, EXECUTIONS, MOMENT_SQL, REQUESTS, USAGE, changes, changes_of, executions,
    moment, requests, spread, table, usage)
from quillflow.session import shared_folder
from quillflow.sources.catalog import Agent
from quillflow.sources.feed import (
    envelope_schema, parse_changes, read_changes, restore_events, serialize_events,
    split_unreadable)
from quillflow.sources.tables import write_work_items
from quillflow.streaming.windows import run_to_table

FEED_DOCUMENT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def feed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The events as raw JSON envelopes; some are cut off, some lack the document key."""
    kinds = {"signup": "insert", "click": "update", "view": "invalidate",
             "purchase": "replace", "error": "delete"}
    operation = F.lit(None).cast("string")
    for name, op in kinds.items():
        operation = F.when(F.col("event_type") == name, op).otherwise(operation)
    envelope = F.struct(
        operation.alias("operationType"),
        F.struct(F.lit("app").alias("db"),
                 F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("coll")).alias("ns"),
        F.when(F.col("value") <= 150, F.struct(F.col("user_id").alias("_id"))).alias("documentKey"),
        F.when(F.col("event_type") != "error", F.struct(
            F.col("event_type").alias("kind"), F.col("value"))).alias("fullDocument"))
    text = F.to_json(envelope)
    return spread(spark, folder, "events").select(
        "event_id", F.when(F.col("value") < 1, F.substring(text, 1, 40)).otherwise(text)
        .alias("value"))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return split_unreadable(feed_lines(spark, folder), envelope_schema(FEED_DOCUMENT, T.LongType()))


@query("parse_changes", """
SELECT event_id,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'replace'
    WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
  'app.c' || (user_id % 3) AS namespace,
  CASE WHEN value > 150 OR user_id = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS document_id,
  CASE WHEN event_type <> 'error' THEN event_type END AS kind,
  CASE WHEN event_type <> 'error' THEN value END AS value
FROM events WHERE value >= 1""")
def parse_feed(spark: SparkSession, folder: str) -> DataFrame:
    good = _parsed(spark, folder).where(F.col("error").isNull()).select("event_id", "record.*")
    return parse_changes(good).select(
        "event_id", "operation", "namespace", "document_id", "full_document.kind",
        "full_document.value")


@query("unreadable_records", """
SELECT event_id, 'Failed to deserialize' AS error FROM events WHERE value < 1""")
def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).where(F.col("error").isNotNull()).select("event_id", "error")


@query("serialize_restore", f"""
WITH {CHANGES}
SELECT event_id, operation, database || '.' || collection AS namespace, document_id,
  strftime(ts, {MOMENT_SQL}) AS at, kind, value, k FROM changes""")
def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    events = changes(spark, folder)
    restored = restore_events(serialize_events(events), events.schema)
    return restored.select(
        "event_id", "operation", F.concat_ws(".", "database", "collection").alias("namespace"),
        "document_id", moment("ts").alias("at"), "full_document.kind", "full_document.value",
        "full_document.k")


@query("distinct_namespaces", f"WITH {CHANGES} SELECT DISTINCT database, collection FROM changes")
def namespaces(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_namespaces(changes(spark, folder))


@query("namespace_diff", f"""
WITH {CHANGES}, before AS (SELECT DISTINCT database, collection FROM changes WHERE collection <> 'c2'),
after AS (SELECT DISTINCT database, collection FROM changes WHERE collection <> 'c0')
SELECT *, 'added' AS change FROM (SELECT * FROM after EXCEPT SELECT * FROM before)
UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM before EXCEPT SELECT * FROM after)""")
def namespace_changes(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes(spark, folder)
    return namespace_diff(feed.where("collection <> 'c2'"), feed.where("collection <> 'c0'"))


@query("record_listing", """
SELECT doc_id, source, lang, n_chars FROM documents
WHERE n_chars > 500 AND lang IN ('de', 'fr') ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20""")
def listing(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "documents").select(
        "doc_id", "source", "lang", "n_chars", (F.col("n_chars") > 500).alias("enabled"),
        F.array("lang", "source").alias("tags"))
    return list_tagged(records, "n_chars", "doc_id", enabled_only=True, tags=["de", "fr"],
                       skip=20, limit=50, summary=["doc_id", "source", "lang", "n_chars"])


_OPS = "('insert', 'update', 'replace', 'delete')"


@query("match_agents", f"""
WITH {CHANGES}
SELECT event_id, 'spend_watch' AS agent_id FROM changes WHERE collection = 'c0'
  AND operation IN ('insert', 'update') AND (NOT has_doc OR value > 50)
UNION ALL SELECT event_id, 'kind_watch' FROM changes WHERE collection = 'c1' AND has_doc
  AND kind IN ('signup', 'purchase') AND (k >= 50 OR value < 10)
UNION ALL SELECT event_id, 'text_watch' FROM changes WHERE collection = 'c2' AND has_doc
  AND operation IN ('insert', 'update') AND regexp_matches(kind, '^(click|signup)$')
  AND k NOT IN (1, 2, 3) AND note IS NOT NULL
UNION ALL SELECT event_id, 'all_watch' FROM changes WHERE collection = 'c0' AND operation IN {_OPS}""")
def matched(spark: SparkSession, folder: str) -> DataFrame:
    return match_agents(changes(spark, folder), AGENTS).select("event_id", "agent_id")


@query("agent_outcomes", f"""
WITH {EXECUTIONS}
SELECT CASE WHEN CAST(substr(agent_id, 2) AS INT) >= 15 THEN 'agent_not_found'
  WHEN CAST(substr(agent_id, 2) AS INT) % 4 = 3 THEN 'agent_disabled' ELSE 'ready' END AS outcome,
  count(*) AS items FROM executions GROUP BY 1""")
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    catalog = [Agent(id=f"a{n}", database="app", collection="runs", prompt="Run",
                     enabled=n % 4 != 3) for n in range(15)]
    items = resolve_agents(executions(spark, folder), catalog)
    return items.groupBy("outcome").agg(F.count("*").alias("items"))


def _filter_query(name: str, condition: dict, sql: str) -> None:
    """Every event with the verdict of a filter; of an event without document all fields are null."""
    @query(name, f"WITH {CHANGES} SELECT event_id, coalesce(({sql}), false) AS passes FROM changes")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        feed = changes(spark, folder)
        dtype = feed.schema["full_document"].dataType
        return feed.select("event_id", compile_filter(condition, dtype, F.col("full_document")).alias("passes"))


_filter_query("filter_compare", {"value": {"$gt": 20, "$lte": 120.5}, "k": {"$gte": 10, "$lt": 90}},
              "value > 20 AND value <= 120.5 AND k >= 10 AND k < 90")
_filter_query("filter_equal", {"kind": "click", "k": {"$eq": 7}, "missing": None},
              "kind = 'click' AND k = 7")
_filter_query("filter_in_nin", {"note": {"$in": ["x", None]}, "kind": {"$nin": ["view", "click"]}},
              "(note = 'x' OR note IS NULL) AND coalesce(kind NOT IN ('view', 'click'), true)")
_filter_query("filter_exists", {"note": {"$exists": False}, "nothing.here": {"$exists": False}},
              "note IS NULL")
_filter_query("filter_regex", {"$or": [{"note": {"$regex": {"$regex": "^z", "$options": "i"}}},
                                       {"k": {"$regex": "^1.$"}}]},
              "regexp_matches(coalesce(note, ''), '^[zZ]') OR regexp_matches(CAST(k AS VARCHAR), '^1.$')")
_filter_query("filter_logic", {"$nor": [{"kind": "view"}, {"k": {"$lt": 20}}],
                               "$not": {"note": {"$gt": "x"}},
                               "$and": [{"value": {"$ne": 5}}, {"$or": [{"k": 30}, {"note": "x"}]}]},
              "kind <> 'view' AND k >= 20 AND NOT coalesce(note > 'x', false) AND value <> 5 "
              "AND (k = 30 OR coalesce(note = 'x', false))")
_filter_query("filter_dot_path", {"meta.pair.1": {"$gt": 60}, "meta.kind": "purchase",
                                  "meta.pair.5": None, "meta.pair.x": {"$exists": False},
                                  "meta.pair": {"$ne": [98, 99]}},
              "k + 1 > 60 AND kind = 'purchase' AND k <> 98")
_filter_query("filter_type", {"value": {"$type": "double"}, "k": {"$type": 16},
                              "meta": {"$type": "object"}, "meta.pair": {"$type": "array"},
                              "note": {"$type": "null"}}, "has_doc AND note IS NULL")


@query("filter_null_semantics", f"""
WITH {CHANGES}
SELECT event_id, note IS NULL AS eq_null, coalesce(note <> 'x', true) AS ne_x,
  coalesce(note > 'x', false) AS gt_x, NOT coalesce(note > 'x', false) AS not_gt_x,
  coalesce(note IN ('x', 'y'), false) AS in_list, NOT coalesce(note IN ('x', 'y'), false) AS nin_list,
  note IS NOT NULL AS present, false AS or_empty, true AS nor_empty, true AS and_empty,
  false AS number_as_text FROM changes""")
def null_semantics(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes(spark, folder)
    dtype = feed.schema["full_document"].dataType
    conditions = {
        "eq_null": {"note": None}, "ne_x": {"note": {"$ne": "x"}}, "gt_x": {"note": {"$gt": "x"}},
        "not_gt_x": {"$not": {"note": {"$gt": "x"}}}, "in_list": {"note": {"$in": ["x", "y"]}},
        "nin_list": {"note": {"$nin": ["x", "y"]}}, "present": {"note": {"$exists": True}},
        "or_empty": {"$or": []}, "nor_empty": {"$nor": []}, "and_empty": {"$and": []},
        "number_as_text": {"k": "5"}}
    return feed.select("event_id", *[
        compile_filter(c, dtype, F.col("full_document")).alias(n) for n, c in conditions.items()])


@query("filter_variant", f"""
WITH {CHANGES}
SELECT event_id, coalesce(value >= 25.5 AND kind IN ('click', 'view') AND k + 1 < 70
  AND coalesce(note <> 'y', true), false) AS passes FROM changes""")
def variant_filter(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes_of(spread(spark, folder, "events"))
    loose = feed.withColumn("full_document", F.parse_json(F.to_json("full_document")))
    condition = {"value": {"$gte": 25.5, "$type": "double"}, "kind": {"$in": ["click", "view"]},
                 "meta.pair.1": {"$lt": 70, "$type": "int"}, "note": {"$ne": "y"},
                 "meta.pair.9": {"$exists": False}}
    passes = compile_filter(condition, T.VariantType(), F.col("full_document"))
    return loose.select("event_id", passes.alias("passes"))


@query("project_fields", f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN has_doc THEN to_json({{'kind': kind, 'meta': {{'kind': kind}}}}) END AS document
FROM changes""")
def projection(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes(spark, folder)
    dtype = feed.schema["full_document"].dataType
    return feed.select("event_id", F.to_json(
        project_fields(F.col("full_document"), dtype, ["kind", "meta.kind"])).alias("document"))


@query("dedup_first", f"""
WITH {CHANGES}
SELECT event_id, document_id || ':' || operation AS key FROM changes
QUALIFY row_number() OVER (PARTITION BY document_id, operation ORDER BY ts, event_id) = 1""")
def first_of_key(spark: SparkSession, folder: str) -> DataFrame:
    items = changes(spark, folder).select(
        "event_id", "ts", F.concat_ws(":", "document_id", "operation").alias("key"))
    return dedup_first(items, "key", "ts", "event_id").select("event_id", "key")


@query("dedup_window", f"""
WITH RECURSIVE {CHANGES}, chain AS (
  SELECT document_id, min(ts) AS ts FROM changes GROUP BY document_id
  UNION ALL
  SELECT c.document_id, min(e.ts) FROM chain c JOIN changes e
    ON e.document_id = c.document_id AND e.ts >= c.ts + INTERVAL 6 HOUR GROUP BY c.document_id)
SELECT min(event_id) AS event_id FROM chain JOIN changes USING (document_id, ts)
GROUP BY document_id, ts""")
def within_window(spark: SparkSession, folder: str) -> DataFrame:
    items = changes(spark, folder).select("event_id", "ts", "document_id")
    return dedup_window(items, "document_id", "ts", "event_id", 6 * 3600).select("event_id")


@query("dispatch_stats", f"""
WITH {CHANGES}, keys AS (SELECT count(*) AS n, count(DISTINCT document_id || ':' || operation) AS d FROM changes)
SELECT d AS dispatched, n - d AS deduplicated FROM keys""")
def dispatched(spark: SparkSession, folder: str) -> DataFrame:
    items = changes(spark, folder).select(
        "event_id", "ts", F.concat_ws(":", "document_id", "operation").alias("key"))
    return dispatch_stats(mark_first(items, "key", "ts", "event_id", "first"), F.col("first"))


@query("doc_keys", """
SELECT doc_id, 'a1:' || doc_id || ':' || substr(md5(stable), 1, 12) AS default_key,
  'a1:' || doc_id || ':' || substr(md5(whole), 1, 8) AS dispatch_key,
  substr(sha256('a1:' || doc_id), 1, 32) AS hashed
FROM (SELECT doc_id,
  to_json({'lang': lang, 'meta': {'a': n_chars, 'b': source}, 'text': text}) AS stable,
  to_json({'_ai_note': lang, 'lang': lang, 'meta': {'a': n_chars, 'b': source}, 'text': text,
           'updated_at': n_chars}) AS whole FROM documents)""")
def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    document = F.struct(
        "text", F.col("n_chars").alias("updated_at"), "lang", F.col("lang").alias("_ai_note"),
        F.struct(F.col("source").alias("b"), F.col("n_chars").alias("a")).alias("meta"))
    docs = table(spark, folder, "documents").withColumn("document", document)
    dtype = docs.schema["document"].dataType
    who, doc_id = F.lit("a1"), F.col("doc_id").cast("string")
    return docs.select(
        "doc_id",
        default_key(who, doc_id, F.col("document"), dtype).alias("default_key"),
        dispatch_key(who, doc_id, F.col("document"), dtype).alias("dispatch_key"),
        hashed_key(F.concat_ws(":", who, doc_id)).alias("hashed"))


@query("duplicate_documents", """
SELECT substr(md5(to_json({'lang': lang, 'text': text})), 1, 12) AS doc_hash, count(*) AS copies
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def same_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.struct("text", "lang").alias("d"))
    hashed = docs.select(document_hash(F.col("d"), docs.schema["d"].dataType).alias("doc_hash"))
    return hashed.groupBy("doc_hash").agg(F.count("*").alias("copies")).where("copies > 1")


@query("cache_keys", f"""
WITH {REQUESTS}
SELECT id, CASE WHEN NOT temperature > 0 THEN sha256(to_json({{'max_tokens': 100, 'model': model,
  'prompt': prompt, 'system_prompt': system_prompt, 'temperature': temperature}})) END AS request_key
FROM requests""")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("id", request_key(
        F.col("model"), F.col("prompt"), F.col("system_prompt"), F.col("temperature"),
        max_tokens=F.lit(100), api_key=F.lit("hidden")).alias("request_key"))


@query("route_names", f"""
WITH {EXECUTIONS}
SELECT id, 'work:agent:' || agent_id AS by_agent, 'work:collection:app:runs' AS by_collection,
  'work:work' AS single,
  'work:partition:' || (('0x' || right(md5(document_id), 7))::BIGINT % 8) AS partitioned,
  'work:priority:' || priority AS by_priority,
  CASE WHEN status = 'failed' THEN 'work:dlq:agent:' || agent_id ELSE 'work:dlq' END AS dlq
FROM executions""")
def routes(spark: SparkSession, folder: str) -> DataFrame:
    items = executions(spark, folder).withColumn("database", F.lit("app")).withColumn(
        "collection", F.lit("runs"))
    owner = F.when(F.col("status") == "failed", F.col("agent_id"))
    return items.select("id", *[route_name(s).alias(s) for s in ROUTE_STRATEGIES],
                        dead_letter_route(owner).alias("dlq"))


@query("partition_of_id", """
SELECT doc_id, CAST(('0x' || right(md5(CAST(doc_id AS VARCHAR)), 7))::BIGINT % 8 AS INT) AS p8,
  CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 33),
    lambda i: ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), i, 1))::BIGINT)),
    lambda a, d: (a * 16 + d) % 10) AS INT) AS p10, 0 AS empty
FROM documents""")
def partitions(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, folder, "documents").select(
        "doc_id", hash_partition(key, 8).alias("p8"), hash_partition(key, 10).alias("p10"),
        hash_partition(F.lit(""), 8).alias("empty"))


@query("provider_of_model", f"""
WITH {USAGE}
SELECT id, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1)
  WHEN regexp_matches(lower(model), '^(gpt-|o1|o3)') THEN 'openai'
  WHEN starts_with(lower(model), 'claude') THEN 'anthropic'
  WHEN starts_with(lower(model), 'gemini') THEN 'google'
  WHEN regexp_matches(lower(model), '^(llama|mixtral)') THEN 'groq'
  WHEN starts_with(lower(model), 'mistral') THEN 'mistral'
  WHEN starts_with(lower(model), 'command') THEN 'cohere' ELSE 'unknown' END AS provider
FROM usage""")
def providers(spark: SparkSession, folder: str) -> DataFrame:
    return usage(spark, folder).select("id", provider_of_model(F.col("model")).alias("provider"))


@query("snapshot_diff", """
WITH old AS (SELECT doc_id, lang, n_chars FROM documents WHERE source <> 'src3'),
new AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'xx' ELSE lang END AS lang, n_chars
        FROM documents WHERE source <> 'src5')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created'
  WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'updated' END AS change
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id
WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.lang <> n.lang OR o.n_chars <> n.n_chars""")
def content_diff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    old = docs.where("source <> 'src3'").drop("source")
    new = docs.where("source <> 'src5'").drop("source").withColumn(
        "lang", F.when(F.col("lang") == "fr", "xx").otherwise(F.col("lang")))
    return snapshot_diff(old, new, "doc_id")


@query("snapshot_diff_by_time", f"""
WITH {EXECUTIONS}
SELECT id, CASE WHEN priority = 1 THEN 'created' WHEN priority = 5 THEN 'deleted' ELSE 'updated' END AS change
FROM executions WHERE priority IN (1, 5) OR attempt = 2""")
def timed_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = executions(spark, folder).select("id", "status", "attempt", "started_at", "priority")
    later = F.col("started_at") + F.make_dt_interval(days=F.lit(1))
    new = rows.where("priority <> 5").withColumn(
        "started_at", F.when(F.col("attempt") == 2, later).otherwise(F.col("started_at")))
    return snapshot_diff(rows.where("priority <> 1"), new.withColumn("status", F.lit("any")), "id",
                         "started_at")


KEY_AGENTS = [
    Agent(id="by_kind", database="app", collection="c0", operations=("insert", "update", "delete"),
          prompt="x", idempotency_key="{{ agent_id }}/{{ document.kind }}/{{ document_id }}"),
    Agent(id="by_note", database="app", collection="c1", operations=("insert", "update", "delete"),
          prompt="x", idempotency_key="{{ document.note | default('none') }}@{{ event.operation }}"),
    Agent(id="plain", database="app", collection="c2", operations=("insert", "update", "delete"),
          prompt="x"),
]


@query("template_keys", f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN collection = 'c0' AND has_doc THEN 'by_kind/' || kind || '/' || document_id
  WHEN collection = 'c1' THEN coalesce(note, 'none') || '@' || operation
  ELSE CASE collection WHEN 'c0' THEN 'by_kind' ELSE 'plain' END || ':' || document_id || ':' ||
    substr(md5(CASE WHEN has_doc THEN to_json({{'k': k, 'kind': kind,
      'meta': {{'kind': kind, 'pair': [k, k + 1]}}, 'note': note, 'value': value}})::VARCHAR
    ELSE '{{}}' END), 1, 12) END AS key
FROM changes WHERE operation <> 'replace'""")
def template_keys(spark: SparkSession, folder: str) -> DataFrame:
    items = match_agents(changes(spark, folder), KEY_AGENTS)
    dtype = items.schema["full_document"].dataType
    fallback = default_key(F.col("agent_id"), F.col("document_id"), F.col("full_document"), dtype)
    return items.select("event_id", template_key(items, KEY_AGENTS, fallback).alias("key"))


@query("work_item_sink", f"""
WITH {EXECUTIONS} SELECT 'work:priority:' || priority AS route, count(*) AS items FROM executions GROUP BY 1""")
def work_item_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Work items written in folders by route and read back."""
    where = shared_folder(spark, "work")
    items = executions(spark, folder).select(
        "id", "agent_id", "attempt", route_name("by_priority").alias("route"))
    write_work_items(items, where, batch_id=0)
    return spark.read.parquet(where).groupBy("route").agg(F.count("*").alias("items"))


@query("read_changes", f"""
WITH {CHANGES} SELECT operation, database || '.' || collection AS namespace, count(*) AS events
FROM changes GROUP BY ALL""")
def json_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A feed of JSON files with one folder per namespace, read as a stream."""
    where = shared_folder(spark, "feed")
    events = changes(spark, folder)
    raw = events.select(
        F.col("event_id").cast("string").alias("_id"), F.col("operation").alias("operationType"),
        F.struct(F.col("database").alias("db"), F.col("collection").alias("coll")).alias("ns"),
        F.struct(F.col("document_id").alias("_id")).alias("documentKey"),
        F.struct("full_document.kind", "full_document.value").alias("fullDocument"),
        F.concat_ws(".", "database", "collection").alias("namespace"))
    raw.write.partitionBy("namespace").json(where)
    stream = read_changes(spark, f"{where}/namespace=*", envelope_schema(FEED_DOCUMENT), streaming=True)
    parsed = parse_changes(stream).select("operation", "namespace")
    return run_to_table(parsed).groupBy("operation", "namespace").agg(F.count("*").alias("events"))
