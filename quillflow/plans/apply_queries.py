"""Queries that apply answers to the target documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillflow.functions.answers import parse_answers
from quillflow.operators.apply import (
    Write, append_capped, append_unique, apply_results, effective_answer, fresh_only, increment,
    set_at_path, update_first_match, write_report)
from quillflow.plans.answer_queries import _PARSED
from quillflow.plans.registry import query
from quillflow.plans.views import CHANGES, TARGET, answers, changes, target
from quillflow.sources.tables import key_rows

WRITE = Write(types={"quality": "int", "mood": "variant", "tags": "array<string>",
                     "content": "string"})


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed answers as result rows; some are for documents that do not exist."""
    out = parse_answers(answers(spark, folder), "content")
    return out.select(
        F.when(F.col("toxic") == 1, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"),
        effective_answer(F.col("parsed"), F.col("content")).alias("answer"),
        F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_item_id"),
        F.lit("2024-01-01").cast("timestamp").alias("completed_at"),
        F.lit("gpt-4o-mini").alias("model"), F.lit("openai").alias("provider"),
        F.lit(10).cast("long").alias("total_tokens"), F.lit(0.01).alias("cost_usd"),
        F.lit(5.0).alias("latency_ms"))


_RESULTS = TARGET + ", " + _PARSED + r""", results AS (
  SELECT doc_id, parse_strategy, CASE WHEN parse_strategy = 'raw' THEN content END AS content,
    CASE WHEN parse_strategy IN ('whole', 'fenced', 'object', 'repaired')
      THEN CAST(json_extract_string(j, '$.quality') AS INTEGER) END AS new_quality,
    CASE WHEN parse_strategy IN ('whole', 'fenced', 'object', 'repaired')
      THEN CAST(json_extract(j, '$.tags') AS VARCHAR[]) END AS new_tags,
    parse_strategy <> 'array' AS plain
  FROM found WHERE toxic <> 1)"""

_JOINED = _RESULTS + """, joined AS (SELECT t.*, r.doc_id IS NOT NULL AND plain AS hit, r.content,
  r.new_quality, r.new_tags FROM target t LEFT JOIN results r USING (doc_id))"""


@query("apply_merge", f"""
WITH {_JOINED}
SELECT doc_id, lang, coalesce(new_quality, quality) AS quality,
  array_to_string(coalesce(new_tags, tags), ',') AS tags, content,
  CASE WHEN hit THEN 'w' || doc_id END AS work_item, CASE WHEN hit THEN 10 END AS tokens
FROM joined""")
def merged(spark: SparkSession, folder: str) -> DataFrame:
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", WRITE)
    return out.select(
        "doc_id", "lang", "quality", F.array_join("tags", ",").alias("tags"), "content",
        F.col("_ai_metadata.work_item_id").alias("work_item"),
        F.col("_ai_metadata.tokens").alias("tokens"))


@query("apply_mapped_fields", f"""
WITH {_JOINED}
SELECT doc_id, quality, new_quality AS rating FROM joined""")
def mapped(spark: SparkSession, folder: str) -> DataFrame:
    write = replace(WRITE, fields={"quality": "rating"}, include_metadata=False)
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", write)
    return out.select("doc_id", "quality", "rating")


@query("apply_nested", f"""
WITH {_JOINED}
SELECT doc_id, info_score AS score, info_lang AS lang, CASE WHEN hit THEN new_quality END AS quality,
  CASE WHEN hit THEN content END AS content FROM joined""")
def nested(spark: SparkSession, folder: str) -> DataFrame:
    write = replace(WRITE, strategy="nested", path="info.review")
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", write)
    return out.select("doc_id", "info.stats.score", "info.lang",
                      "info.review.quality", "info.review.content")


@query("apply_target_field", f"""
WITH {_JOINED}
SELECT doc_id, CASE WHEN hit THEN new_quality END AS quality, info_score AS score FROM joined""")
def under_field(spark: SparkSession, folder: str) -> DataFrame:
    write = replace(WRITE, target_field="review")
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", write)
    return out.select("doc_id", "review.quality", "info.stats.score")


@query("apply_conditional", f"""
WITH {_JOINED}
SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(new_quality, quality) ELSE quality END AS quality
FROM joined""")
def conditional(spark: SparkSession, folder: str) -> DataFrame:
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", WRITE,
                        condition=F.col("lang") == "en")
    return out.select("doc_id", "quality")


@query("apply_append", f"""
WITH {_RESULTS}, log AS (SELECT doc_id, 'q' || coalesce(CAST(new_quality AS VARCHAR), '-') AS item,
    CASE WHEN plain THEN 1 ELSE 2 END AS n FROM results)
SELECT t.doc_id, coalesce(n, 0) AS entries,
  CASE WHEN n = 1 THEN item WHEN n = 2 THEN 'q-,q-' ELSE '' END AS listed
FROM target t LEFT JOIN log USING (doc_id)""")
def appended(spark: SparkSession, folder: str) -> DataFrame:
    write = Write(types={"quality": "int"}, strategy="append", array_field="log",
                  include_metadata=False)
    rows = target(spark, folder).withColumn("log", F.lit(None).cast("array<struct<quality:int>>"))
    out = apply_results(rows, results(spark, folder), "doc_id", write)
    listed = F.transform("log", lambda x: F.concat(
        F.lit("q"), F.coalesce(x["quality"].cast("string"), F.lit("-"))))
    return out.select("doc_id", F.coalesce(F.size("log"), F.lit(0)).alias("entries"),
                      F.coalesce(F.array_join(listed, ","), F.lit("")).alias("listed"))


@query("apply_without_schema", f"""
WITH {_RESULTS}, joined AS (SELECT t.*, r.content, r.new_quality, r.new_tags,
  CASE WHEN r.parse_strategy NOT IN ('raw', 'array') THEN 0 END AS toxic FROM target t LEFT JOIN results r USING (doc_id))
SELECT doc_id, coalesce(new_quality, quality) AS quality, array_to_string(coalesce(new_tags, tags), ',') AS tags,
  toxic, content FROM joined""")
def without_schema(spark: SparkSession, folder: str) -> DataFrame:
    write = Write(types={}, rest="_fields", include_metadata=False)
    out = apply_results(target(spark, folder), results(spark, folder), "doc_id", write)
    return out.select(
        "doc_id", "quality", F.array_join("tags", ",").alias("tags"),
        F.try_variant_get("_fields", "$.mood.toxic", "int").alias("toxic"),
        F.try_variant_get("_fields", "$.content", "string").alias("content"))


@query("apply_wrong_type", f"""
WITH {TARGET}
SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 8 WHEN 2 THEN NULL ELSE quality END AS quality,
  CASE WHEN doc_id % 2 = 1 THEN lang || '!' ELSE lang END AS lang FROM target""")
def wrong_type(spark: SparkSession, folder: str) -> DataFrame:
    rows = target(spark, folder)
    quality = F.when(F.col("doc_id") % 4 == 0, '"high"').when(F.col("doc_id") % 4 == 1, "99999999999").when(
        F.col("doc_id") % 4 == 2, "null").otherwise("8")
    lang = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit('["'), "lang", F.lit('!"]'))).otherwise('"no list"')
    answers_ = rows.select("doc_id", F.parse_json(F.concat(
        F.lit('{"quality": '), quality, F.lit(', "lang": '), lang, F.lit("}"))).alias("answer"),
        F.lit("2024-01-01").cast("timestamp").alias("completed_at"), F.lit("w").alias("work_item_id"))
    write = Write(types={"quality": "int", "lang": "array<string>"}, include_metadata=False)
    out = apply_results(rows.withColumn("lang", F.array("lang")), answers_, "doc_id", write)
    return out.select("doc_id", "quality", F.element_at("lang", 1).alias("lang"))


@query("apply_append_nested", f"""
WITH {_RESULTS}, log AS (SELECT doc_id, coalesce(new_quality, -1) AS q, CASE WHEN plain THEN 1 ELSE 2 END AS n FROM results)
SELECT t.doc_id, 1 + coalesce(n, 0) AS entries, 't' || t.lang AS first_entry,
  CASE WHEN n IS NOT NULL THEN q END AS last_quality
FROM target t LEFT JOIN log USING (doc_id)""")
def appended_nested(spark: SparkSession, folder: str) -> DataFrame:
    write = Write(types={}, strategy="append", array_field="ai.log", include_metadata=False)
    old = F.to_variant_object(F.struct(F.concat(F.lit("t"), "lang").alias("was")))
    rows = target(spark, folder).withColumn("ai", F.struct(F.array(old).alias("log"), F.lit(1).alias("k")))
    out = apply_results(rows, results(spark, folder), "doc_id", write)
    last = F.element_at("ai.log", -1)
    return out.select(
        "doc_id", F.size("ai.log").alias("entries"),
        F.try_variant_get(F.element_at("ai.log", 1), "$.was", "string").alias("first_entry"),
        F.when(F.size("ai.log") > 1, F.coalesce(F.try_variant_get(last, "$.quality", "int"), F.lit(-1)))
        .alias("last_quality"))


@query("apply_last_write", f"""
WITH {CHANGES}, last AS (SELECT document_id, arg_max(kind, (ts, event_id)) FILTER (kind IS NOT NULL) AS kind,
  arg_max(note, (ts, event_id)) FILTER (note IS NOT NULL) AS note FROM changes GROUP BY 1)
SELECT d.doc_id, coalesce(l.kind, d.source) AS kind, l.note FROM documents d
LEFT JOIN last l ON l.document_id = CAST(d.doc_id AS VARCHAR)""")
def last_write(spark: SparkSession, folder: str) -> DataFrame:
    # An event without document answers with nothing, so it writes nothing.
    feed = changes(spark, folder)
    rows = feed.select(
        F.col("document_id").cast("long").alias("doc_id"),
        F.parse_json(F.to_json(F.struct("full_document.kind", "full_document.note"))).alias("answer"),
        F.col("ts").alias("completed_at"), F.col("event_id").alias("work_item_id"))
    write = Write(types={"kind": "string", "note": "string"}, include_metadata=False)
    base = target(spark, folder).select("doc_id", F.col("source").alias("kind"))
    return apply_results(base, rows, "doc_id", write)


@query("write_report", f"""
WITH {_PARSED}
SELECT 'w' || doc_id AS work_item_id, toxic <> 1 AND parse_strategy <> 'array' AS written,
  CASE WHEN parse_strategy = 'array' THEN 'list_requires_append'
    WHEN toxic = 1 THEN 'document_not_found' END AS write_error
FROM found""")
def report(spark: SparkSession, folder: str) -> DataFrame:
    out = write_report(results(spark, folder), target(spark, folder), "doc_id", WRITE)
    return out.select("work_item_id", "written", "write_error")


@query("apply_append_unique", f"""
WITH {TARGET}
SELECT doc_id, array_to_string(list_concat(tags, list_filter(['en', 't1', 'new'],
  lambda x: NOT list_contains(tags, x))), ',') AS tags FROM target""")
def unique(spark: SparkSession, folder: str) -> DataFrame:
    items = F.array(F.lit("en"), F.lit("t1"), F.lit("new"), F.lit("new"))
    return target(spark, folder).select(
        "doc_id", F.array_join(append_unique(F.col("tags"), items), ",").alias("tags"))


@query("apply_capped", f"""
WITH {TARGET}
SELECT doc_id, array_to_string((list_concat([source, 'b'], tags))[1:3], ',') AS first_kept,
  array_to_string((list_concat(tags, [source, 'b']))[2:4], ',') AS last_kept,
  array_to_string((list_concat([tags[1]], list_concat([source, 'b'], [tags[2]])))[2:4], ',') AS before_last
FROM target""")
def capped(spark: SparkSession, folder: str) -> DataFrame:
    items = F.array(F.col("source"), F.lit("b"))
    return target(spark, folder).select(
        "doc_id", F.array_join(append_capped(F.col("tags"), items, 3, 0), ",").alias("first_kept"),
        F.array_join(append_capped(F.col("tags"), items, 3, None), ",").alias("last_kept"),
        F.array_join(append_capped(F.col("tags"), items, 3, -1), ",").alias("before_last"))


@query("apply_increment", f"""
WITH {TARGET}
SELECT doc_id, coalesce(quality, 0) + 5 AS quality, coalesce(info_score, 0) + 2 AS score,
  info_lang AS lang FROM target""")
def incremented(spark: SparkSession, folder: str) -> DataFrame:
    rows = target(spark, folder)
    score = increment(F.col("info.stats.score"), 2)
    info = set_at_path(F.col("info"), rows.schema["info"].dataType, "stats.score", score)
    return rows.withColumn("info", info).select(
        "doc_id", increment(F.col("quality"), 5).alias("quality"), "info.stats.score", "info.lang")


@query("apply_array_element", f"""
WITH {TARGET}
SELECT doc_id, CASE WHEN lang = 'en' THEN 'en=9,fr=2,en=3' WHEN lang = 'fr' THEN 'fr=9,fr=2,en=3'
  ELSE lang || '=1,fr=2,en=9' END AS marks
FROM target""")
def element(spark: SparkSession, folder: str) -> DataFrame:
    def mark(name, value):
        return F.struct(name.alias("lang"), F.lit(value).alias("n"))

    rows = target(spark, folder).withColumn("marks", F.array(
        mark(F.col("lang"), 1), mark(F.lit("fr"), 2), mark(F.lit("en"), 3)))
    wanted = F.when(F.col("lang") == "fr", "fr").otherwise("en")
    changed = update_first_match(F.col("marks"), rows.schema["marks"].dataType,
                                 lambda x: x["lang"] == wanted, {"n": F.lit(9)})
    texts = F.transform(changed, lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string")))
    return rows.select("doc_id", F.array_join(texts, ",").alias("marks"))


@query("idempotent_items", f"""
WITH {CHANGES}, seen AS (SELECT document_id || ':' || operation AS key,
    TIMESTAMP '2024-01-31' - to_hours(CAST(min(event_id) % 48 AS INTEGER)) AS created_at
  FROM changes WHERE operation = 'insert' GROUP BY 1)
SELECT event_id FROM changes WHERE document_id || ':' || operation NOT IN (
  SELECT key FROM seen WHERE created_at > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)""")
def idempotent(spark: SparkSession, folder: str) -> DataFrame:
    items = changes(spark, folder).select(
        "event_id", F.concat_ws(":", "document_id", "operation").alias("idempotency_key"),
        "operation")
    as_of = F.lit("2024-01-31").cast("timestamp")
    seen = items.where("operation = 'insert'").groupBy(F.col("idempotency_key").alias("key")).agg(
        (as_of - F.make_dt_interval(hours=(F.min("event_id") % 48).cast("int"))).alias("created_at"))
    return fresh_only(items, seen, as_of).select("event_id")


@query("recorded_keys", f"""
WITH {CHANGES}
SELECT document_id || ':' || operation AS key, min('w' || event_id) AS work_item_id
FROM changes GROUP BY 1""")
def recorded(spark: SparkSession, folder: str) -> DataFrame:
    items = changes(spark, folder).select(
        F.concat_ws(":", "document_id", "operation").alias("idempotency_key"),
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("work_item_id"),
        F.lit("a").alias("agent_id"))
    return key_rows(items, F.lit("2024-01-31").cast("timestamp")).select("key", "work_item_id")
