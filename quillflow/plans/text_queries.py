"""Queries that render prompts, apply template filters and mask personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillflow.functions import text as tf
from quillflow.functions.paths import Ref
from quillflow.functions.pii import (
    detect, document_detections, mask_and_detect, mask_document, mask_text, mask_variant, patterns,
    variant_detections)
from quillflow.functions.templates import compile_template, trim_blank_lines
from quillflow.operators.complete import chat_messages, render_prompts
from quillflow.operators.history import detection_counts
from quillflow.operators.match import match_agents
from quillflow.plans.registry import query
from quillflow.plans.views import AGENTS, CHANGES, REQUESTS, changes, requests, spread

TEMPLATE = """

[{{ doc.lang }}] {{ doc.source | default('n/a') }} / {{ doc.nothing | default('none') }}
{% if doc.long %}
Words: {{ doc.text | truncate_words(5, ' ..') }}
{% else %}
All: {{ doc.text | sanitize }}
{% endif %}
Chars: {{ doc.n_chars }}
"""

_WORDS = r"regexp_split_to_array(trim(text, E' \t\n\r'), '\s+')"
_FIRST5 = (f"CASE WHEN len({_WORDS}) <= 5 THEN text "
           f"ELSE array_to_string(({_WORDS})[1:5], ' ') || ' ..' END")


@query("render_template", f"""
SELECT doc_id, '[' || lang || '] ' || source || ' / none' || chr(10) ||
  CASE WHEN n_chars > 400 THEN 'Words: ' || {_FIRST5} || chr(10)
    ELSE 'All: ' || substr(replace(replace(text, '{{{{', '{{ {{'), '}}}}', '}} }}'), 1, 10000) || chr(10) END ||
  'Chars: ' || n_chars AS prompt
FROM documents""")
def template(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(spark, folder, "documents").select("doc_id", F.struct(
        "lang", "source", "text", "n_chars", (F.col("n_chars") > 400).alias("long")).alias("doc"))
    rendered = compile_template(
        TEMPLATE, {"doc": Ref(F.col("doc"), docs.schema["doc"].dataType)})
    return docs.select("doc_id", rendered.text.alias("prompt"))


@query("render_prompts", f"""
WITH {CHANGES}
SELECT event_id, 'kind_watch' AS agent_id, 'Sort ' || kind || ': ' || coalesce(note, 'none') AS prompt,
  NULL::VARCHAR AS system_prompt, NULL::VARCHAR AS render_error
FROM changes WHERE collection = 'c1' AND has_doc AND kind IN ('signup', 'purchase') AND (k >= 50 OR value < 10)
UNION ALL SELECT event_id, 'text_watch', 'Read ' || kind, 'You sort events.', NULL
FROM changes WHERE collection = 'c2' AND has_doc AND operation IN ('insert', 'update')
  AND regexp_matches(kind, '^(click|signup)$') AND k NOT IN (1, 2, 3) AND note IS NOT NULL
UNION ALL SELECT event_id, 'all_watch', 'See ' || document_id || ': ' || coalesce(kind, 'gone'), NULL, NULL
FROM changes WHERE collection = 'c0'
UNION ALL SELECT event_id, 'spend_watch', 'Rate the ' || kind || ' of ' || CAST(value AS VARCHAR), NULL, NULL
FROM changes WHERE collection = 'c0' AND operation IN ('insert', 'update') AND value > 50""")
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    active = [a for a in AGENTS if a.enabled]
    items = match_agents(changes(spark, folder), AGENTS)
    return render_prompts(items, active).select(
        "event_id", "agent_id", "prompt", "system_prompt", "render_error")


@query("undefined_in_prompt", f"""
WITH {CHANGES}
SELECT event_id, CASE WHEN note IS NOT NULL THEN 'Note ' || note END AS prompt,
  CASE WHEN note IS NULL THEN 'Undefined variable: document.note' END AS render_error
FROM changes""")
def undefined(spark: SparkSession, folder: str) -> DataFrame:
    feed = changes(spark, folder)
    document = Ref(F.col("full_document"), feed.schema["full_document"].dataType)
    rendered = compile_template("Note {{ document.note }}", {"document": document})
    return feed.select("event_id", rendered.text.alias("prompt"),
                       rendered.error.alias("render_error"))


@query("template_filters", r"""
SELECT doc_id, to_json({'lang': lang, 'n': n_chars}) AS as_json, to_json(source) AS text_json,
  CASE WHEN length(source || ' ' || lang || ' words here') <= 15 THEN source || ' ' || lang || ' words here'
    ELSE regexp_replace(substr(source || ' ' || lang || ' words here', 1, 7), '^(.*) [^ ]*$', '\1') || '...' END AS cut,
  source || ', ' || lang || ' and ' || 'end' AS listed, substr(source, 1, 3) AS first_three,
  'lang;n' AS names, lang || ';' || n_chars AS contents, lang AS extracted,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 1000 AS INTEGER)), '%d.%m.%Y') AS dated,
  CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE 'no date' END AS parsed_date,
  '{ {x} }' AS safe
FROM documents""")
def filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(spark, folder, "documents").withColumn("pair", F.struct("lang", F.col("n_chars").alias("n")))
    string = T.StringType()
    pair = Ref(F.col("pair"), docs.schema["pair"].dataType)
    phrase = F.concat_ws(" ", "source", "lang", F.lit("words here"))
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
        days=(F.col("doc_id") % 1000).cast("int"))
    maybe = F.when(F.col("doc_id") % 2 == 0, "2024-05-06T07:08:09").otherwise("no date")
    f = tf.FILTERS
    return docs.select(
        "doc_id", f["tojson"](pair).column.alias("as_json"),
        f["json"](Ref(F.col("source"), string)).column.alias("text_json"),
        tf.truncate(phrase, 10).alias("cut"),
        tf.list_to_text(F.array("source", "lang", F.lit("end")), ", ", " and ").alias("listed"),
        f["first_n"](Ref(F.col("source"), string), 3).column.alias("first_three"),
        F.array_join(f["keys"](pair).column, ";").alias("names"),
        F.array_join(f["values"](pair).column, ";").alias("contents"),
        f["extract_field"](pair, "lang").column.alias("extracted"),
        tf.format_date(Ref(day, T.TimestampType()), "%d.%m.%Y").alias("dated"),
        tf.format_date(Ref(maybe, string), "%Y").alias("parsed_date"),
        tf.sanitize(F.lit("{{x}}")).alias("safe"))


# Blank lines go at both ends, white space at the ends of the lines that stay does not.
@query("trim_blank_lines", r"""
WITH padded AS (SELECT doc_id, E'\n  \n\t\n' || text || E'\n \n' AS t FROM documents),
cut AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^([ \t\r\f\v]*\n)+', ''), '(\n[ \t\r\f\v]*)+$', '') AS t FROM padded)
SELECT doc_id, CASE WHEN regexp_full_match(t, '[ \t\r\f\v]*') THEN '' ELSE t END AS trimmed FROM cut""")
def blank_lines(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\n  \n\t\n"), F.col("text"), F.lit("\n \n"))
    return spread(spark, folder, "documents").select("doc_id", trim_blank_lines(padded).alias("trimmed"))


@query("chat_messages", f"""
WITH {REQUESTS}
SELECT id, CASE WHEN system_prompt IS NULL THEN 1 ELSE 2 END AS messages,
  CASE WHEN system_prompt IS NULL THEN 'user' ELSE 'system' END AS first_role, prompt AS last_content
FROM requests""")
def messages(spark: SparkSession, folder: str) -> DataFrame:
    chat = requests(spark, folder).withColumn(
        "m", chat_messages(F.col("prompt"), F.col("system_prompt")))
    return chat.select("id", F.size("m").alias("messages"),
                       F.col("m")[0]["role"].alias("first_role"),
                       F.element_at("m", -1)["content"].alias("last_content"))


# DuckDB has no Unicode word boundaries; the counts agree where the text around a match is ASCII,
# which the tests check against Python on every document.
_SQL_PATTERNS = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?i)\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"(?i)\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"(?i)\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"(?i)\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


def _count_sql(name: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{_SQL_PATTERNS[name]}'))"


def _mask_sql() -> str:
    """Every text with its matches filled by asterisks, pattern after pattern."""
    text = "text"
    for pattern in _SQL_PATTERNS.values():
        text = (f"(SELECT array_to_string(list_transform(list_zip(string_split_regex(t, '{pattern}'), "
                f"regexp_extract_all(t, '{pattern}')), lambda p: p[1] || coalesce(repeat('*', length(p[2])::BIGINT), '')), '') "
                f"FROM (SELECT {text} AS t))")
    return f"SELECT doc_id, {text} AS masked FROM documents"


@query("pii_detect_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS type, CAST(sum({_count_sql(n)}) AS BIGINT) AS detections FROM documents"
    for n in _SQL_PATTERNS))
def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    return detection_counts(spread(spark, folder, "documents"), "text")


@query("pii_by_document", "SELECT * FROM (SELECT doc_id, CAST(" + " + ".join(
    _count_sql(n) for n in _SQL_PATTERNS) + " AS BIGINT) AS detections FROM documents) WHERE detections > 0")
def pii_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(spark, folder, "documents").select("doc_id", F.explode(detect(F.col("text"))))
    return docs.groupBy("doc_id").agg(F.count("*").alias("detections"))


@query("pii_mask", _mask_sql())
def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(spark, folder, "documents")
    return docs.select("doc_id", mask_text(F.col("text")).alias("masked"))


@query("pii_spans")
def pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(spark, folder, "documents").select(
        "doc_id", F.explode(mask_and_detect(F.col("text"))["detections"]).alias("d"))
    return docs.select("doc_id", "d.type", "d.start", "d.end", "d.length")


@query("pii_nested")
def pii_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Masks and detections inside a nested document, limited to the fields ``body`` and ``notes``."""
    docs = spread(spark, folder, "documents").select("doc_id", F.struct(
        F.struct(F.col("text").alias("body"), "lang").alias("main"),
        F.split("text", "\n").alias("notes"), F.col("source").alias("owner")).alias("doc"))
    dtype = docs.schema["doc"].dataType
    fields = ["body", "notes", "main"]
    chosen = patterns(disabled={"phone"})
    rows = docs.select(
        "doc_id",
        mask_document(F.col("doc"), dtype, fields, chosen=chosen).alias("masked"),
        document_detections(F.col("doc"), dtype, fields, chosen=chosen).alias("found"))
    found = rows.select(
        "doc_id", F.md5(F.to_json("masked")).alias("masked_hash"), F.explode_outer("found").alias("d"))
    return found.select("doc_id", "masked_hash", "d.type", "d.path", "d.start", "d.length")


@query("pii_nested_map")
def pii_nested_map(spark: SparkSession, folder: str) -> DataFrame:
    """Masks and detections inside a map, limited to its key ``body``."""
    docs = spread(spark, folder, "documents").select("doc_id", F.create_map(
        F.lit("body"), F.col("text"), F.lit("owner"), F.col("source")).alias("doc"))
    dtype = docs.schema["doc"].dataType
    return docs.select(
        "doc_id", F.md5(F.to_json(mask_document(F.col("doc"), dtype, ["body"]))).alias("masked_hash"),
        F.size(document_detections(F.col("doc"), dtype, ["body"])).alias("detections"))


@query("pii_variant")
def pii_variant(spark: SparkSession, folder: str) -> DataFrame:
    """Masks and detections in schemaless documents: objects in arrays in objects, three fields entered."""
    docs = spread(spark, folder, "documents").withColumn("lines", F.transform(
        F.split("text", "\n"), lambda line: F.struct(line.alias("body"), F.col("source").alias("owner"))))
    doc = F.to_variant_object(F.struct(
        F.struct(F.col("text").alias("body"), "lang", "n_chars").alias("main"),
        F.col("lines").alias("notes"), F.col("source").alias("owner")))
    fields = ["main", "body", "notes"]
    rows = docs.select("doc_id", doc.alias("doc")).select(
        "doc_id", mask_variant(F.col("doc"), fields, levels=3).alias("masked"),
        variant_detections(F.col("doc"), fields, levels=3).alias("found"))
    found = rows.select(
        "doc_id", F.md5(F.to_json("masked")).alias("masked_hash"), F.explode_outer("found").alias("d"))
    return found.select("doc_id", "masked_hash", "d.type", "d.path", "d.start", "d.length")
