"""Catalog, model calls, writes and the streaming flow."""

import hashlib
import json
import os
import random
import threading
import time
from collections import OrderedDict
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import partial

import pytest
from pyspark.sql import functions as F, types as T

from quillflow.operators.apply import (
    Write, append_capped, append_unique, apply_results, set_at_path, update_first_match, write_report)
from quillflow.operators.cache import CACHE_SCHEMA, load_cache, refresh_cache
from quillflow.operators.complete import call_model, complete, render_prompts, with_call_key
from quillflow.operators.match import match_agents, project_fields
from quillflow.plans.answer_queries import demo_client
from quillflow.functions.answers import JSON_START, exact_json
from quillflow.plans.enrich import apply_agents, dispatch, distinct_calls, enrich, work_items, write_of
from quillflow.plans.flow_queries import (
    FLOW_AGENTS, PEOPLE_TARGET, STREAM_AGENTS, USERS_TARGET, _lengths, stream_lengths, stream_store, users)
from quillflow.plans.views import changes, changes_of
from quillflow.session import shared_folder
from quillflow.sources.catalog import (
    Agent, CatalogError, agent_from_dict, catalog_frame, load_agents)
from quillflow.sources.tables import append_keys, drop_keys, live_keys, path_exists
from quillflow.streaming.enrich import EnrichSink, start_enrich
from quillflow.streaming.targets import Target, TargetStore

SMALL = "/root/testdata/sf0.001"


def flaky_client():
    answer = demo_client()

    def client(batch):
        return [{"error": "slow down", "error_type": "AIRateLimitError"} if len(r["prompt"]) % 7 == 3
                else answer([r])[0] for r in batch]

    return client


def test_catalog_files(tmp_path):
    record = {"id": "t", "watch": {"database": "d", "collection": "c", "operations": ["insert"]},
              "ai": {"prompt": "Say {{ document.title }}", "temperature": 0.5},
              "write": {"strategy": "merge"}, "execution": {"max_retries": 2}, "enabled": True}
    (tmp_path / "a.json").write_text(json.dumps(record))
    (tmp_path / "b.yaml").write_text("id: u\nwatch: {database: d, collection: c}\nai: {prompt: Hi}\n")
    first, second = load_agents(str(tmp_path))
    assert (first.operations, first.temperature, first.max_attempts) == (("insert",), 0.5, 3)
    assert (second.operations, second.max_tokens, second.max_retries, second.temperature) == (
        ("insert", "update"), 2048, 3, 0.7)
    for bad in ({"write": {"strategy": "append"}}, {"write": {"strategy": "nested"}},
                {"watch": {"database": "d", "collection": "c", "operations": ["drop"]}},
                {"execution": {"priority": 11}}, {"id": ""}):
        with pytest.raises(CatalogError):
            agent_from_dict({**record, **bad})
    with pytest.raises(CatalogError):
        agent_from_dict({"id": "x"})


def test_filter_gate_without_document(spark):
    rows = [("insert", None), ("delete", None), ("insert", (5,)), ("insert", (50,)), ("update", (50,)),
            ("delete", (50,))]
    feed = spark.createDataFrame(
        [(i, "d", "c", op, doc) for i, (op, doc) in enumerate(rows)],
        "event_id int, database string, collection string, operation string, full_document struct<v:int>")
    agents = [Agent(id="f", database="d", collection="c", operations=("insert", "delete"), prompt="x",
                    filter={"v": {"$gt": 10}}),
              Agent(id="all", database="d", collection="c", operations=("delete",), prompt="x")]
    got = {(r["agent_id"], r["event_id"]) for r in match_agents(feed, agents).collect()}
    assert got == {("f", 0), ("f", 3), ("f", 5), ("all", 1), ("all", 5)}


def test_catalog_is_broadcast_only_when_small(spark):
    few = catalog_frame(spark, [Agent(id="a", database="d", collection="c", prompt="x")])
    assert "broadcast" in few._jdf.queryExecution().logical().toString().lower()
    with pytest.raises(CatalogError):
        catalog_frame(spark, [Agent(id="a", database="d", collection="c", prompt="x")] * 2)


def test_complete_sends_distinct_requests_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client_factory():
        def client(batch):
            if any(r["prompt"] == "boom" for r in batch):
                raise TimeoutError("too slow")
            with open(log, "a") as out:
                out.writelines(r["prompt"] + "\n" for r in batch)
            return [{"content": r["prompt"].upper(), "prompt_tokens": 1, "completion_tokens": 2}
                    for r in batch]
        return client

    rows = [(i, "m", p, None, t, 10) for i, (p, t) in enumerate(
        [("a", 0.0)] * 50 + [("b", 0.0), ("a", 0.5), ("a", 0.5), ("boom", 0.0), (None, 0.0), ("old", 0.0)])]
    requests = spark.createDataFrame(
        rows, "work_item_id long, model string, prompt string, system_prompt string, "
              "temperature double, max_tokens int")
    from quillflow.operators.complete import with_call_key
    cache = with_call_key(requests).where("prompt = 'old'").select(
        "call_key", F.lit("CACHED").alias("content"), F.lit(3).cast("long").alias("total_tokens"))
    done = complete(requests, client_factory, cache=cache, tasks=2).collect()
    assert len(done) == len(rows)
    by_id = {r["work_item_id"]: r for r in done}
    assert by_id[0]["content"] == by_id[49]["content"] == "A" and by_id[0]["total_tokens"] == 3
    assert by_id[53]["error_type"] == "TimeoutError" and by_id[53]["content"] is None
    assert by_id[54]["content"] is None and by_id[55]["content"] == "CACHED"
    assert sorted(open(log).read().split()) == ["a", "a", "a", "b"]


def results_frame(spark, rows):
    frame = spark.createDataFrame(
        rows, "id long, work_item_id string, text string, at int")
    return frame.select(
        "id", "work_item_id", F.parse_json("text").alias("answer"),
        F.timestamp_seconds("at").alias("completed_at"), F.lit("m").alias("model"),
        F.lit("p").alias("provider"), F.lit(1).cast("long").alias("total_tokens"),
        F.lit(0.1).alias("cost_usd"), F.lit(2.0).alias("latency_ms"))


def test_calls_overlap_and_late_ones_are_rows(spark):
    """A slow client: calls of one task run side by side, each within its deadline, order kept."""
    def client_factory():
        def client(batch):
            time.sleep(max(float(r["prompt"].split(":")[1]) for r in batch))
            return [{"content": f"{r['prompt']}|{r['extra_params']}|{r['response_format']}"} for r in batch]

        return client

    rows = [(f"k{i:02}", f"{i}:{6 if i % 8 == 3 else 0.25}", 1.0, '{"seed": 1}' if i % 2 else None, "json_object")
            for i in range(24)]
    calls = spark.createDataFrame(rows, "call_key string, prompt string, timeout_seconds double, "
                                        "extra_params string, response_format string").coalesce(1)
    start = time.time()
    got = call_model(calls, client_factory, batch=1, overlap=8).collect()
    assert time.time() - start < 6
    assert [r["call_key"] for r in got] == [r[0] for r in rows]
    for row, (_, prompt, _, params, kind) in zip(got, rows, strict=True):
        if prompt.endswith(":6"):
            assert (row["content"], row["error_type"], row["error"]) == (None, "TimeoutError", "no answer within 1 s")
        else:
            assert (row["content"], row["error_type"]) == (f"{prompt}|{params}|{kind}", None)


def test_cache_is_written_back_and_equals_an_lru_list(spark):
    """Runs of calls against a plain list; a run after another asks only for what it doesn't know."""
    rng, lru, cache = random.Random(3), OrderedDict(), spark.createDataFrame([], CACHE_SCHEMA)
    as_of = F.lit("2024-01-01 01:00:00").cast("timestamp")
    for run in range(4):
        calls = [(run * 100 + i, f"p{rng.randint(0, 60)}", rng.choice([0.0, 0.0, 0.0, 1.0])) for i in range(100)]
        # Temperatures above 0 are never shared; a text that fails is never kept.
        calls += [(run * 100 + 100, "boom", 0.0)]
        for at, prompt, temperature in calls:
            if temperature == 0 and prompt != "boom":
                lru[prompt] = run if prompt not in lru else lru[prompt]
                lru.move_to_end(prompt)
        while len(lru) > 25:
            lru.popitem(last=False)
        frame = spark.createDataFrame(calls, "at int, prompt string, temperature double").select(
            F.col("at").cast("string").alias("work_item_id"), "prompt", "temperature", F.lit("m").alias("model"),
            F.lit(None).cast("string").alias("system_prompt"), F.lit(5).alias("max_tokens"),
            F.timestamp_seconds(F.col("at") + 1704067200).alias("completed_at"))

        def client_factory(run=run):
            return lambda batch: [{"error": "x", "error_type": "E"} if r["prompt"] == "boom" else
                                  {"content": f"{r['prompt']}/{run}"} for r in batch]

        done = complete(frame, client_factory, cache=cache, as_of=as_of).cache()
        known = {r["content"]: r["used_at"] for r in cache.collect()}
        for row in done.where("temperature = 0 AND prompt <> 'boom'").collect():
            old = [c for c in known if c.startswith(row["prompt"] + "/")]
            assert row["content"] == (old[0] if old else f"{row['prompt']}/{run}")
        rows = refresh_cache(cache, done, as_of, max_rows=25).collect()
        cache = spark.createDataFrame(rows, CACHE_SCHEMA)
        assert sorted(r["content"].split("/")[0] for r in rows) == sorted(lru)
    # An hour and a half later nothing is live.
    late = F.lit("2024-01-01 02:30:00").cast("timestamp")
    assert refresh_cache(cache, done.where("false"), late).count() == 0
    assert refresh_cache(cache, done.where("false"), as_of, max_rows=5).count() == 5


def test_stream_with_a_cache_asks_once(spark):
    root = shared_folder(spark, "cached")
    store = TargetStore(root, (Target("app", "users", "user"),), 2)
    store.create(store.targets[0], users(spark, SMALL))
    agents = [replace(a, deduplicate=False) for a in FLOW_AGENTS if a.id == "kind_watch"]
    feed = changes(spark, SMALL)
    EnrichSink(agents, demo_client, root, store, cache_rows=1000)(feed, 0)

    def offline():
        raise RuntimeError("no calls left")

    before = load_cache(spark, f"{root}/cache")
    assert before.count() == before.select("call_key").distinct().count() > 0
    good = spark.read.parquet(f"{root}/executions").where("success").count()
    known = feed.join(spark.read.parquet(f"{root}/executions").where("NOT success").select("document_id"), "document_id", "left_anti")
    EnrichSink(agents, offline, root, store, cache_rows=1000)(known, 1)
    second = spark.read.parquet(f"{root}/executions").where("batch = 1")
    assert 0 < second.count() <= good and second.where("NOT success").count() == 0


def test_other_parameters_are_other_calls(spark):
    rows = spark.createDataFrame(
        [("a", None, 1.0), ("b", '{"seed": 1}', 1.0), ("c", '{"seed": 1}', 9.0), ("d", None, 1.0)],
        "work_item_id string, extra_params string, timeout_seconds double").withColumns({
            "model": F.lit("m"), "prompt": F.lit("p"), "system_prompt": F.lit(None).cast("string"),
            "temperature": F.lit(0.0), "max_tokens": F.lit(5), "response_format": F.lit("json_object")})
    keys = {r["work_item_id"]: r["call_key"] for r in with_call_key(rows).collect()}
    assert keys["a"] == keys["d"] != keys["b"] == keys["c"]


def test_projection_of_variant_documents(spark):
    docs = spark.createDataFrame(
        [(1, '{"a": 1, "b": {"c": 2, "d": [3]}, "e": 4}'), (2, "[1]"), (3, None), (4, '{"b": 5}'), (5, "{}")],
        "i int, t string").select("i", F.try_parse_json("t").alias("v"))
    got = {r["i"]: r["t"] for r in docs.select("i", F.to_json(project_fields(
        F.col("v"), T.VariantType(), ["a", "b.d", "x.y"])).alias("t")).collect()}
    assert got == {1: '{"a":1,"b":{"d":[3]}}', 2: None, 3: None, 4: "{}", 5: "{}"}
    agent = Agent("p", "app", "in", "{{ document.a }}{{ document.e | default('-') }}", projection=("a",))
    items = docs.where("i = 1").select(
        F.col("v").alias("full_document"), F.lit("p").alias("agent_id"),
        *(F.lit("x").alias(c) for c in ("operation", "database", "collection", "document_id")))
    assert render_prompts(items, [agent]).first()["prompt"] == "1-"


def test_budgets_of_a_stream(spark):
    """A second batch knows what the first one spent; refused items are failures that run again."""
    root = shared_folder(spark, "budget")
    store = TargetStore(root, (Target("app", "users", "user"),), 2)
    store.create(store.targets[0], users(spark, SMALL))
    agents = [replace(a, token_limit=1, deduplicate=False) for a in FLOW_AGENTS if a.id == "all_watch"]
    sink = EnrichSink(agents, demo_client, root, store)
    feed = changes(spark, SMALL).where("collection = 'c0'").withColumn(
        "ts", F.lit("2024-01-01 10:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id")))
    sink(feed.where("event_id < 30"), 0)
    sink(feed.where("event_id >= 30 AND event_id < 60"), 1)
    sink(feed.where("false"), 2)
    ran = spark.read.parquet(f"{root}/executions").where("batch < 2")
    found = {r["batch"]: r["kinds"] for r in ran.groupBy("batch").agg(
        F.collect_set(F.coalesce("error_type", F.lit("ok"))).alias("kinds")).collect()}
    assert "AgentLimitError" not in found[0] and found[1] == ["AgentLimitError"]
    planned = spark.read.parquet(f"{root}/retries").where("batch = 1")
    assert planned.count() == ran.where("batch = 1").count() > 0


def test_merge_keeps_absent_and_writes_null(spark):
    target = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", 7), (4, "w", 8)],
                                   "id long, a string, b int")
    results = results_frame(spark, [
        (1, "w1", '{"a": "new"}', 10), (1, "w2", '{"b": 9}', 5), (1, "w3", '{"a": "old"}', 1),
        (2, "w4", '{"a": null}', 1), (3, "w5", '["list"]', 1), (9, "w6", '{"a": "lost"}', 1)])
    write = Write(types={"a": "string", "b": "int"})
    out = {r["id"]: r for r in apply_results(target, results, "id", write).collect()}
    assert len(out) == 4
    assert (out[1]["a"], out[1]["b"], out[1]["_ai_metadata"]["work_item_id"]) == ("new", 9, "w1")
    assert (out[2]["a"], out[2]["b"]) == (None, 6)
    assert (out[3]["a"], out[3]["_ai_metadata"]) == ("z", None)
    report = {r["work_item_id"]: (r["written"], r["write_error"])
              for r in write_report(results, target, "id", write).collect()}
    assert report["w5"] == (False, "list_requires_append")
    assert report["w6"] == (False, "document_not_found") and report["w1"] == (True, None)


def test_append_in_completion_order(spark):
    target = spark.createDataFrame([(1, [(0,)]), (2, None)], "id long, log array<struct<n:int>>")
    results = results_frame(spark, [
        (1, "b", '{"n": 2}', 20), (1, "a", '{"n": 1}', 10), (1, "c", '[{"n": 3}, {"n": 4}]', 30)])
    write = Write(types={"n": "int"}, strategy="append", array_field="log", include_metadata=False)
    out = {r["id"]: r["log"] for r in apply_results(target, results, "id", write).collect()}
    assert [x["n"] for x in out[1]] == [0, 1, 2, 3, 4] and out[2] is None


def test_array_functions(spark):
    row = spark.sql("select array(1, 1, 2) a, cast(null as array<int>) n, "
                    "array(named_struct('k', 'x', 'v', 1), named_struct('k', 'x', 'v', 2)) s").select(
        append_unique(F.col("a"), F.expr("array(2, 3, 3)")).alias("unique"),
        append_capped(F.col("a"), F.expr("array(7, 8)"), 4, 0).alias("front"),
        append_capped(F.col("a"), F.expr("array(7, 8)"), 4, None).alias("end"),
        append_capped(F.col("a"), F.expr("array(7)"), 9, 1).alias("inside"),
        append_capped(F.col("a"), F.expr("array(7)"), 9, -1).alias("before_last"),
        append_capped(F.col("n"), F.expr("array(7)"), 3, None).alias("missing"),
        update_first_match(F.col("s"), spark.sql(
            "select array(named_struct('k', 'x', 'v', 1)) s").schema["s"].dataType,
            lambda e: e["k"] == "x", {"v": F.lit(9)}).alias("first")).first()
    assert row["unique"] == [1, 1, 2, 3] and row["front"] == [7, 8, 1, 1]
    assert row["end"] == [1, 2, 7, 8] and row["inside"] == [1, 7, 1, 2]
    assert row["before_last"] == [1, 1, 7, 2] and row["missing"] == [7]
    assert [e["v"] for e in row["first"]] == [9, 2]


def test_set_at_path_creates_structs(spark):
    frame = spark.sql("select cast(null as struct<a:struct<x:int>,b:int>) s "
                      "union all select named_struct('a', named_struct('x', 1), 'b', 2)")
    dtype = frame.schema["s"].dataType
    out = frame.select(set_at_path(F.col("s"), dtype, "a.y", F.lit(5)).alias("s")).collect()
    assert sorted([r["s"].asDict(True) for r in out], key=str) == [
        {"a": {"x": 1, "y": 5}, "b": 2}, {"a": {"x": None, "y": 5}, "b": None}]


def test_write_of_uses_schema_types():
    agent = Agent(id="a", database="d", collection="c", prompt="x", response_schema={
        "type": "object", "properties": {"n": {"type": "integer"},
                                         "l": {"type": "array", "items": {"type": "number"}}}})
    assert write_of(agent).types == {"n": "bigint", "l": "array<double>", "content": "string"}


@pytest.fixture(scope="module")
def batch_result(spark):
    items = dispatch(work_items(changes(spark, SMALL), FLOW_AGENTS))
    results = enrich(items, FLOW_AGENTS, flaky_client)
    return sorted(map(str, _lengths(apply_agents(
        users(spark, SMALL), results, FLOW_AGENTS, "user", "app", "users")).collect()))


def split_feed(spark, folder, parts):
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts")
    bounds = events.approxQuantile("event_id", [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low, high = bounds[i], bounds[i + 1]
        last = F.lit(i == parts - 1)
        chosen = events.where((F.col("event_id") >= low) & (last | (F.col("event_id") < high)))
        chosen.coalesce(1).write.mode("append").parquet(folder)
    return events.schema


def start(spark, feed, schema, sink, root):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(feed)
    start_enrich(changes_of(stream), sink, f"{root}/checkpoint", available_now=True).awaitTermination()


def shown(rows):
    return sorted(map(str, rows.collect()))


def test_stream_equals_batch_and_replay_changes_nothing(spark, batch_result):
    root = shared_folder(spark, "flow")
    schema = split_feed(spark, f"{root}/feed", 3)
    store = stream_store(spark, SMALL, root, 4)
    sink = EnrichSink(STREAM_AGENTS, flaky_client, root, store)
    start(spark, f"{root}/feed", schema, sink, root)
    assert shown(stream_lengths(spark, store, STREAM_AGENTS)) == batch_result
    history = spark.read.parquet(f"{root}/executions")
    assert history.select("id", "attempt").distinct().count() == history.count()
    assert history.where("success AND NOT written").count() == 0
    keys = spark.read.parquet(f"{root}/keys")
    assert keys.select("key").distinct().count() == keys.count()
    retries = spark.read.parquet(f"{root}/retries")
    dead = spark.read.parquet(f"{root}/dead_letters")
    assert retries.count() + dead.count() == history.where("NOT success").count()
    attempts = {r["attempt"] for r in retries.select("attempt").distinct().collect()}
    assert 1 in attempts and max(attempts) <= 3
    # The last batch again, as after a crash: the same files, the same table.
    count = history.count()
    feed = changes_of(spark.read.schema(schema).parquet(f"{root}/feed"))
    last = max(r["batch"] for r in keys.select("batch").distinct().collect())
    sink(feed, last)
    assert shown(stream_lengths(spark, store, STREAM_AGENTS)) == batch_result
    assert spark.read.parquet(f"{root}/executions").count() == count
    assert path_exists(spark, f"{root}/stages/batch={last}/answers/_SUCCESS")
    # A new base holds the same rows; only batches after it are read from the changes.
    before = shown(store.read(spark, USERS_TARGET, STREAM_AGENTS))
    assert store.compact(spark, USERS_TARGET, STREAM_AGENTS) == last
    assert store.base(spark, USERS_TARGET)[1] == last and store.base(spark, PEOPLE_TARGET)[1] == -1
    assert shown(store.read(spark, USERS_TARGET, STREAM_AGENTS)) == before
    assert store.compact(spark, USERS_TARGET, STREAM_AGENTS) == last


def test_only_results_that_reach_a_table_count_as_written(spark):
    """Two targets, lists, answers without schema, unknown documents and collections."""
    def client_factory():
        def client(batch):
            return [{"content": request["prompt"], "cost_usd": 0.0} for request in batch]

        return client

    root = shared_folder(spark, "targets")
    agent = partial(Agent, database="app", collection="in", prompt="{{ document.say }}", temperature=0.0,
                    include_metadata=False, deduplicate_window_seconds=0)
    agents = [
        agent("typed", target_collection="one", response_schema={
            "type": "object", "properties": {"n": {"type": "integer"}}}),
        agent("open", target_collection="two"),
        agent("lost", target_collection="nowhere"),
        agent("pile", target_collection="two", strategy="append", array_field="items"),
    ]
    one, two = Target("app", "one", "id"), Target("app", "two", "key")
    store = TargetStore(root, (one, two), 4)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n tinyint")
    store.create(one, rows)
    store.create(two, rows.select(F.col("id").alias("key")))
    sink = EnrichSink(agents, client_factory, root, store)

    def events(*pairs):
        return spark.createDataFrame(
            [(i, "app", "in", "insert", key, (say,), datetime(2024, 1, 1, 0, i)) for i, key, say in pairs],
            "event_id int, database string, collection string, operation string, document_id string, "
            "full_document struct<say:string>, ts timestamp")

    sink(events((1, "a", '{"n": 5, "x": "p"}'), (2, "b", "[1, 2]"), (3, "zz", '{"n": 6}')), 0)
    sink(events((4, "a", '{"n": 7000, "y": 1}'), (5, "b", "plain")), 1)
    sink(events(), 2)
    history = {(r["agent_id"], r["document_id"], r["batch"]): (r["written"], r["write_error"])
               for r in spark.read.parquet(f"{root}/executions").collect()}
    assert len(history) == 20
    for (name, document, batch), found in history.items():
        error = ("target_not_found" if name == "lost"
                 else "list_requires_append" if (document, batch) == ("b", 0) and name != "pile"
                 else "document_not_found" if document == "zz" else None)
        assert found == (error is None, error), (name, document, batch)
    keys = spark.read.parquet(f"{root}/keys")
    assert keys.count() == sum(written for written, _ in history.values())
    assert "lost" not in {r["agent_id"] for r in keys.collect()}

    def check():
        first = {r["id"]: r for r in store.read(spark, one, agents).collect()}
        # 7000 doesn't fit the column, so the value before it stays.
        assert (first["a"]["n"], first["b"]["n"], set(first)) == (5, 2, {"a", "b"})
        text = store.read(spark, two, agents).select(
            "key", F.to_json("_fields").alias("f"), F.col("content"),
            F.transform("items", lambda v: F.to_json(v)).alias("items"))
        second = {r["key"]: r for r in text.collect()}
        assert json.loads(second["a"]["f"]) == {"n": 7000, "x": "p", "y": 1} and second["a"]["content"] is None
        assert second["b"]["content"] == "plain" and second["b"]["f"] is None
        assert len(second["a"]["items"]) == 2 and len(second["b"]["items"]) == 3

    check()
    sink(events((4, "a", '{"n": 7000, "y": 1}'), (5, "b", "plain")), 1)
    check()
    for target in (one, two):
        assert store.compact(spark, target, agents) == 2
    check()


def test_keys_of_old_hours_are_not_read(spark):
    root = shared_folder(spark, "keys")
    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([("w", "a")], "work_item_id string, agent_id string")
    files = []
    for batch in range(8):
        at = begin + timedelta(hours=batch)
        append_keys(rows.withColumn("idempotency_key", F.lit(f"k{batch}")), root, batch, at)
        files.append(len(live_keys(spark, root, at, 2 * 3600).inputFiles()))
    # Three hours at most are within reach of two hours, however many batches ran.
    assert files[:3] == [1, 2, 3] and set(files[2:]) == {3}
    assert drop_keys(spark, root, begin + timedelta(hours=7), 2 * 3600) == 5
    assert {r["key"] for r in spark.read.parquet(root).collect()} == {"k5", "k6", "k7"}
    assert live_keys(spark, f"{root}/none", begin, 60).count() == 0


def test_failed_items_run_again(spark, tmp_path):
    marks = str(tmp_path)

    def client_factory():
        answer = demo_client()

        def client(batch):
            out = []
            for request in batch:
                mark = os.path.join(marks, hashlib.md5(request["prompt"].encode()).hexdigest())
                if len(request["prompt"]) % 7 == 3 and not os.path.exists(mark):
                    open(mark, "w").close()
                    out.append({"error": "slow down", "error_type": "AIRateLimitError"})
                else:
                    out.append(answer([request])[0])
            return out

        return client

    root = shared_folder(spark, "again")
    store = TargetStore(root, (Target("app", "users", "user"),), 2)
    store.create(store.targets[0], users(spark, SMALL))
    agents = [replace(a, target_collection="elsewhere") for a in FLOW_AGENTS]
    sink = EnrichSink(agents, client_factory, root, store)
    feed = changes(spark, SMALL)
    sink(feed.where("event_id < 500"), 0)
    sink(feed.where("event_id >= 500"), 1)
    sink(feed.where("false"), 2)
    sink(feed.where("false"), 3)
    history = [r.asDict() for r in spark.read.parquet(f"{root}/executions").collect()]
    first_failures = {r["id"] for r in history if r["attempt"] == 0 and not r["success"]}
    second = {r["id"]: r["success"] for r in history if r["attempt"] == 1}
    assert first_failures and set(second) == first_failures and all(second.values())
    assert max(r["attempt"] for r in history) == 1
    assert not any(r["written"] for r in history) and spark.read.parquet(f"{root}/keys").count() == 0


def test_calls_with_a_deadline_share_a_thread(spark):
    """A task makes no thread per call; equal shared requests count as one when tasks are dealt."""
    def make():
        own = threading.local()

        def client(batch):
            own.calls = getattr(own, "calls", 0) + 1
            return [{"content": str(own.calls)} for _ in batch]

        return client

    rows = [(str(k), f"p{k}", 30.0) for k in range(40)]
    calls = spark.createDataFrame(rows, "call_key string, prompt string, timeout_seconds double").coalesce(1)
    done = call_model(calls, make, batch=10).collect()
    assert sorted({r["content"] for r in done}) == ["1", "2", "3", "4"]

    requests = spark.range(5000).selectExpr(
        "'a' AS agent_id", "concat('p', id % 10) AS prompt", "CAST(null AS string) AS system_prompt",
        "IF(id < 1000, 0.7, 0.0) AS temperature")
    assert 1010 <= distinct_calls(requests) <= 1012


def test_texts_that_cannot_be_json_are_told_by_their_start(spark):
    texts = ["Result: {\"a\": 1}", " \t\n{\"a\": 1}", "-1", "\"x\"", "]", "nul", "null", "true", "+1", "", "1]", "é", "[1]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.to_json(exact_json(F.col("t"))).alias("v"), F.col("t").rlike(JSON_START).alias("maybe")).collect()
    found = {r["t"]: r["v"] for r in rows if r["v"] is not None}
    assert found == {" \t\n{\"a\": 1}": "{\"a\":1}", "-1": "-1", "\"x\"": "\"x\"", "null": "null", "true": "true", "[1]": "[1]"}
    assert not any(r["maybe"] for r in rows if r["t"] in ("Result: {\"a\": 1}", "]", "+1", "", "é"))


def test_reports_of_a_batch_hold_no_texts(spark):
    """Stored reports are what targets, keys and executions need; texts lie in the results alone."""
    root = shared_folder(spark, "slim")
    sink = EnrichSink(STREAM_AGENTS, demo_client, root, stream_store(spark, SMALL, root))
    sink(changes(spark, SMALL).where("event_id < 40"), 0)
    report = spark.read.parquet(f"{root}/stages/batch=0/report")
    results = spark.read.parquet(f"{root}/stages/batch=0/results")
    assert not {"prompt", "system_prompt", "content", "parsed"} & set(report.columns)
    assert {"prompt", "content", "answer"} <= set(results.columns)
    assert report.count() == results.count() > 0
