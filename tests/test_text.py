"""Answers, templates and personal data against hand cases and Python loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from quillflow.functions import pii
from quillflow.functions.answers import parse_answers, pick_field
from quillflow.functions.keys import canonical_json
from quillflow.functions.paths import Ref
from quillflow.functions.templates import TemplateError, compile_template

ANSWERS = [
    ('{"category": "technical", "priority": "high"}', "whole",
     {"category": "technical", "priority": "high"}),
    ('```json\n{"result": "success"}\n```', "fenced", {"result": "success"}),
    ('["item1", "item2", "item3"]', "whole", ["item1", "item2", "item3"]),
    ('{"user": {"name": "John", "age": 30}, "active": true}', "whole",
     {"user": {"name": "John", "age": 30}, "active": True}),
    ('Here is the result: {"status": "ok"} Hope this helps!', "object", {"status": "ok"}),
    ("This is not JSON at all", "raw", {"content": "This is not JSON at all", "_raw": True}),
    ('{"a": 1} x', "object", {"a": 1}),
    ("null", "raw", {"content": "null", "_raw": True}),
    ("{'a': 1, b: 2,}", "repaired", {"a": 1, "b": 2}),
    ("x [1, [2]] y", "array", [1, [2]]),
    ('```JSON\n[1, {"a": 2}]```', "fenced", [1, {"a": 2}]),
    ("  12 ", "whole", 12),
    ('{"a": 1}{"b": 2}', "object", {"a": 1}),
    ('{"a": 1, "a": 2}', "whole", {"a": 2}),
    ('{"a": {"b": {"c": 1}}} tail', "object", {"b": {"c": 1}}),
    ("Look: [a: 1, b: 2", "raw", {"content": "Look: [a: 1, b: 2", "_raw": True}),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, content string")


def test_strategies(answers):
    rows = parse_answers(answers, "content").select(
        "i", "parse_strategy", F.to_json("parsed").alias("p")).collect()
    for row in rows:
        text, strategy, value = ANSWERS[row["i"]]
        assert (row["parse_strategy"], json.loads(row["p"])) == (strategy, value), text


def test_strict_and_blank(spark, answers):
    strict = {r["i"]: r["parse_error"] for r in parse_answers(answers, "content", strict=True).collect()}
    assert strict[5] == "Could not extract JSON from response" and strict[0] is None
    blank = parse_answers(spark.createDataFrame([(" \n ",), (None,)], "c string"), "c").collect()
    assert {r["parse_error"] for r in blank} == {"Empty response content"}


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["score", "tags"], "properties": {
        "score": {"type": "number"}, "kind": {"type": "string", "enum": ["a", "b"]},
        "tags": {"type": "array", "items": {"type": "string"}},
        "deep": {"type": "object", "properties": {"n": {"type": "integer"}}}}}
    cases = [
        ('{"score": 1, "tags": []}', []),
        ('{"score": 1.5, "tags": ["x", 3, null], "kind": "c"}',
         ["kind.Value must be one of: ['a', 'b']", "tags.[1].Expected type 'string', got 'int'",
          "tags.[2].Expected type 'string', got 'NoneType'"]),
        ('{"score": "high", "deep": {"n": 2.0}}',
         ["Missing required field: 'tags'", "score.Expected type 'number', got 'str'",
          "deep.n.Expected type 'integer', got 'float'"]),
        ('{"score": true, "tags": null}',
         ["score.Expected type 'number', got 'bool'", "tags.Expected type 'array', got 'NoneType'"]),
        ("[1]", ["Expected type 'object', got 'list'"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, c string")
    for row in parse_answers(df, "c", schema).collect():
        assert row["schema_errors"] == cases[row["i"]][1]
    strict = {r["i"]: r for r in parse_answers(df, "c", schema, strict=True).select(
        "i", "parse_error", F.col("parsed").isNull().alias("gone")).collect()}
    assert strict[0]["parse_error"] is None and not strict[0]["gone"]
    assert strict[4]["parse_error"].startswith("Schema validation failed: ") and strict[4]["gone"]


def test_pick_field(answers):
    rows = parse_answers(answers, "content").select(
        "i", pick_field(F.col("parsed"), "user.age", "int", -1).alias("age"),
        pick_field(F.col("parsed"), "0").alias("first")).collect()
    assert [r["age"] for r in rows if r["i"] in (0, 3)] == [-1, 30]
    assert all(r["first"] is None for r in rows)


def test_python_json_agrees(spark, answers):
    texts = [a[0] for a in ANSWERS] + ['"x', "1 2", "[1] [2]", '{"a":1},', "1,2", '"a" : 1', "[]", "{}",
                                        '1}{"a":2', "1],[2", "-0.5e3", "01", "tru", "'a'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    whole = {r["i"] for r in parse_answers(df, "c").where("parse_strategy = 'whole'").collect()}
    for i, text in enumerate(texts):
        try:
            ok = json.loads(text.strip()) is not None
        except ValueError:
            ok = False
        assert (i in whole) == ok, text


DOC = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("n", T.DoubleType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("prio", T.StringType()),
    T.StructField("on", T.BooleanType()),
    T.StructField("o", T.StructType([T.StructField("a", T.IntegerType())]))])

TEMPLATES = [
    ("Hello {{ document.title }}!", "Hello Hello wide world of words!"),
    ("{{ document.o.a }} {{ document['n'] }} {{ document.on }}", "1 1.5 True"),
    ("{{ document.title | truncate(10) }}", "Hello..."),
    ("{{ document.title | truncate_words(2, '..') }}", "Hello wide.."),
    ("{{ document.title | truncate_words(9) }}", "Hello wide world of words"),
    ("{{ document.prio | default('N/A') }}", "N/A"),
    ("{{ document.o | tojson }}|{{ document.title | json }}", '{"a":1}|"Hello wide world of words"'),
    ("{% if document.get('prio') %}P: {{ document.prio }}{% endif %}", ""),
    ("{% if document.on %}yes{% else %}no{% endif %}", "yes"),
    ("{% if not document.on %}yes{% else %}no{% endif %}", "no"),
    ("A\n  {% if document.on %}\n  B\n  {% endif %}\nC", "A\n  B\nC"),
    ("\n\n   \n  Title: {{ document.title }}\n  x\n  ", "  Title: Hello wide world of words\n  x"),
    ("{{ document.tags | list_to_text(', ', ' and ') }}", "a, b and c"),
    ("{{ document.tags | first_n(2) | list_to_text('|') }}", "a|b"),
    ("{{ document.prio }}", None), ("{{ document.nothing }}", None),
]


def test_templates(spark):
    frame = spark.createDataFrame(
        [((("Hello wide world of words"), 1.5, ["a", "b", "c"], None, True, (1,)),)],
        T.StructType([T.StructField("doc", DOC)]))
    context = {"document": Ref(F.col("doc"), DOC)}
    compiled = [compile_template(t, context) for t, _ in TEMPLATES]
    row = frame.select(*[c.text.alias(f"t{i}") for i, c in enumerate(compiled)],
                       *[c.error.alias(f"e{i}") for i, c in enumerate(compiled)]).first()
    for i, (template, want) in enumerate(TEMPLATES):
        assert row[f"t{i}"] == want, template
        assert (row[f"e{i}"] is None) == (want is not None), template


@pytest.mark.parametrize("template", [
    "{% for x in y %}{{ x }}{% endfor %}", "{{ a + b }}", "{{ document.title | shout }}",
    "{% if document.on %}x", "{% endif %}"])
def test_refused_templates(spark, template):
    with pytest.raises(TemplateError):
        compile_template(template, {"document": Ref(F.col("doc"), DOC)})


TRICKY = ["", "no data", "mail a.b@c.de, A@B.COM!", "call (555) 123-4567 or +1 555.123.4567",
          "ssn 123-45-6789 card 1234-5678 9012 3456", "ip 10.0.0.1 and 999.1.1.1.1",
          "é1.2.3.4é x@y.zzé", "1234567890123456 123 456 7890", "a@b.co a@b.co", "٣٤٥-٤٥-٦٧٨٩"]


def python_masks(text):
    found = []
    for name, pattern in pii.PATTERNS.items():
        compiled = re.compile(pattern, re.IGNORECASE)
        found += [(name, m.start(), m.end(), m.end() - m.start()) for m in compiled.finditer(text)]
        text = compiled.sub(lambda m: "*" * len(m.group()), text)
    return text, found


def test_masks_equal_python(spark):
    hand = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = hand.unionByName(docs).select(
        "doc_id", "text", pii.mask_text(F.col("text")).alias("m"),
        pii.mask_and_detect(F.col("text")).alias("d"), pii.detect(F.col("text")).alias("f"))
    for row in rows.collect():
        masked, found = python_masks(row["text"])
        assert row["m"] == row["d"]["text"] == masked
        assert [tuple(x) for x in row["d"]["detections"]] == found
        plain = [(n, m.start(), m.end(), m.group()) for n, p in pii.PATTERNS.items()
                 for m in re.finditer(p, row["text"], re.IGNORECASE)]
        assert [tuple(x) for x in row["f"]] == plain


def test_nested_masks(spark):
    frame = spark.sql("select named_struct('a', named_struct('b', array('x@y.de', 'z')), "
                      "'c', '10.0.0.1', 'n', 5) doc")
    dtype = frame.schema["doc"].dataType
    row = frame.select(
        pii.mask_document(F.col("doc"), dtype).alias("all"),
        pii.mask_document(F.col("doc"), dtype, fields=["c"]).alias("one"),
        pii.mask_document(F.col("doc"), dtype, recursive=False).alias("flat"),
        pii.document_detections(F.col("doc"), dtype).alias("found"),
        pii.mask_text(F.lit("id X1"), pii.patterns(custom={"id": r"X\d"}, disabled={"phone"})).alias("own"),
    ).first()
    assert row["all"].asDict(True) == {"a": {"b": ["******", "z"]}, "c": "********", "n": 5}
    assert row["one"].asDict(True) == {"a": {"b": ["x@y.de", "z"]}, "c": "********", "n": 5}
    assert row["flat"].asDict(True) == {"a": {"b": ["x@y.de", "z"]}, "c": "********", "n": 5}
    assert [(d["type"], d["path"]) for d in row["found"]] == [("email", "a.b[0]"), ("ip_address", "c")]
    assert row["own"] == "id **"


def test_nested_masks_of_maps_and_variants(spark):
    frame = spark.sql("select named_struct('m', map('a', 'x@y.de', 'b', '10.0.0.1'), "
                      "'s', map('k', named_struct('t', array('x@y.de'), 'u', '10.0.0.1'))) doc, "
                      "named_struct('v', parse_json('{\"a\": \"x@y.de\"}'), 'c', 'x@y.de') var")
    dtype, var = frame.schema["doc"].dataType, frame.schema["var"].dataType
    mask = lambda **options: pii.mask_document(F.col("doc"), dtype, **options)
    row = frame.select(
        mask().alias("all"), mask(fields=["m.a", "s.k.t"]).alias("some"), mask(recursive=False).alias("flat"),
        pii.document_detections(F.col("doc"), dtype).alias("found"),
        pii.document_detections(F.col("doc"), dtype, ["m.a", "s.k.t"]).alias("few"),
        pii.mask_document(F.col("var"), var, ["c"]).getField("c").alias("beside"),
    ).first()
    mail, address = "*" * 6, "*" * 8
    assert row["all"].asDict(True) == {"m": {"a": mail, "b": address}, "s": {"k": {"t": [mail], "u": address}}}
    assert row["some"].asDict(True) == {"m": {"a": mail, "b": "10.0.0.1"}, "s": {"k": {"t": [mail], "u": "10.0.0.1"}}}
    assert row["flat"].asDict(True) == {"m": {"a": "x@y.de", "b": "10.0.0.1"}, "s": {"k": {"t": ["x@y.de"], "u": "10.0.0.1"}}}
    assert [d["path"] for d in row["found"]] == ["m.a", "m.b", "s.k.t[0]", "s.k.u"]
    assert [d["path"] for d in row["few"]] == ["m.a", "s.k.t[0]"] and row["beside"] == mail
    row = frame.select(pii.mask_document(F.col("var"), var).getField("v").cast("string").alias("v"),
                       pii.document_detections(F.col("var"), var).alias("found")).first()
    assert row["v"] == json.dumps({"a": mail}).replace(" ", "")
    assert [d["path"] for d in row["found"]] == ["v.a", "c"]


def walked(value, fields, recursive, path, found):
    """The value with its strings masked, entries of objects by name or path."""
    if isinstance(value, str):
        masked, hits = python_masks(value)
        found += [(*hit, path) for hit in hits]
        return masked
    if isinstance(value, list):
        return [walked(x, fields, recursive, f"{path}[{i}]", found) for i, x in enumerate(value)]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, inner in value.items():
        here = f"{path}.{key}" if path else key
        enter = fields is None or key in fields or any(f.startswith(here) for f in fields)
        enter = enter and (recursive or not isinstance(inner, dict))
        out[key] = walked(inner, fields, recursive, here, found) if enter else inner
    return out


def made_document(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        return {rng.choice(["a", "b", "a b", "c.d", ""]): made_document(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.75:
        return [made_document(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, 7, 1.5, "", "x@y.de", "[1]", '{"a": "x@y.de"}', *TRICKY])


def nesting(value):
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inner is None else 1 + max(map(nesting, inner), default=0)


@pytest.mark.parametrize("fields,recursive", [
    (None, True), (None, False), (["b"], True), (["a.b[0].a", "a b"], True), (["a", "c.d"], False)])
def test_masks_of_variants_equal_a_plain_walk(spark, fields, recursive):
    rng = random.Random(7)
    docs = [made_document(rng, 4) for _ in range(150)]
    docs += [{}, [], None, "x@y.de", {"a": {}}, {"a": []}, {"a": [{"b": [{"a": "x@y.de"}]}]}, {"k\\\"]": ["}\"", "10.0.0.1"]}]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None)], "i int, t string")
    frame = frame.repartition(4).select("i", F.try_parse_json("t").alias("v"))
    rows = {r["i"]: r for r in frame.select(
        "i", F.to_json(pii.mask_variant(F.col("v"), fields, recursive, levels=5)).alias("masked"),
        pii.variant_detections(F.col("v"), fields, recursive, levels=5).alias("found"),
        pii.variant_depth(F.col("v")).alias("depth")).collect()}
    assert rows[-1]["masked"] is None and rows[-1]["found"] == [] and rows[-1]["depth"] is None
    for i, doc in enumerate(docs):
        found = []
        want = walked(doc, fields, recursive, "", found)
        assert json.loads(rows[i]["masked"]) == want, doc
        assert sorted(tuple(d) for d in rows[i]["found"]) == sorted(found), doc
        assert rows[i]["depth"] == nesting(doc), doc


def test_names_with_quotes_are_other_documents(spark):
    frame = spark.createDataFrame([(json.dumps({'a": 1, "b': 2}),), (json.dumps({"a": 1, "b": 2}),)], "t string")
    texts = [r[0] for r in frame.select(canonical_json(F.parse_json("t"), T.VariantType())).collect()]
    assert texts == ['{"a\\": 1, \\"b":2}', '{"a":1,"b":2}']
    # Without volatile fields, for VARIANT and maps.
    kept = spark.sql("SELECT parse_json('{\"updated_at\": 3, \"b\": 1, \"_ai_x\": 4, \"a\": [2]}') v, "
                     "map('updated_at', array(1), 'b', array(2)) m")
    row = kept.select(canonical_json(F.col("v"), T.VariantType()).alias("v"),
                      canonical_json(F.col("m"), kept.schema["m"].dataType).alias("m")).first()
    assert (row["v"], row["m"]) == ('{"a":[2],"b":1}', '{"b":[2]}')


def test_a_variant_deeper_than_the_mask_is_an_error(spark):
    deep = spark.sql("SELECT parse_json('[[[\"x@y.de\"]]]') v")
    assert deep.select(pii.mask_variant(F.col("v"), levels=3).cast("string")).first()[0] == '[[["******"]]]'
    for mask in (pii.mask_variant, pii.variant_detections):
        with pytest.raises(Exception, match="more levels"):
            deep.select(mask(F.col("v"), levels=2).cast("string")).collect()


def test_parts_of_default_patterns_refuse_no_match(spark):
    """The quick tests before the default patterns change nothing: as custom patterns they run without them."""
    assert set(pii._PARTS) | {"email"} == set(pii.patterns())
    pick = random.Random(4)
    marks = ["555-123-4567", "(555)1234567", "+1 555.123.4567", "123-45-6789", "4111 1111 1111 1111", "10.0.0.1",
             "٣٤٥-١٢-٦٧٨٩", "١.٢.٣.٤", "4111-1111-11111111", "a@b.co", "12", "x-12-y", "1.2", "1234", "é"]
    texts = ["".join(pick.choice([*marks, " ", " und ", "-", "."]) for _ in range(pick.randint(0, 8))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = {name: f"{pattern}(?:)" for name, pattern in pii.patterns().items()}
    both = rows.select(*(f(F.col("t"), chosen).alias(f"{name}{k}") for k, chosen in enumerate((None, plain))
                         for name, f in (("mask", pii.mask_text), ("both", pii.mask_and_detect), ("found", pii.detect)))).collect()
    assert all((r.mask0, r.both0, r.found0) == (r.mask1, r.both1, r.found1) for r in both)
    assert {d.type for r in both for d in r.found0} == set(pii.patterns())
