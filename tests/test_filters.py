"""Filter Columns against a plain evaluator over the same documents."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from quillflow.functions.filters import FilterError, compile_filter

ITEM = T.StructType([T.StructField("name", T.StringType())])
SCHEMA = T.StructType([
    T.StructField("s", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("o", T.StructType([
        T.StructField("x", T.IntegerType()), T.StructField("items", T.ArrayType(ITEM))])),
    T.StructField("t", T.TimestampType())])

DOCUMENTS = [
    {"s": "Alpha", "n": 5, "d": 1.5, "b": True, "tags": ["a", "b"],
     "o": {"x": 1, "items": [{"name": "p"}, {"name": "q"}]}},
    {"s": "beta", "n": 0, "d": -2.0, "b": False, "tags": [], "o": {"x": None, "items": []}},
    {"s": None, "n": None, "d": None, "b": None, "tags": None, "o": None},
    {"s": "", "n": 42, "d": 42.0, "b": True, "tags": ["alpha"], "o": {"x": 7, "items": None}},
    {"s": "line\nalpha é", "n": -1, "d": 0.0, "b": False, "tags": ["z", "a"],
     "o": {"x": 5, "items": [{"name": None}]}},
]


def get(document, path):
    value = document
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


KINDS = {"double": float, "string": str, "object": dict, "array": list, "bool": bool, "int": int,
         "null": type(None)}


def operator(op, actual, wanted):
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if actual is None:
            return False
        return {"$gt": actual > wanted, "$gte": actual >= wanted,
                "$lt": actual < wanted, "$lte": actual <= wanted}[op]
    if op == "$regex":
        flags = re.I if isinstance(wanted, dict) and "i" in wanted.get("$options", "") else 0
        pattern = wanted["$regex"] if isinstance(wanted, dict) else wanted
        return actual is not None and bool(re.search(pattern, str(actual), flags))
    if op == "$type":
        exact = type(actual) is KINDS[wanted]
        return exact
    return {"$eq": actual == wanted, "$ne": actual != wanted,
            "$in": isinstance(wanted, list) and actual in wanted,
            "$nin": isinstance(wanted, list) and actual not in wanted,
            "$exists": (actual is not None) == wanted}[op]


def evaluate(document, condition):
    for key, value in condition.items():
        if key == "$and":
            ok = all(evaluate(document, c) for c in value)
        elif key == "$or":
            ok = any(evaluate(document, c) for c in value)
        elif key == "$nor":
            ok = not any(evaluate(document, c) for c in value)
        elif key == "$not":
            ok = not evaluate(document, value)
        elif isinstance(value, dict):
            ok = all(operator(op, get(document, key), wanted) for op, wanted in value.items())
        else:
            ok = get(document, key) == value
        if not ok:
            return False
    return True


CONDITIONS = [
    {}, {"s": "Alpha"}, {"s": None}, {"missing": None}, {"missing": 1}, {"n": 42}, {"d": 42},
    {"n": 42.0}, {"n": "42"}, {"b": True}, {"tags": ["a", "b"]}, {"tags": ["b", "a"]},
    {"tags.0": "a"}, {"tags.9": None}, {"tags.x": None}, {"o.x": {"$gt": 1}},
    {"o.items.1.name": "q"}, {"o.items.0.name": None}, {"o.items.name": {"$exists": False}},
    {"n": {"$gt": 0, "$lt": 42}}, {"d": {"$gte": -2, "$lte": 1.5}}, {"s": {"$lt": "b"}},
    {"n": {"$ne": 5}}, {"s": {"$ne": None}}, {"n": {"$in": [5, 42, None]}}, {"n": {"$in": []}},
    {"n": {"$nin": [5, 42]}}, {"n": {"$nin": [None]}}, {"s": {"$in": ["beta", 5]}},
    {"s": {"$exists": True}}, {"s": {"$exists": False}}, {"missing": {"$exists": False}},
    {"missing": {"$nin": [1]}}, {"missing": {"$in": [None]}}, {"missing": {"$gt": 1}},
    {"s": {"$regex": "^A"}}, {"s": {"$regex": {"$regex": "alpha", "$options": "i"}}},
    {"s": {"$regex": r"\w+ \w$"}}, {"n": {"$regex": "^4"}}, {"s": {"$regex": "^line.alpha"}},
    {"n": {"$type": "int"}}, {"d": {"$type": "double"}}, {"s": {"$type": "null"}},
    {"o": {"$type": "object"}}, {"tags": {"$type": "array"}}, {"b": {"$type": "bool"}},
    {"b": {"$type": "string"}}, {"missing": {"$type": "null"}},
    {"$and": []}, {"$or": []}, {"$nor": []}, {"$not": {}}, {"$not": {"n": {"$gt": 1}}},
    {"$or": [{"n": 5}, {"s": "beta"}], "b": {"$ne": None}},
    {"$nor": [{"n": {"$gt": 3}}, {"s": None}]},
    {"$and": [{"$or": [{"n": 0}, {"n": 5}]}, {"$not": {"b": True}}]},
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, {**{f.name: None for f in SCHEMA.fields}, **d}) for i, d in enumerate(DOCUMENTS)]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("doc", SCHEMA)])
    return spark.createDataFrame(rows, schema)


def test_typed_documents(frame):
    columns = [compile_filter(c, SCHEMA, F.col("doc")).alias(f"c{k}")
               for k, c in enumerate(CONDITIONS)]
    for row in frame.select("i", *columns).collect():
        for k, condition in enumerate(CONDITIONS):
            assert row[f"c{k}"] is evaluate(DOCUMENTS[row["i"]], condition), (
                DOCUMENTS[row["i"]], condition)


def test_schemaless_documents(frame):
    loose = frame.select("i", F.parse_json(
        F.to_json("doc", {"ignoreNullFields": "false"})).alias("doc"))
    usable = [c for c in CONDITIONS if "tags" not in c or isinstance(c["tags"], dict)]
    columns = [compile_filter(c, T.VariantType(), F.col("doc")).alias(f"c{k}")
               for k, c in enumerate(usable)]
    for row in loose.select("i", *columns).collect():
        for k, condition in enumerate(usable):
            assert row[f"c{k}"] is evaluate(DOCUMENTS[row["i"]], condition), (
                DOCUMENTS[row["i"]], condition)


def test_sibling_options_and_time(spark, frame):
    found = frame.where(compile_filter(
        {"s": {"$regex": "^ALPHA", "$options": "i"}}, SCHEMA, F.col("doc")))
    assert [r["i"] for r in found.collect()] == [0]


@pytest.mark.parametrize("condition", [
    {"$where": "1"}, {"n": {"$function": {}}}, {"n": {"$size": 1}}, {"$text": 1}, {"n": {"$gt": "x"}},
    {"o": {"x": 1}}, {"b": {"$regex": "t"}}, {"n": {"$in": 5}}])
def test_refused(frame, condition):
    with pytest.raises(FilterError):
        compile_filter(condition, SCHEMA, F.col("doc"))


def test_lenient(frame):
    column = compile_filter({"n": {"$size": 1}, "$text": 1}, SCHEMA, F.col("doc"), lenient=True)
    assert frame.where(column).count() == len(DOCUMENTS)
