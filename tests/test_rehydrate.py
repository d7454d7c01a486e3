import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from scalar import forward, undo

from schemaloom.operators.rehydrate import rehydrate
from schemaloom.plans.codec import Codec
from schemaloom.plans.convert import convert

STRING, INTEGER = {"type": "string"}, {"type": "integer"}


def obj(required=(), **fields):
    return {"type": "object", "properties": fields, "required": list(required)}


def back(spark, documents, codec, schema=None, **options):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, document string")
    return rehydrate(df, codec, schema or {}, **options).orderBy("i").collect()


SCHEMA = obj(
    ["id"],
    id=INTEGER, any={}, free={"type": "object", "additionalProperties": {"type": "object", "additionalProperties": INTEGER}},
    mixed={**obj(["a"], a=STRING, b=INTEGER), "additionalProperties": STRING}, list={"type": "array", "items": obj(["x"], x=INTEGER, y={})},
)


def random_document(rng):
    key = lambda: rng.choice(["k", "é/~", 'q"', "z", "a b"])
    out = {"id": rng.randrange(-9, 9)}
    if rng.random() < 0.6:
        out["any"] = rng.choice([1, "s", None, [1, {"a": None}], {"b": {"c": [True]}}, "é\n\"", 2.5])
    if rng.random() < 0.6:
        out["free"] = {key(): {key(): rng.randrange(9) for _ in range(rng.randrange(3))} for _ in range(rng.randrange(3))}
    if rng.random() < 0.6:
        out["mixed"] = {"a": "t", **({"b": 3} if rng.random() < 0.5 else {}), **{key(): "v" for _ in range(rng.randrange(3))}}
    if rng.random() < 0.6:
        out["list"] = [{"x": rng.randrange(5), **({"y": rng.choice([None, {"n": 1}])} if rng.random() < 0.5 else {})} for _ in range(rng.randrange(3))]
    return out


def test_round_trips(spark):
    """Documents of the original schema come back as they were, and as the scalar rehydrator gives them."""
    rng = random.Random(4)
    originals = [random_document(rng) for _ in range(60)]
    plan = convert(SCHEMA)
    wires = [forward(d, SCHEMA) for d in originals]
    for row, wire, original in zip(back(spark, map(json.dumps, wires), plan.codec, SCHEMA), wires, originals, strict=True):
        assert json.loads(row.data) == original == undo(json.loads(json.dumps(wire)), plan.codec)
        assert row.data == json.dumps(original, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert row.warnings == [] and row.error is None


def test_maps(spark):
    codec = Codec([{"type": "map_to_array", "path": "#", "keyField": "key"}])
    docs = ['[{"key":"dup","value":1},{"key":"dup","value":2}]', '[{"key":"a","value":1},{"value":2}]', "[]", '"text"', '[{"key":"n","value":null}]']
    assert [r.data for r in back(spark, docs, codec)] == ['{"dup":2}', '[{"key":"a","value":1},{"value":2}]', "{}", '"text"', '{"n":null}']


def test_missing_is_not_null(spark):
    plan = convert(obj(["needed"], needed={"type": ["string", "null"]}, other=STRING))
    assert [r.data for r in back(spark, ['{"needed":null,"other":null}', "{}"], plan.codec, plan.original)] == ['{"needed":null}', "{}"]


def test_errors_and_modes(spark):
    codec = Codec([{"type": "json_string_parse", "path": "#/properties/a"}])
    docs = ['{"a":"{bad"}', "nope", '{"a":"[1]"}', None, '{"a":"1 2"}']
    rows = back(spark, docs, codec)
    assert [r.data for r in rows] == ['{"a":"{bad"}', None, '{"a":[1]}', None, '{"a":"1 2"}']
    assert [r.error and r.error.code for r in rows] == ["rehydration_error", "json_parse_error", None, None, "rehydration_error"]
    assert [r.i for r in back(spark, docs, codec, mode="DROPMALFORMED")] == [2, 3]
    with pytest.raises(PySparkException):
        back(spark, docs, codec, mode="FAILFAST")
    wrapped = Codec([{"type": "root_object_wrapper", "path": "#", "wrapperKey": "result"}])
    assert [(r.data, r.error is None) for r in back(spark, ['{"result":[1],"x":2}', '{"x":1}'], wrapped)] == [("[1]", True), ('{"x":1}', False)]
    assert [r.error is None for r in back(spark, ['{"a":1} rest'], codec)] == [True]
    assert [r.error is None for r in back(spark, ['{"a":1} rest'], codec, lenient=False)] == [False]


@pytest.mark.parametrize(
    "schema, value, want, told",
    [
        (INTEGER, "42", 42, True), (INTEGER, "042", "042", False), (INTEGER, "+5", "+5", False), (INTEGER, " 42 ", " 42 ", False), (INTEGER, "hello", "hello", False),
        ({"type": "number"}, "1.5", 1.5, True), ({"type": "number"}, "NaN", "NaN", False), ({"type": "number"}, "1d", "1d", False), ({"type": "number"}, 3, 3, False),
        ({"type": "boolean"}, "true", True, True), ({"type": "boolean"}, "yes", "yes", False), (STRING, 1.5, "1.5", True), (STRING, True, "true", True),
        ({"type": ["integer", "null"]}, None, None, False), ({"type": ["integer", "string"]}, "7", "7", False), ({"anyOf": [obj(a=INTEGER), STRING]}, {"a": "1"}, {"a": 1}, True),
        ({"type": "array", "prefixItems": [INTEGER], "items": STRING}, ["1", 2], [1, "2"], True),
    ],
)
def test_coercion(spark, schema, value, want, told):
    (row,) = back(spark, [json.dumps({"v": value})], Codec(), obj(v=schema))
    assert json.loads(row.data) == {"v": want} and type(json.loads(row.data)["v"]) is type(want)
    assert bool(row.warnings) == told and all(w.kind.constraint == "type" for w in row.warnings)


def test_constraints(spark):
    def settle(word, bound, value):
        codec = Codec(dropped=[{"path": "#/properties/v", "constraint": word, "value": bound}])
        (row,) = back(spark, [json.dumps({"v": value})], codec)
        return json.loads(row.data)["v"], [w.message for w in row.warnings]

    assert settle("minimum", 18, 15) == (18, ["value 15 below minimum 18; clamped"])
    assert settle("maximum", 150, 151.5) == (150, ["value 151.5 exceeded maximum 150; clamped"])
    assert settle("exclusiveMinimum", 10, 10) == (11, ["value 10 not greater than exclusive minimum 10; clamped"])
    assert settle("exclusiveMaximum", 20, 25) == (19, ["value 25 not less than exclusive maximum 20; clamped"])
    assert settle("maxLength", 3, "toolong") == ("too", ["string length 7 exceeded maxLength 3; truncated"])
    assert settle("maxItems", 1, [1, 2]) == ([1], ["array length 2 exceeded maxItems 1; truncated"])
    assert settle("minLength", 3, "é") == ("é", ["string length 1 is less than minLength 3"])
    assert settle("minItems", 1, []) == ([], ["array length 0 is less than minItems 1"])
    assert settle("pattern", "^a", "b") == ("b", ['value "b" does not match pattern "^a"'])
    assert settle("pattern", "^(?=a)", "b")[1][0].startswith("pattern")
    assert settle("if", {}, 1)[1] == ["constraint 'if' was dropped during compilation and cannot be validated"]
    assert settle("minimum", 18, "text") == ("text", []) and settle("format", "email", "x") == ("x", [])


def test_warnings_say_where_and_coercion_comes_first(spark):
    schema = obj(users={"type": "array", "items": obj(["email"], email={"type": "string", "minLength": 5}, age={"type": "integer", "minimum": 18})})
    plan = convert(schema)
    (row,) = back(spark, ['{"users":[{"email":"a@b.c","age":"7"},{"email":"x","age":20}]}'], plan.codec, schema)
    assert [(w.dataPath, w.kind.constraint) for w in row.warnings] == [("/users/0/age", "type"), ("/users/0/age", "minimum"), ("/users/1/email", "minLength")]


def test_plan_is_narrow_and_has_no_python(spark):
    plan = convert(SCHEMA)
    df = rehydrate(spark.range(3).select(F.lit("{}").alias("document")), plan.codec, SCHEMA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_names_that_clash_are_kept_apart(spark):
    df = spark.createDataFrame([('{"a":1}', 7)], "document string, data int")
    (row,) = rehydrate(df, Codec(), {}, data="out").collect()
    assert (row.data, row.out) == (7, '{"a":1}')
