import json

from pyspark.sql import functions as F

from schemaloom.functions.register import register
from schemaloom.operators import reports, schemas
from schemaloom.operators.generate import TransientError, generate, retrying
from schemaloom.operators.providers import WIRES, Endpoint
from schemaloom.operators.rehydrate import rehydrate
from schemaloom.plans.convert import convert
from schemaloom.sources import files
from schemaloom.streaming.rehydrate import read_stream, rehydrate_stream

SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "maximum": 5}, "m": {"type": "object", "additionalProperties": {"type": "string"}}}, "required": ["n", "m"]}
DOCUMENTS = ['{"n":"3","m":[{"key":"a","value":"b"}]}', '{"n":9,"m":[]}']


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text(json.dumps(SCHEMA, indent=1))
    (tmp_path / "s" / "two.json").write_text("{")
    found = files.read_schemas(spark, str(tmp_path / "s"))
    rows = {r.name: r for r in schemas.converted(found).collect()}
    assert json.loads(rows["one"].codec)["transforms"][0]["type"] == "map_to_array" and json.loads(rows["two"].error)["code"] == "json_parse_error"
    assert files.read_schema(spark, str(tmp_path / "s" / "one.json")) == SCHEMA
    (tmp_path / "codec.json").write_text(json.dumps(convert(SCHEMA).codec.as_dict()))
    assert files.read_codec(spark, str(tmp_path / "codec.json")).transforms == convert(SCHEMA).codec.transforms
    files.write_components(schemas.converted_components(found.filter("name = 'one'")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    files.write_json(found.filter("name = 'one'"), str(tmp_path / "json"), "schema")
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect())) == SCHEMA
    (tmp_path / "report.json").write_text(json.dumps({"detailed_results": [{"file": "a.json", "verdict": "solid_pass", "attempts": [{"passed": True, "stage": None}]}]}, indent=1))
    assert [tuple(r) for r in reports.verdicts(files.read_report(spark, str(tmp_path / "report.json"))).collect()] == [("a", "solid_pass")]
    (tmp_path / "manifest.json").write_text(json.dumps({"components": [{"name": "A", "pointer": "#/$defs/A", "dependencyCount": 2}]}))
    assert [(r.name, r.dependencyCount) for r in files.read_manifest(spark, str(tmp_path / "manifest.json")).collect()] == [("A", 2)]
    folder = spark.range(1).select(files.pointer_folder(F.lit("#/../a//./b")).alias("x")).first().x
    assert folder == "a/b"


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, d in enumerate(DOCUMENTS):
        (tmp_path / "in" / f"{i}.txt").write_text(d + "\n")
    plan = convert(SCHEMA)
    stream = rehydrate_stream(read_stream(spark, str(tmp_path / "in"), 1), plan.codec, SCHEMA)
    done = stream.writeStream.format("memory").queryName("rehydrated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination()
    batch = rehydrate(files.read_lines(spark, str(tmp_path / "in")), plan.codec, SCHEMA)
    columns = ["document", "data", "warnings"]
    assert sorted(spark.table("rehydrated").select(columns).collect()) == sorted(batch.select(columns).collect())


def test_generate_with_a_transport_that_fails_at_first(spark):
    def transport():
        calls = []

        def send(request):
            calls.append(request)
            body = json.loads(request["body"])
            assert request["headers"]["Content-Type"] == "application/json" and request["url"] == "https://example.org"
            prompt = body["messages"][0]["content"]
            if prompt == "broken":
                calls.pop()
                raise RuntimeError("the line is down")
            if prompt == "never" or len(calls) % 2:
                raise TransientError
            return json.dumps({"choices": [{"message": {"content": DOCUMENTS[0] if prompt == "zero" else DOCUMENTS[1]}}]})

        return retrying(send, 3, 0, sleep=lambda s: None)

    df = spark.createDataFrame([("zero",), ("broken",), ("one",), ("never",)], "prompt string").coalesce(1)
    got = {r.prompt: r for r in generate(df, SCHEMA, WIRES["chat"], Endpoint("https://example.org", "m"), transport).collect()}
    assert got["zero"].data == '{"m":{"a":"b"},"n":3}' and got["zero"].validation_errors == [] and len(got["zero"].warnings) == 1
    assert got["one"].data == '{"m":{},"n":5}' and got["never"].data is None and got["never"].raw_response is None
    assert (got["broken"].error.code, got["broken"].error.message) == ("transport_error", "RuntimeError: the line is down") and got["one"].error is None
    assert got["never"].error.code == "transport_error" and got["broken"].data is None


def test_component_files_and_their_manifest(spark, tmp_path):
    schema = {"title": "All", "type": "object", "properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"type": "string"}, "B/C": {"type": "integer"}}}
    parts = schemas.converted_components(spark.createDataFrame([("all", json.dumps(schema))], "name string, schema string"))
    files.write_component_files(parts, str(tmp_path / "out"), "All")
    found = {r.pointer: r for r in files.read_manifest(spark, str(tmp_path / "out" / "manifest")).collect()}
    assert set(found) == {"#", "#/$defs/A", "#/$defs/B~1C"}
    for r in found.values():
        for path in (r.schemaPath, r.codecPath, r.originalPath):
            assert json.loads(spark.read.text(str(tmp_path / "out" / path)).first().value) is not None
    assert json.loads(spark.read.text(str(tmp_path / "out" / found["#/$defs/A"].originalPath)).first().value)["type"] == "string"


def test_sql_functions(spark):
    assert "convert_schema" in register(spark)
    row = spark.sql("""SELECT convert_schema('{"type":"array","items":{"type":"string"}}', '{"target":"openai-strict"}') AS c, list_components('{"$defs":{"A":{}}}') AS l,
      patch_schema('{"a":1}', '[{"op":"replace","path":"/a","value":2}]') AS p, size(strict_violations('{"type":"object"}')) AS v, convert_schema('{', NULL) AS e""").first()
    assert json.loads(row.c)["codec"]["transforms"][0]["type"] == "root_object_wrapper" and row.l == ["#/$defs/A"] and row.p == '{"a":2}' and row.v == 1
    assert json.loads(row.e)["error"]["code"] == "json_parse_error"


def test_responses_that_hold_nothing(spark):
    cases = {
        "chat": ["{}", '{"choices":[]}', '{"choices":[{"message":null}]}', '{"choices":[{"message":{"content":1}}]}', "x"],
        "messages": ['{"content":[]}', '{"content":[{"type":"text"}]}'],
        "generate": ['{"candidates":[{"finishReason":"SAFETY"}]}', '{"candidates":[{"content":{"parts":[]}}]}'],
        "responses": ['{"output":[{"type":"message","content":[{"type":"output_text","text":""}]}]}'],
    }
    for name, raws in cases.items():
        df = spark.createDataFrame([(r,) for r in raws], "raw string").select(WIRES[name].extract(F.col("raw")).alias("x"))
        for r in df.collect():
            assert r.x.content is None and r.x.error
