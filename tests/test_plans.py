import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.catalogue import SAMPLES
from schemaloom.plans import audit, components, patch, pointer
from schemaloom.plans.codec import Codec
from schemaloom.plans.convert import convert
from schemaloom.plans.errors import CodecVersionMismatch, JsonParseError, PlanError, SchemaError, UnresolvableRef
from schemaloom.plans.options import Options
from schemaloom.plans.validator import violations

STRING = {"type": "string"}


@given(st.lists(st.text(max_size=8), max_size=5))
def test_pointers_split_into_what_they_were_joined_from(parts):
    assert pointer.split(pointer.join("#", *parts)) == parts


@given(st.text())
def test_escaping_is_undone(s):
    assert pointer.unescape(pointer.escape(s)) == s


json_values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("abc", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["type", "properties", "items", "anyOf", "enum", "additionalProperties", "allOf", "$ref", "a", "object"]), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_odd_schemas_give_a_plan_or_a_plan_error(schema):
    try:
        convert(schema)
    except PlanError:
        pass


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("target", ["openai-strict", "gemini", "claude"])
def test_conversion_is_stable(name, target):
    once = convert(SAMPLES[name], {"target": target})
    again = convert(json.dumps(SAMPLES[name]), {"target": target})
    assert once.as_dict() == again.as_dict()
    if target == "openai-strict":
        assert audit.violations(once.schema) == []
        assert convert(once.schema).schema == once.schema


def kinds(schema, **options):
    return [t["type"] for t in convert(schema, options).codec.transforms]


def obj(**fields):
    return {"type": "object", "properties": fields, "required": list(fields)}


@pytest.mark.parametrize(
    "schema, want",
    [
        (obj(a=STRING), []),
        ({"type": "object", "properties": {"a": STRING}}, ["nullable_optional"]),
        (obj(a={"type": "object", "additionalProperties": STRING}), ["map_to_array"]),
        ({**obj(a=STRING), "additionalProperties": STRING}, ["extract_additional_properties", "map_to_array", "nullable_optional"]),
        (obj(a={}), ["json_string_parse"]),
        (obj(a={"enum": ["x", 1]}), ["enum_stringify"]),
        (obj(a={"enum": [None, 1]}), ["json_string_parse"]),
        (STRING, ["root_object_wrapper"]),
        (obj(a=True), ["json_string_parse"]),
        (obj(a={"type": "array", "items": STRING, "contains": {"const": 1}}), ["json_string_parse"]),
    ],
)
def test_transforms(schema, want):
    assert kinds(schema) == want


def test_bounds_are_dropped_recorded_and_told():
    plan = convert(obj(n={"type": "integer", "minimum": 0, "maximum": 5, "description": "A number"}))
    assert plan.schema["properties"]["n"] == {"type": "integer", "description": "A number. Constraints: minimum value: 0; maximum value: 5."}
    assert [(d["path"], d["constraint"], d["value"]) for d in plan.codec.dropped] == [("#/properties/n", "minimum", 0), ("#/properties/n", "maximum", 5)]
    assert not convert(obj(n={"type": "integer", "minimum": 0}), {"target": "gemini"}).codec.dropped


def test_all_of_is_an_intersection():
    schema = obj(n={"allOf": [{"type": "number", "minimum": 1}, {"type": "integer", "minimum": 3, "maximum": 9}], "maximum": 7})
    got = convert(schema, {"target": "gemini"}).schema["properties"]["n"]
    assert got == {"type": "integer", "minimum": 3, "maximum": 7}
    with pytest.raises(SchemaError):
        convert(obj(n={"allOf": [STRING, {"type": "integer"}]}))


def test_deep_schemas_are_cut():
    schema = STRING
    for _ in range(8):
        schema = obj(a=schema)
    plan = convert(schema)
    assert [t["path"].count("properties") for t in plan.codec.transforms] == [5]
    assert [e["type"] for e in plan.errors] == ["depth_budget_exceeded"]


def test_references():
    with pytest.raises(UnresolvableRef):
        convert(obj(a={"$ref": "#/$defs/none"}))
    assert kinds(obj(a={"$ref": "https://example.org/x.json"})) == ["json_string_parse"]
    anchored = {**obj(a={"$ref": "#here"}), "$defs": {"x": {"$anchor": "here", "type": "string"}}}
    assert convert(anchored).schema["properties"]["a"] == STRING
    with pytest.raises(JsonParseError):
        convert("{")


def test_options_take_any_case():
    assert Options.of({"max-depth": 3, "recursionLimit": 1, "skip_components": True}) == Options(max_depth=3, recursion_limit=1, skip_components=True)
    with pytest.raises(ValueError):
        Options.of({"target": "none"})


def test_codec_versions():
    assert Codec.of({"$schema": "https://example.org/codec/v1.3", "transforms": []}).transforms == []
    with pytest.raises(CodecVersionMismatch):
        Codec.of({"$schema": "https://example.org/codec/v2", "transforms": []})


def test_components():
    schema = {"$defs": {"A": obj(b={"$ref": "#/$defs/B"}), "B": obj(c={"$ref": "#/$defs/C"}), "C": STRING, "D": obj(x={"$ref": "#/$defs/none"})}, "type": "object"}
    assert components.list_components(schema) == [f"#/$defs/{n}" for n in "ABCD"]
    got = components.extract_component(schema, "#/$defs/A")
    assert (got.dependency_count, sorted(got.schema["$defs"])) == (2, ["B", "C"])
    assert components.extract_component(schema, "#/$defs/D").missing_refs == ["#/$defs/none"]
    with pytest.raises(PlanError):
        components.extract_component(schema, "#/$defs/A", max_depth=1)
    _, each = components.convert_all({**schema, "$defs": {k: v for k, v in schema["$defs"].items() if k != "D"}})
    assert [c.error for c in each] == [None] * 3


def test_audit_rules():
    found = {r for _, r, _ in audit.violations({"type": "array", "if": {}, "not": {"type": "object"}, "anyOf": [{"$ref": "#"}, {"title": "x"}]})}
    assert found == {"root_not_object", "missing_items", "banned_if", "banned_not", "banned_schema_ref", "missing_additional_properties", "missing_type"}


def test_patch():
    steps = [{"op": "add", "path": "/a/-", "value": 3}, {"op": "move", "from": "/b", "path": "/c"}, {"op": "replace", "path": "/a/0", "value": 9}, {"op": "test", "path": "/c", "value": 1}, {"op": "copy", "from": "/c", "path": "/d"}, {"op": "remove", "path": "/c"}]
    before = {"a": [1, 2], "b": 1}
    assert patch.apply_patch(before, steps) == {"a": [9, 2, 3], "d": 1} and before == {"a": [1, 2], "b": 1}
    with pytest.raises(SchemaError):
        patch.apply_patch({}, [{"op": "remove", "path": "/x"}])


def test_validator():
    schema = obj(n={"type": "integer", "minimum": 2}, s={"type": "array", "items": STRING, "uniqueItems": True})
    assert violations({"n": 2, "s": ["a"]}, schema) == []
    assert {p for p, _ in violations({"n": 1, "s": ["a", "a", 1]}, schema)} == {"/n", "/s", "/s/2"}
