"""A rehydrator of one document, value by value: what the compiled columns are held against."""

import json
import re

ALONE = {"additionalProperties", "unevaluatedProperties", "unevaluatedItems", "contains", "propertyNames", "not", "if", "then", "else", "prefixItems"}
PAIRS = {"anyOf", "oneOf", "allOf", "$defs", "definitions", "dependentSchemas"}


def visit(box, key, path, act):
    """Call act(box, key) for each value at a schema path, from box[key] on."""
    value = box[key]
    if not path:
        return act(box, key)
    step, rest = path[0], path[1:]
    if step in ALONE:
        visit(box, key, rest, act)
    elif step in PAIRS:
        visit(box, key, rest[1:], act)
    elif step == "patternProperties":
        if isinstance(value, dict):
            for k in list(value):
                if re.search(rest[0], k):
                    visit(value, k, rest[1:], act)
    elif step == "properties":
        if isinstance(value, dict) and rest[0] in value:
            visit(value, rest[0], rest[1:], act)
    elif step == "items":
        if isinstance(value, list):
            for i in range(len(value)):
                visit(value, i, rest, act)
    elif step.isdigit() and isinstance(value, list) and int(step) < len(value):
        visit(value, int(step), rest, act)


def transform(t):
    kind = t["type"]

    def act(box, key):
        value = box[key]
        if kind == "nullable_optional":
            if value is None and not t["originalRequired"] and isinstance(box, dict):
                del box[key]
        elif kind in ("json_string_parse", "recursive_inflate"):
            if isinstance(value, str):
                box[key] = json.loads(value)
        elif kind == "map_to_array":
            if isinstance(value, list) and all(isinstance(e, dict) and isinstance(e.get(t["keyField"]), str) and "value" in e for e in value):
                box[key] = {e[t["keyField"]]: e["value"] for e in value}
        elif kind == "extract_additional_properties":
            if isinstance(value, dict) and isinstance(value.get(t["propertyName"]), dict):
                value.update(value.pop(t["propertyName"]))
        elif kind == "enum_stringify":
            for v in t["originalValues"]:
                if value == (v if isinstance(v, str) else json.dumps(v)) and isinstance(value, str):
                    box[key] = v
                    break
        elif kind == "root_object_wrapper":
            box[key] = value[t["wrapperKey"]]

    return act


def undo(document, codec):
    from schemaloom.plans.pointer import split

    box = {"x": document}
    for t in reversed(codec.transforms):
        visit(box, "x", split(t["path"]), transform(t))
    return box["x"]


def forward(value, schema):
    """What a model would return for a value of the original schema, at random where there is a choice: for round trips."""
    if isinstance(schema, dict) and schema.get("type") == "object" and isinstance(value, dict):
        fields, more = schema.get("properties", {}), schema.get("additionalProperties")
        out = {k: forward(value[k], s) if k in value else None for k, s in fields.items()}
        rest = [{"key": k, "value": forward(v, more)} for k, v in value.items() if k not in fields]
        if isinstance(more, dict):
            return rest if not fields else {**out, "_additional": rest}
        if not fields:
            return json.dumps(value)
        return out
    if isinstance(schema, dict) and schema.get("type") == "array":
        return [forward(v, schema["items"]) for v in value]
    return json.dumps(value) if schema in ({}, {"type": "object"}) else value
