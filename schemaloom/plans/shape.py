"""Passes that change the shape of data: unions, maps, opaque values, recursion, sealed objects.

Each adds to the codec what is needed to turn data back.
"""

from __future__ import annotations

from .codec import Codec
from .describe import OPAQUE_NOTE, OPAQUE_OBJECT, PARSES, opaque, text_of
from .options import Options
from .pointer import join
from .tree import Done, map_children, ordered, rewrite

KEY, VALUE, EXTRA, RESULT = "key", "value", "_additional", "result"
# Keywords by what they speak of.
REFERENCE_WORDS = ("$anchor", "$dynamicAnchor", "$dynamicRef", "$id", "$schema")
COMPOSITION = {"allOf", "oneOf", "anyOf", "not", "if", "then", "else", "enum", "const", "$ref", "$dynamicRef", "$recursiveRef"}
OF_OBJECTS = {"required", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas", "dependencies", "propertyNames", "unevaluatedProperties"}
OF_ARRAYS = {"items", "prefixItems", "additionalItems", "unevaluatedItems", "contains", "minItems", "maxItems", "uniqueItems", "minContains", "maxContains"}
OF_STRINGS = {"minLength", "maxLength", "pattern", "format", "contentEncoding", "contentMediaType", "contentSchema"}
OF_NUMBERS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
#: What a value that became a string can't keep.
LOST_AS_STRING = OF_OBJECTS | OF_ARRAYS | {"properties", "patternProperties", "additionalProperties", "enum", "const", "not", "if", "then", "else"}


def _filled(node: dict, word: str) -> bool:
    return isinstance(node.get(word), dict) and bool(node[word])


def unions(schema, options: Options):
    """oneOf becomes anyOf. Where both stand, a value must match both."""
    if options.target == "gemini" or options.polymorphism == "flatten":
        return schema

    def walk(node, path: str, depth: int):
        if not isinstance(node, dict) or depth > options.max_depth:
            return node
        node = dict(node)
        if "oneOf" in node:
            one = node.pop("oneOf")
            if "anyOf" in node:
                both = [{"anyOf": one}, {"anyOf": node.pop("anyOf")}]
                node["allOf"] = (node["allOf"] if isinstance(node.get("allOf"), list) else []) + both
            else:
                node["anyOf"] = one
        return map_children(node, path, lambda v, p: walk(v, p, depth + 1))

    return walk(schema, "#", 0)


def _pairs(value) -> dict:
    return {
        "type": "array",
        "items": {"type": "object", "properties": {KEY: {"type": "string"}, VALUE: value}, "required": [KEY, VALUE], "additionalProperties": False},
    }


def maps(schema, options: Options, codec: Codec):
    """Objects with free keys become arrays of pairs, alone or beside their fixed properties."""
    if options.target == "gemini":
        return schema

    def rule(node: dict, path: str, depth: int):
        if node.get("type") != "object" or not isinstance(node.get("additionalProperties"), dict):
            return node
        value = node["additionalProperties"]
        if not _filled(node, "properties"):
            codec.add("map_to_array", path, keyField=KEY)
            pairs = {**_pairs(value), **{k: node[k] for k in ("description", "title") if k in node}}
            return Done(rewrite(pairs, rule, options.max_depth, path, depth + 1))
        name = EXTRA if EXTRA not in node["properties"] else f"{EXTRA}_extra"
        while name in node["properties"]:
            name += "_"
        node |= {"additionalProperties": False, "properties": ordered({**node["properties"], name: _pairs(value)})}
        codec.add("extract_additional_properties", path, propertyName=name)
        codec.add("map_to_array", join(path, "properties", name), keyField=KEY)
        return node

    return rewrite(schema, rule, options.max_depth)


def _anything(node: dict) -> bool:
    """Whether a schema says nothing of what is inside."""
    more = node.get("additionalProperties")
    if node.get("type") == "object":
        if _filled(node, "properties") or _filled(node, "patternProperties") or COMPOSITION & node.keys():
            return False
        return "additionalProperties" not in node or more is True or more == {}
    if "type" in node or {"properties", "patternProperties"} & node.keys() or more is False or _filled(node, "additionalProperties"):
        return False
    return not (COMPOSITION | OF_OBJECTS | OF_ARRAYS | OF_STRINGS | OF_NUMBERS) & node.keys()


def opaques(schema, options: Options, codec: Codec):
    """Values of unknown structure become strings that hold JSON."""

    def rule(node: dict, path: str, depth: int):
        if not _anything(node):
            return node
        out = {k: v for k, v in node.items() if k not in LOST_AS_STRING} | {"type": "string"}
        told = out.get("description")
        out["description"] = told + OPAQUE_NOTE if isinstance(told, str) else OPAQUE_OBJECT
        inner = lambda v: text_of(v) if isinstance(v, (dict, list)) else v
        if "default" in out:
            out["default"] = inner(out["default"])
        if isinstance(out.get("examples"), list):
            out["examples"] = [inner(v) for v in out["examples"]]
        codec.add("json_string_parse", path)
        return Done(out)

    return rewrite(schema, rule, options.max_depth)


def _placeholder(schema) -> str:
    if not isinstance(schema, dict):
        return '\\"...\\"'
    variants = [v for w in ("anyOf", "oneOf") if isinstance(schema.get(w), list) for v in schema[w]]
    if any(isinstance(v, dict) and v.get("type") == "null" for v in variants):
        return "null"
    kind = schema.get("type")
    return {"integer": "0", "number": "0", "boolean": "false", "array": "[]", "object": "{}", "null": "null"}.get(kind if isinstance(kind, str) else "", '\\"...\\"')


def _example(definition, name: str) -> str:
    if definition is None:
        return '{\\"key\\": \\"value\\"}'
    if not isinstance(definition, dict) or not _filled(definition, "properties"):
        return f'{{\\"type\\":\\"{name}\\"}}'
    fields = definition["properties"]
    return "{" + ",".join(f'\\"{k}\\":{_placeholder(fields[k])}' for k in sorted(fields)) + "}"


def _without_reference_words(value):
    if isinstance(value, list):
        return [_without_reference_words(v) for v in value]
    if not isinstance(value, dict):
        return value
    literal = lambda k: k in ("const", "enum", "examples", "default") or k.startswith("x-")
    return {k: v if literal(k) else _without_reference_words(v) for k, v in value.items() if k not in REFERENCE_WORDS}


def _beside(target, siblings: dict):
    """A definition put in place of a reference, with the keywords beside it on top."""
    if not isinstance(target, (dict, bool)):
        return siblings
    out = dict(target) if isinstance(target, dict) else {} if target else {"not": {}}
    for k, v in siblings.items():
        if k == "properties" and isinstance(out.get(k), dict) and isinstance(v, dict):
            out[k] = ordered({**out[k], **v})
        elif k == "required" and isinstance(out.get(k), list) and isinstance(v, list):
            out[k] = out[k] + [r for r in v if r not in out[k]]
        else:
            out[k] = v
    return out


def recursion(schema, options: Options, codec: Codec):
    """References that are left recur: they are put in place a few times, then become strings that hold JSON."""
    if options.target == "gemini" or not isinstance(schema, dict):
        return schema
    definitions = schema.get("$defs") if isinstance(schema.get("$defs"), dict) else {}
    uses: dict[str, int] = {}

    def definition(ref: str):
        return definitions.get(ref.removeprefix("#/$defs/")) if ref.startswith("#/$defs/") else None

    def rule(node: dict, path: str, depth: int):
        ref = node.get("$ref")
        if not isinstance(ref, str):
            if depth == 0:
                node.pop("$defs", None)
            return node
        name, target = ref.rpartition("/")[2], definition(ref)
        if uses.get(ref, 0) >= options.recursion_limit:
            codec.add("recursive_inflate", path, originalRef=ref)
            return Done({
                "type": "string",
                "description": "MUST be a valid JSON object serialized as a string. "
                f"This represents a {name} that was too deeply nested to inline. "
                f'Output a complete JSON object as a string value, e.g. "{_example(target, name)}". '
                "Do NOT output plain text — the value must parse as JSON.",
            })
        if target is None:
            codec.add("json_string_parse", path)
            return Done({
                "type": "string",
                "description": f"MUST be a valid JSON value serialized as a string. This represents a {name} reference that could not be resolved. {PARSES}",
            })
        uses[ref] = uses.get(ref, 0) + 1
        inner = _without_reference_words(rewrite(target, rule, 10_000, path, depth))
        siblings = {k: v for k, v in node.items() if k not in ("$ref", "$defs", *REFERENCE_WORDS)}
        if siblings:
            inner = _beside(inner, rewrite(siblings, rule, 10_000, path, depth))
        uses[ref] -= 1
        return Done(inner)

    out = rewrite(schema, rule, 10_000)

    def refers(value) -> bool:
        if isinstance(value, list):
            return any(map(refers, value))
        return isinstance(value, dict) and ("$ref" in value or any(map(refers, value.values())))

    return out if refers(out) or not isinstance(out, dict) else {k: v for k, v in out.items() if k != "$defs"}


def _nullable(schema) -> bool:
    if not isinstance(schema, dict):
        return False
    null = lambda t: t == "null" or isinstance(t, list) and "null" in t
    variants = schema.get("anyOf") if isinstance(schema.get("anyOf"), list) else []
    return null(schema.get("type")) or any(isinstance(v, dict) and null(v.get("type")) for v in variants)


def seal(node: dict, path: str, codec: Codec) -> None:
    """Make an object exact: all properties required, those that were optional nullable, no others."""
    fields = node.get("properties") if isinstance(node.get("properties"), dict) else {}
    needed = {r for r in node.get("required", []) if isinstance(r, str)} if isinstance(node.get("required"), list) else set()
    out = {}
    for name in sorted(fields):
        out[name] = fields[name]
        if name not in needed:
            if not _nullable(fields[name]):
                out[name] = {"anyOf": [fields[name], {"type": "null"}]}
            codec.add("nullable_optional", join(path, "properties", name), originalRequired=False)
    if isinstance(node.get("properties"), dict):
        node["properties"] = out
    node |= {"required": sorted(fields), "additionalProperties": False}
    node.pop("unevaluatedProperties", None)


def strict(schema, options: Options, codec: Codec):
    if options.mode != "strict":
        return schema

    def rule(node: dict, path: str, depth: int):
        if node.get("type") == "object" or "type" not in node and "properties" in node:
            node["type"] = "object"
            node.setdefault("properties", {})
            seal(node, path, codec)
        return node

    return rewrite(schema, rule, options.max_depth)


def _unreliable(node: dict) -> bool:
    """Tuples, contains and enums that a provider accepts but does not hold to."""
    prefix, items = node.get("prefixItems"), node.get("items")
    if isinstance(prefix, list):
        if items is False:
            return True
        if isinstance(items, dict) and isinstance(kind := items.get("type"), str):
            if any(not isinstance(p, dict) or p.get("type") != kind for p in prefix):
                return True
    values = node.get("enum")
    return "contains" in node or isinstance(values, list) and any(v is None or isinstance(v, dict) for v in values)


def unreliable(schema, options: Options, codec: Codec):
    if not options.strict_target:
        return schema

    def rule(node: dict, path: str, depth: int):
        if not _unreliable(node):
            return node
        codec.add("json_string_parse", path)
        return Done({"type": "string", "description": opaque(node)})

    return rewrite(schema, rule, options.max_depth)
