"""What a strict provider would refuse in a schema, as rows (path, rule_id, message)."""

from __future__ import annotations

from .pointer import join
from .provider import DEPTH_BUDGET, Provider
from .tree import LISTS, MAPS, SINGLES

# Keywords that are refused wherever they stand, with their rules.
BANNED = {
    "patternProperties": "banned_pattern_properties", "$anchor": "banned_anchor", "$dynamicRef": "banned_dynamic_ref", "$dynamicAnchor": "banned_dynamic_anchor",
    "dependentSchemas": "banned_dependent_schemas", "dependentRequired": "banned_dependent_required", "unevaluatedProperties": "banned_unevaluated_properties",
    "unevaluatedItems": "banned_unevaluated_items", "contains": "banned_contains", "minContains": "banned_min_contains", "maxContains": "banned_max_contains",
    "if": "banned_if", "then": "banned_then", "else": "banned_else", "not": "banned_not",
}
DATA = {"properties", "patternProperties", "additionalProperties", "items", "prefixItems"}
RULES = ("root_not_object", "missing_type", "missing_additional_properties", "missing_items", *BANNED.values(), "banned_schema_ref", "depth_exceeded")


def violations(schema) -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    if isinstance(schema, dict) and schema.get("type") != "object":
        kind = schema.get("type")
        out.append(("#", "root_not_object", f"Root schema must be type 'object', found '{kind if isinstance(kind, str) else 'none'}'"))
    _visit(schema, "#", 0, out)
    return out


def _visit(node, path: str, depth: int, out: list) -> None:
    if not isinstance(node, dict):
        return
    if depth >= DEPTH_BUDGET and path != "#" and not Provider._simple(node):
        out.append((path, "depth_exceeded", f"Semantic depth {depth} reaches limit {DEPTH_BUDGET} at '{path}'"))
        return
    out += [(path, rule, f"Banned keyword '{word}' found at '{path}'") for word, rule in BANNED.items() if word in node]
    if "$ref" in node:
        out.append((path, "banned_schema_ref", f"Schema-level '$ref' found at '{path}'"))
    if node and not node.keys() & {"type", "anyOf", "oneOf", "allOf", "enum", "const"}:
        out.append((path, "missing_type", f"Schema node at '{path}' is missing 'type'"))
    if node.get("type") == "object" and node.get("additionalProperties") is not False:
        out.append((path, "missing_additional_properties", f"Object at '{path}' is missing 'additionalProperties: false'"))
    if node.get("type") == "array" and not node.keys() & {"items", "prefixItems"}:
        out.append((path, "missing_items", f"Array at '{path}' is missing 'items' keyword"))
    for word in (*MAPS, *SINGLES, *LISTS, "items"):
        below = node.get(word)
        if isinstance(below, dict):
            each = [((word, k), below[k]) for k in sorted(below)] if word in MAPS else [((word,), below)] if word not in LISTS else []
        elif isinstance(below, list) and (word in LISTS or word == "items"):
            each = [((word, i), v) for i, v in enumerate(below)]
        else:
            each = []
        for steps, child in each:
            _visit(child, join(path, *steps), depth + (word in DATA), out)
