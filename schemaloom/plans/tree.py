"""Walking schemas. Keys are visited in sorted order, keywords in one fixed order, which decides the codec's order."""

from __future__ import annotations

from collections.abc import Callable

from .errors import DepthExceeded
from .pointer import join

# Keywords that hold schemas, in the order in which they are visited.
MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
SINGLES = ("additionalProperties", "unevaluatedProperties", "propertyNames", "unevaluatedItems", "contains", "not", "if", "then", "else", "additionalItems")
LISTS = ("anyOf", "oneOf", "allOf", "prefixItems")
HOLDS = {*MAPS, *SINGLES, *LISTS, "items"}


def ordered(value):
    """The same JSON value with the keys of all objects sorted."""
    if isinstance(value, dict):
        return {k: ordered(value[k]) for k in sorted(value)}
    return [ordered(v) for v in value] if isinstance(value, list) else value


def map_children(node: dict, path: str, change: Callable[[object, str], object]) -> dict:
    """A copy of node in which each schema directly below it is changed."""
    out = dict(node)
    if HOLDS.isdisjoint(node):
        return out
    for word in MAPS:
        if word in node and isinstance(below := node[word], dict):
            out[word] = {k: change(below[k], join(path, word, k)) for k in sorted(below)}
    for word in SINGLES:
        if word in node and isinstance(node[word], dict):
            out[word] = change(node[word], join(path, word))
    for word in LISTS:
        if word in node and isinstance(below := node[word], list):
            out[word] = [change(v, join(path, word, i)) for i, v in enumerate(below)]
    if isinstance(below := node.get("items"), dict):
        out["items"] = change(below, join(path, "items"))
    elif isinstance(below, list):
        out["items"] = [change(v, join(path, "items", i)) for i, v in enumerate(below)]
    return out


class Done:
    """What a rule returns when the schemas below are not to be visited."""

    def __init__(self, node) -> None:
        self.node = node


def rewrite(schema, rule: Callable[[dict, str, int], object], max_depth: int, path: str = "#", depth: int = 0):
    """Apply a rule to every schema, from the root down. A rule gets a copy and returns a schema or Done."""
    if depth > max_depth:
        raise DepthExceeded(f"schema is nested deeper than {max_depth} at {path}", path)
    if not isinstance(schema, dict):
        return schema
    got = rule(dict(schema), path, depth)
    if isinstance(got, Done):
        return got.node
    return map_children(got, path, lambda v, p: rewrite(v, rule, max_depth, p, depth + 1))


def json_type(value) -> str:
    """The type of a JSON value; integers are told apart from other numbers."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(1 << 63) <= value < 1 << 64 else "number"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(value)]
