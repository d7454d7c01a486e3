"""Keywords that a provider does not take are dropped, recorded, and told in the description where they can be."""

from __future__ import annotations

from .codec import Codec
from .describe import text_of
from .options import Options
from .tree import rewrite

# Keywords dropped for every provider, and beyond those, in the order in which they are recorded.
ALWAYS = (
    "uniqueItems", "default", "not", "if", "then", "else", "multipleOf", "minProperties", "maxProperties", "propertyNames",
    "dependencies", "dependentRequired", "dependentSchemas", "contains", "minContains", "maxContains", "format",
)
BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems")
MORE = {"openai-strict": BOUNDS, "claude": (*BOUNDS, "pattern"), "gemini": ()}
# How a dropped keyword reads in a description; {} is its value.
ANY_VALUE = {"minimum": "minimum value: {}", "maximum": "maximum value: {}", "exclusiveMinimum": "value must be > {}", "exclusiveMaximum": "value must be < {}", "multipleOf": "must be a multiple of {}"}
COUNTS = {"minLength": "minimum length: {} character(s)", "maxLength": "maximum length: {} character(s)", "minItems": "minimum {} item(s)", "maxItems": "maximum {} item(s)"}
STRINGS = {"format": "format: {}", "pattern": "must match pattern: {}"}


def hint(word: str, value) -> str | None:
    if word in ANY_VALUE:
        return ANY_VALUE[word].format(text_of(value))
    if word in COUNTS and isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return COUNTS[word].format(value)
    if word in STRINGS and isinstance(value, str):
        return STRINGS[word].format(value)
    return "items must be unique" if word == "uniqueItems" and value is True else None


def prune(schema, options: Options, codec: Codec):
    def rule(node: dict, path: str, depth: int):
        if options.target != "gemini" and "const" in node:
            codec.drop(path, "const", node["const"])
            node["enum"] = [node.pop("const")]
        if "default" in node and isinstance(node.get("enum"), list) and node["default"] in node["enum"]:
            first = node["enum"].index(node["default"])
            node["enum"] = [node["enum"][first], *node["enum"][:first], *node["enum"][first + 1 :]]
        told = []
        for word in (*ALWAYS, *MORE[options.target]):
            if word in node:
                value = node.pop(word)
                codec.drop(path, word, value)
                told.append(hint(word, value))
        if told := [t for t in told if t]:
            text = f"Constraints: {'; '.join(told)}."
            old = node.get("description")
            node["description"] = f"{old}{'' if old.endswith(('.', ' ')) else '.'} {text}" if isinstance(old, str) else text
        return node

    return rewrite(schema, rule, options.max_depth)
