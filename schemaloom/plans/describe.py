"""Texts that tell a model what the JSON inside a string must look like."""

from __future__ import annotations

import json

# The texts, and how much of a schema they tell.
PARSES = "Do NOT output plain text — the value must parse with JSON.parse()."
OPAQUE_OBJECT = f'MUST be a valid JSON object serialized as a string, e.g. "{{\\"key\\": \\"value\\"}}". {PARSES}'
OPAQUE_ARRAY = f'MUST be a valid JSON array serialized as a string, e.g. "[1, 2, 3]". {PARSES}'
OPAQUE_NOTE = f"\n\n(Note: This field MUST be a valid JSON object serialized as a string. {PARSES})"
DEEPEST, MOST_FIELDS, MOST_VALUES = 10, 30, 10


def text_of(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def structure(schema, depth: int = 0) -> str:
    """A short picture of a schema: {name: string, tags: [string]}."""
    if depth > DEEPEST:
        return "..."
    if not isinstance(schema, dict):
        return "any"
    if isinstance(values := schema.get("enum"), list) and values:
        return f"One of: [{', '.join(map(text_of, values))}]" if len(values) <= MOST_VALUES else f"One of {len(values)} allowed values"
    kind = schema.get("type") if isinstance(schema.get("type"), str) else "any"
    if kind == "object" and isinstance(fields := schema.get("properties"), dict):
        shown = [f"{k}: {structure(fields[k], depth + 1)}" for k in sorted(fields)[:MOST_FIELDS]]
        return "{" + ", ".join(shown) + (", ..." if len(fields) > MOST_FIELDS else "") + "}"
    if kind == "array":
        return _array(schema, depth + 1)
    return kind


def _array(schema: dict, depth: int) -> str:
    items, prefix = schema.get("items"), schema.get("prefixItems")
    if "prefixItems" not in schema and isinstance(items, dict):
        return f"[{structure(items, depth)}]"
    first = prefix if isinstance(prefix, list) else items if isinstance(items, list) else []
    parts = [structure(v, depth) for v in first[:MOST_VALUES]]
    if isinstance(items, dict):
        parts.append("..." + structure(items, depth))
    elif items is True or "items" not in schema:
        parts.append("...any" if parts else "any")
    return f"[{', '.join(parts)}]" + (" (fixed length)" if items is False else "")


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def rules(schema: dict) -> str:
    """Sentences for constraints that a picture doesn't show."""
    out = []
    if "contains" in schema:
        inner = schema["contains"] if isinstance(schema["contains"], dict) else {}
        if "const" in inner:
            out.append(f"array must include {text_of(inner['const'])} as an element")
        elif isinstance(inner.get("type"), str):
            out.append(f"array must include at least one element of type {inner['type']}")
        else:
            out.append("array must include at least one matching element")
    for word, least, text in (("minContains", 2, "minimum {} matching item(s)"), ("maxContains", 0, "maximum {} matching item(s)"), ("minItems", 0, "minimum {} item(s)"), ("maxItems", 0, "maximum {} item(s)")):
        if _whole(n := schema.get(word)) and n >= least:
            out.append(text.format(n))
    if schema.get("uniqueItems") is True:
        out.append("items must be unique")
    if isinstance(patterns := schema.get("patternProperties"), dict) and patterns:
        out.append(f"includes properties matching pattern(s) [{', '.join(sorted(patterns))}]")
    return ". ".join(out) + "." if out else ""


def opaque(schema) -> str:
    more = rules(schema) if isinstance(schema, dict) else ""
    return f"MUST be a valid JSON value serialized as a string. Structure: {structure(schema)}. " + (f"{more} " if more else "") + PARSES
