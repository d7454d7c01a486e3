"""Second pass: allOf becomes one schema, the intersection of its members."""

from __future__ import annotations

import math

from .codec import Codec
from .errors import DepthExceeded, SchemaError
from .options import Options
from .pointer import join
from .tree import map_children, ordered

LOWER = {"minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties"}
UPPER = {"maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties"}
CONDITIONS = ("if", "then", "else")


def _number(value) -> float:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else math.nan


def _types(value) -> list[str]:
    return [value] if isinstance(value, str) else [t for t in value if isinstance(t, str)] if isinstance(value, list) else []


def _meet_types(a, b, path: str):
    """Types that both allow. Every integer is a number."""
    left, right = _types(a), _types(b)
    out = []
    for t in left:
        if t in right:
            out.append(t)
        elif t == "number" and "integer" in right or t == "integer" and "number" in right:
            out.append("integer")
    out = list(dict.fromkeys(out))
    if not out:
        raise SchemaError(f"allOf has no type in common: {a!r} and {b!r}", path)
    return out[0] if len(out) == 1 else out


def _meet_additional(a, b, path: str, codec: Codec):
    """The stricter of two: false, then a schema, then true."""
    if a is False or b is False:
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return meet(a, b, join(path, "additionalProperties"), codec)
    return a if isinstance(a, dict) else b


def meet(a, b, path: str, codec: Codec):
    """A schema for what both a and b accept, as far as keywords can say it; else b's keyword stands."""
    if a is False or b is False:
        return False
    if not isinstance(a, dict):
        return b
    if not isinstance(b, dict):
        return a
    out = dict(a)
    for word in sorted(b):
        new = b[word]
        if word in CONDITIONS:
            codec.drop(path, word, new)
            continue
        if word not in out:
            out[word] = new
            continue
        old = out[word]
        if word == "properties" and isinstance(old, dict) and isinstance(new, dict):
            both = {k: meet(old[k], v, join(path, "properties", k), codec) if k in old else v for k, v in new.items()}
            out[word] = ordered({**old, **both})
        elif word == "required" and isinstance(old, list) and isinstance(new, list):
            out[word] = old + [v for i, v in enumerate(new) if v not in old and v not in new[:i]]
        elif word == "type":
            out[word] = _meet_types(old, new, path)
        elif word == "const" and old != new:
            raise SchemaError(f"allOf has two constants: {old!r} and {new!r}", path)
        elif word == "description" and isinstance(old, str) and isinstance(new, str):
            out[word] = f"{old}\n{new}"
        elif word == "enum" and isinstance(old, list) and isinstance(new, list):
            out[word] = [v for v in old if v in new]
        elif word in LOWER and _number(old) >= _number(new) or word in UPPER and _number(old) <= _number(new):
            pass
        elif word == "additionalProperties":
            out[word] = _meet_additional(old, new, path, codec)
        elif word == "items" and isinstance(old, dict) and isinstance(new, dict):
            out[word] = meet(old, new, join(path, "items"), codec)
        else:
            out[word] = new
    for word in CONDITIONS:
        if word in out:
            codec.drop(path, word, out.pop(word))
    return out


def merge_all_of(schema, options: Options, codec: Codec, path: str = "#", depth: int = 0):
    if depth > options.max_depth:
        raise DepthExceeded(f"schema is nested deeper than {options.max_depth} at {path}", path)
    if not isinstance(schema, dict):
        return schema
    if not isinstance(schema.get("allOf"), list):
        return map_children(schema, path, lambda v, p: merge_all_of(v, options, codec, p, depth + 1))
    out = merge_all_of({k: v for k, v in schema.items() if k != "allOf"}, options, codec, path, depth)
    members = [merge_all_of(v, options, codec, join(path, "allOf", i), depth + 1) for i, v in enumerate(schema["allOf"])]
    for member in members:
        out = meet(out, member, path, codec)
    return out
