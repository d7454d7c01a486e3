"""From any JSON Schema to one that a provider takes, a codec to turn data back, and diagnostics. No Spark job runs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from . import limits, shape
from .codec import Codec
from .errors import JsonParseError
from .merge import merge_all_of
from .normalize import normalize
from .options import Options
from .provider import fit_provider
from .tree import ordered


@dataclass
class Plan:
    schema: object
    codec: Codec
    errors: list[dict]
    original: object

    def as_dict(self) -> dict:
        return {"schema": self.schema, "codec": self.codec.as_dict(), "providerCompatErrors": self.errors}


def parsed(schema):
    if not isinstance(schema, str):
        return schema
    try:
        return json.loads(schema)
    except ValueError as e:
        raise JsonParseError(f"the schema is not JSON: {e}") from None


def convert(schema, options: dict | Options | None = None) -> Plan:
    """The passes in their order: tuples are judged before, constraints dropped after, objects are sealed."""
    options, codec, original = Options.of(options), Codec(), parsed(schema)
    node, _ = normalize(original, options)
    node = merge_all_of(node, options, codec)
    node = shape.unions(node, options)
    node = shape.maps(node, options, codec)
    node = shape.opaques(node, options, codec)
    node = shape.recursion(node, options, codec)
    node = shape.strict(node, options, codec)
    node = shape.unreliable(node, options, codec)
    node = limits.prune(node, options, codec)
    node, errors = fit_provider(node, options, codec)
    return Plan(ordered(node), codec, errors, original)
