"""The codec: the reversible rewrites of a schema, in the order made, and the constraints it lost."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from .errors import CodecVersionMismatch
from .pointer import split

VERSION = "urn:schemaloom:codec/v1"
#: Kinds of transform and the fields that each has beside its path.
KINDS = {
    "map_to_array": ("keyField",),
    "json_string_parse": (),
    "nullable_optional": ("originalRequired",),
    "discriminator_any_of": ("discriminator", "variants"),
    "extract_additional_properties": ("propertyName",),
    "recursive_inflate": ("originalRef",),
    "root_object_wrapper": ("wrapperKey",),
    "enum_stringify": ("originalValues",),
}

#: Row shapes of a codec, as DDL. Values of any JSON type are JSON text.
TRANSFORM = (
    "struct<type string, path string, keyField string, originalRequired boolean, discriminator string, variants array<string>, propertyName string, "
    "originalRef string, wrapperKey string, originalValues array<string>>"
)
CODEC = f"schema string, transforms array<{TRANSFORM}>, droppedConstraints array<struct<path string, constraint string, value string>>"


@dataclass
class Codec:
    transforms: list[dict] = field(default_factory=list)
    dropped: list[dict] = field(default_factory=list)
    version: str = VERSION

    def add(self, kind: str, path: str, **more) -> None:
        assert set(more) == set(KINDS[kind]), kind
        self.transforms.append({"type": kind, "path": path, **more})

    def drop(self, path: str, constraint: str, value) -> None:
        self.dropped.append({"path": path, "constraint": constraint, "value": value})

    def as_dict(self) -> dict:
        return {"$schema": self.version, "transforms": self.transforms, "droppedConstraints": self.dropped}

    def as_row(self) -> dict:
        """As CODEC: values of any JSON type are JSON text there."""
        text = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)
        rows = [{**t, **({"originalValues": [text(v) for v in t["originalValues"]]} if "originalValues" in t else {})} for t in self.transforms]
        return {"schema": self.version, "transforms": rows, "droppedConstraints": [{**d, "value": text(d["value"])} for d in self.dropped]}

    @classmethod
    def of(cls, given: dict | str | Codec) -> Codec:
        if isinstance(given, Codec):
            return given
        data = json.loads(given) if isinstance(given, str) else given
        out = cls(list(data.get("transforms", [])), list(data.get("droppedConstraints", [])), data.get("$schema", VERSION))
        out.check_version()
        return out

    def check_version(self) -> None:
        if not re.fullmatch(r"v1(\..*)?", self.version.rstrip("/").rpartition("/")[2]):
            raise CodecVersionMismatch(f"codec version {self.version} is not v1")


def expanded(codec: Codec) -> list[dict]:
    """Transforms in the order made, with those inside recursive definitions repeated where these are inflated.

    A parse recorded below a definition holds at each level of recursion of every place where it was cut off; the
    path to such a place repeats itself, and each repeat of its shortest period is a level. The added ones run last,
    so they stand first.
    """
    inside: dict[str, list[list[str]]] = {}
    for t in codec.transforms:
        s = split(t["path"])
        if t["type"] == "json_string_parse" and len(s) > 2 and s[0] == "$defs":
            inside.setdefault(s[1], []).append(s[2:])
    added: list[tuple[str, ...]] = []
    for t in codec.transforms:
        if t["type"] != "recursive_inflate":
            continue
        ref, site = split(t["originalRef"]), split(t["path"])
        if len(ref) < 2 or ref[0] != "$defs" or not site:
            continue
        n = len(site)
        period = next(p for p in range(1, n + 1) if n % p == 0 and site == site[:p] * (n // p))
        for tail in inside.get(ref[1], []):
            added += [tuple(site[:level] + tail) for level in range(period, n + 1, period)]
    unique = list(dict.fromkeys(added))
    return [{"type": "json_string_parse", "segments": list(s)} for s in reversed(unique)] + codec.transforms
