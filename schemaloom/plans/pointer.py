"""Pointers into schemas ("#/properties/a~1b") and documents ("/a~1b/0")."""

from __future__ import annotations


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1") if "~" in segment or "/" in segment else segment


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def join(parent: str, *segments: str | int) -> str:
    return "/".join([parent, *[escape(str(s)) for s in segments]])


def split(path: str) -> list[str]:
    """Segments of a pointer. "#" and "" mean the whole; empty segments after the first slash count."""
    rest = path.removeprefix("#")
    if not rest:
        return []
    return [unescape(s) for s in rest.removeprefix("/").split("/")]


def resolve(root, path: str):
    """The value at a pointer; LookupError if there is none."""
    node = root
    for segment in split(path):
        if isinstance(node, dict):
            node = node[segment]
        elif isinstance(node, list) and segment.isdigit():
            node = node[int(segment)]
        else:
            raise LookupError(path)
    return node
