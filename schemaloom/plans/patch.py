"""JSON Patch: the six operations, on a copy."""

from __future__ import annotations

import copy

from .errors import SchemaError
from .pointer import resolve, split, unescape


def _parent(root, path: str):
    parts = [unescape(s) for s in path.split("/")[1:]]
    if not parts:
        raise SchemaError("the whole document has no parent", path)
    node = root
    for s in parts[:-1]:
        try:
            node = node[int(s)] if isinstance(node, list) else node[s]
        except (LookupError, ValueError, TypeError):
            raise SchemaError(f"there is nothing at {path}", path) from None
    return node, parts[-1]


def _index(node: list, key: str, end: bool) -> int:
    if end and key == "-":
        return len(node)
    if not key.isdigit() or str(int(key)) != key or int(key) > len(node) - (not end):
        raise SchemaError(f"no index {key}", key)
    return int(key)


def _add(root, path: str, value):
    if path == "":
        return value
    node, key = _parent(root, path)
    if isinstance(node, list):
        node.insert(_index(node, key, True), value)
    elif isinstance(node, dict):
        node[key] = value
    else:
        raise SchemaError(f"{path} is inside a scalar", path)
    return root


def _remove(root, path: str):
    node, key = _parent(root, path)
    if isinstance(node, list):
        return node.pop(_index(node, key, False))
    if not isinstance(node, dict) or key not in node:
        raise SchemaError(f"there is nothing at {path}", path)
    return node.pop(key)


def _at(root, path: str):
    try:
        return resolve(root, path) if split(path) else root
    except (LookupError, IndexError):
        raise SchemaError(f"there is nothing at {path}", path) from None


def apply_patch(document, operations: list[dict]):
    root = copy.deepcopy(document)
    for step in operations:
        kind, path = step.get("op"), step.get("path", "")
        if kind == "add":
            root = _add(root, path, copy.deepcopy(step["value"]))
        elif kind == "remove":
            _remove(root, path)
        elif kind == "replace":
            if path:
                _remove(root, path)
            root = _add(root, path, copy.deepcopy(step["value"]))
        elif kind == "move":
            if path.startswith(step["from"] + "/"):
                raise SchemaError("a value can't move into itself", path)
            root = _add(root, path, _remove(root, step["from"]))
        elif kind == "copy":
            root = _add(root, path, copy.deepcopy(_at(root, step["from"])))
        elif kind == "test":
            if _at(root, path) != step["value"]:
                raise SchemaError(f"test failed at {path}", path)
        else:
            raise SchemaError(f"unknown operation {kind}", path)
    return root
