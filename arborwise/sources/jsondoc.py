"""JSON documents to a node table.

Scalars and arrays of scalars are fields, as strings; objects and arrays that hold an object
are children.  An object with one key that leads to such a value is a wrapper: its name is the
key and its children are those of the value; any other object wraps each of its nested entries.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .html import flattened


def nested(value) -> bool:
    return isinstance(value, dict) or isinstance(value, list) and any(isinstance(x, dict) for x in value)


def as_text(value) -> str:
    """A scalar as it reads; strings in arrays keep their quotes."""
    if isinstance(value, list):
        return ",".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in value)
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def name(node: dict) -> str:
    return next(iter(node)) if len(node) == 1 and nested(next(iter(node.values()))) else ""


def fields(node: dict) -> list[tuple[str, str]]:
    return [(k, as_text(v)) for k, v in sorted(node.items()) if not nested(v)]


def children(node: dict) -> list[dict]:
    if len(node) == 1:
        value = next(iter(node.values()))
        if isinstance(value, list):
            return [x for x in value if isinstance(x, dict)]
        if isinstance(value, dict):
            return [value]
        return []
    return [{k: v} for k, v in sorted(node.items()) if nested(v)]


def signature(node: dict) -> str:
    return "object:" + ",".join(sorted(node))


def walk(root: dict) -> Iterator[dict]:
    todo: list = [(root, (), (signature(root),))]
    while todo:
        node, path, line = todo.pop()
        below = children(node)
        signs = [signature(c) for c in below]
        yield {"path": path, "node_kind": "object", "name": name(node), "fields": fields(node), "signatures": line, "child_signatures": signs}
        todo += [(c, (*path, i), (*line, s)) for (i, c), s in reversed(list(zip(enumerate(below), signs, strict=True)))]


def shape(rows: list[dict]) -> str:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    below: dict[tuple, list[str]] = {}
    for r in reversed(rows):
        deep = sha("".join(sorted([sha(r["signatures"][-1]), *below.pop(r["path"], [])])))
        if not r["path"]:
            return deep
        if r["signatures"][-1] not in r["signatures"][:-1]:
            below.setdefault(r["path"][:-1], []).append(deep)
    return ""


def _document(text: str):
    root = json.loads(text)
    if not isinstance(root, dict):
        raise ValueError("the root of a JSON document must be an object")
    rows = list(walk(root))
    return rows, shape(rows)


def json_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "data") -> DataFrame:
    """The node table of JSON documents; those that can't be read give one row with error."""
    return flattened(docs, _document, id_col, text_col)
