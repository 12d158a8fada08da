"""Node tables and records back to JSON and HTML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import trim


def field_values(records: DataFrame, by: list[str], duplicates: str = "array") -> DataFrame:
    """One row per record and key, values trimmed: all in order (array) or the last alone (last)."""
    rows = records.select(*by, F.posexplode("fields").alias("pos", "f")).select(*by, "pos", "f.key", trim(F.col("f.value")).alias("value"))
    if duplicates == "last":
        return rows.groupBy(*by, "key").agg(F.max_by("value", "pos").alias("value"))
    return rows.groupBy(*by, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value).alias("values"))


def flat_json(records: DataFrame, by: list[str], duplicates: str = "array") -> DataFrame:
    """by and json: an object with sorted keys; a repeated key is an array, or its last value."""
    rows = field_values(records, by, duplicates)
    quote = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    if duplicates == "last":
        value = quote(F.col("value"))
    else:
        value = F.when(F.size("values") == 1, quote(F.element_at("values", 1))).otherwise(F.to_json("values"))
    rows = rows.select(*by, "key", F.concat(quote(F.col("key")), F.lit(":"), value).alias("item"))
    return rows.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "item"))), lambda x: x.item), ","), F.lit("}")).alias("json"))


def _put(out: dict, key: str, value) -> None:
    if key in out:
        out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
    else:
        out[key] = value


def nested(nodes: list[dict], chosen: set[str] | None = None) -> dict:
    """A tree of node rows as one object: fields flat, named children under their names (several:
    an array), unnamed ones merged; a node that isn't chosen is marked and its children move up."""
    below: dict[str | None, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: list(n["path"])):
        below.setdefault(n["parent_id"], []).append(n)

    omitted = lambda n: chosen is not None and n["node_id"] not in chosen

    def build(n: dict) -> dict:
        out: dict = {"_omitted": True} if omitted(n) else {}
        for f in [] if omitted(n) else n["fields"]:
            _put(out, f["key"], f["value"].strip())
        for c in below.get(n["node_id"], []):
            inner = build(c)
            if c["name"] and not omitted(c):
                _put(out, c["name"], inner)
                continue
            if inner.pop("_omitted", False):  # said once, however many are left out
                out["_omitted"] = True
            for k, v in inner.items():
                _put(out, k, v)
        return out

    tops = below.get(None, [])
    return build(tops[0]) if tops else {}


def _per_document(nodes: DataFrame, make, out: str) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = f.to_dict("records")
        return pd.DataFrame({"doc_id": [rows[0]["doc_id"]], out: [make(rows)]})

    few = nodes.where("node_id is not null").select("doc_id", "node_id", "parent_id", "path", "name", "node_kind", "fields", *(["chosen"] if "chosen" in nodes.columns else []))
    return few.groupBy("doc_id").applyInPandas(run, f"doc_id long, {out} string")


def document_json(nodes: DataFrame) -> DataFrame:
    """doc_id and json of whole trees; with a column chosen, other nodes are left out."""
    def make(rows: list[dict]) -> str:
        chosen = {r["node_id"] for r in rows if r["chosen"]} if "chosen" in rows[0] else None
        return json.dumps(nested(rows, chosen), ensure_ascii=False, sort_keys=True)

    return _per_document(nodes, make, "json")


def document_html(nodes: DataFrame) -> DataFrame:
    """doc_id and html of whole trees: tags of chosen elements, attributes sorted, text as it is."""
    def make(rows: list[dict]) -> str:
        out: list[str] = []
        open_: list[tuple[tuple, str]] = []
        for r in sorted(rows, key=lambda r: list(r["path"])):
            path = tuple(r["path"])
            while open_ and open_[-1][0] != path[: len(open_[-1][0])]:
                out.append(f"</{open_.pop()[1]}>")
            if r["node_kind"] == "text":
                out += [f["value"] for f in r["fields"]]
            elif r.get("chosen", True):
                out.append("<" + r["name"] + "".join(f' {k}="{v}"' for k, v in sorted((f["key"], f["value"].replace('"', "&quot;")) for f in r["fields"])) + ">")
                open_.append((path, r["name"]))
        out += [f"</{name}>" for _, name in reversed(open_)]
        return "".join(out)

    return _per_document(nodes, make, "html")


