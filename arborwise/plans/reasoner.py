"""Decisions that need judgement, behind one interface, with rules as the offline default."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reasoner(Protocol):
    """Each method takes and returns DataFrames with one row per thing to decide."""

    def classify(self, documents: DataFrame) -> DataFrame: ...
    def basis_fields(self, keys: DataFrame) -> DataFrame: ...
    def group_matches(self, groups: DataFrame) -> DataFrame: ...
    def basis_nodes(self, fields: DataFrame) -> DataFrame: ...
    def relationships(self, pairs: DataFrame) -> DataFrame: ...


class TransientError(RuntimeError):
    """A failure that another attempt may mend."""


def retried(call: Callable, attempts: int = 6, first: float = 0.1, most: float = 30.0, wait: Callable = time.sleep):
    """call(), again after growing pauses with jitter when it fails transiently."""
    for k in range(attempts):
        try:
            return call()
        except TransientError:
            if k == attempts - 1:
                raise
            wait(min(most, first * 2**k) + random.random() * 0.1)


#: Attributes that carry content and attributes that carry presentation.
CONTENT = ("href", "src", "alt", "title", "placeholder", "aria-label")
PRESENTATION = ("class", "style", "id")


def meaningful_name(name: Column) -> Column:
    """Content attributes, data-* and unknown ones; not presentation, nor handlers (on...)."""
    return name.isin(*CONTENT) | name.startswith("data-") | (~name.isin(*PRESENTATION) & ~name.rlike("^on[a-z]+$") & (name != ""))


def field_name(tag: Column, source: Column) -> Column:
    """snake_case name of a field: the tag, and the attribute where it isn't the text."""
    base = F.regexp_replace(F.lower(F.when(tag == "#text", F.lit("text")).otherwise(tag)), "[^a-z0-9]+", "_")
    return F.when(source == "text", base).otherwise(F.concat(base, F.lit("_"), F.regexp_replace(F.lower(source), "[^a-z0-9]+", "_")))


def snake(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


class RuleReasoner:
    """Deterministic rules; what varies from item to item is content."""

    def classify(self, documents: DataFrame) -> DataFrame:
        """doc_id, name and structure of (doc_id, n_nodes, n_links, n_items)."""
        name = F.when(F.col("n_items") * 3 >= F.col("n_nodes"), "item_list").when(F.col("n_links") * 3 >= F.col("n_nodes"), "link_list").otherwise("article")
        return documents.select("doc_id", name.alias("name"), F.when(name == "article", "single").otherwise("repeated").alias("structure"))

    def basis_fields(self, keys: DataFrame) -> DataFrame:
        """key and is_meaningful."""
        return keys.select("key", meaningful_name(F.col("key")).alias("is_meaningful"))

    def group_matches(self, groups: DataFrame) -> DataFrame:
        """The groups that are one role: nodes of one lineage are, whatever their number."""
        return groups

    def basis_nodes(self, fields: DataFrame) -> DataFrame:
        """group_id, field, image, is_content of (group_id, tag, field, n, n_values): varies, or is a single node."""
        keep = (F.col("n_values") > 1) | (F.col("n") == 1)
        return fields.select("group_id", "field", field_name(F.col("tag"), F.col("field")).alias("image"), keep.alias("is_content"))

    def relationships(self, pairs: DataFrame) -> DataFrame:
        """type of (left, right, same_parent, same_shape): parts of one record combine, equal shapes are equal."""
        kind = F.when(F.col("same_shape"), "Equal").when(F.col("same_parent"), "Combine").otherwise("NoRelationship")
        return pairs.withColumn("type", kind)


def strict_schema(schema: dict) -> dict:
    """A JSON schema without additional properties, all properties required, at every level."""
    out = dict(schema)
    if isinstance(out.get("properties"), dict):
        out["properties"] = {k: strict_schema(v) for k, v in out["properties"].items()}
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    if isinstance(out.get("$defs"), dict):
        out["$defs"] = {k: strict_schema(v) for k, v in out["$defs"].items()}
    if isinstance(out.get("items"), dict):
        out["items"] = strict_schema(out["items"])
    return out


def instance_of(schema: dict, root: dict | None = None):
    """An example value of a JSON schema."""
    root = root if root is not None else schema
    if "$ref" in schema:
        return instance_of(root.get("$defs", {}).get(schema["$ref"].rpartition("/")[2], {}), root)
    for k in ("default", "const"):
        if k in schema:
            return schema[k]
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type", "object" if "properties" in schema else "string")
    kind = kind[0] if isinstance(kind, list) else kind
    if kind == "object":
        return {k: instance_of(v, root) for k, v in schema.get("properties", {}).items()}
    if kind == "array":
        return [instance_of(schema.get("items", {}), root)]
    return {"integer": 0, "number": 0.0, "boolean": False, "null": None}.get(kind, "example")
