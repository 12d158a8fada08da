"""Relationships between basis nodes, networks of them, and records put together by navigation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import FIELDS
from . import xpath
from .scratch import kept


def pairs(basis: DataFrame, key: str = "lineage", compat: bool = False) -> DataFrame:
    """(left, right) of all basis nodes in order of their lineage; compat pairs with the first alone.

    Basis nodes are kinds of nodes, few even for many documents; the theta join is over them only.
    """
    one = basis.select(F.col(key).alias("left")).distinct()
    two = one.withColumnRenamed("left", "right")
    if compat:
        first = one.agg(F.min("left").alias("left"))
        return first.join(two, F.col("left") < F.col("right"))
    return one.join(two, F.col("left") < F.col("right"))


def real(edges: DataFrame) -> DataFrame:
    """Equal and Combine relationships."""
    return edges.where(F.col("type").isin("Equal", "Combine"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "id", left: str = "left", right: str = "right", most_rounds: int = 50) -> DataFrame:
    """(key, component): the smallest key that edges reach, singletons included.

    Labels go along the edges and then to their own label's label; each round is checkpointed.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select(F.col(key).alias("id"), F.col(key).alias("label")).distinct()
    if both.isEmpty():
        return label.select(F.col("id").alias(key), F.col("label").alias("component"))
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        new = label.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = new.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        new = kept(new)
        moved = new.where("label <> old").isEmpty()
        label = new.select("id", "label")
        if moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return label.select(F.col("id").alias(key), F.col("label").alias("component"))


def reachable(nodes: DataFrame, edges: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """asked (left, right) with connected: whether edges lead from one to the other."""
    c = components(nodes, edges, key)
    out = asked.join(c.select(F.col(key).alias("left"), F.col("component").alias("cl")), "left", "left").join(c.select(F.col(key).alias("right"), F.col("component").alias("cr")), "right", "left")
    return out.select("left", "right", F.coalesce(F.col("cl") == F.col("cr"), F.lit(False)).alias("connected"))


@dataclass(frozen=True)
class Combine:
    """Two kinds of nodes that make up one record, and the paths from either to the other."""

    left: str
    right: str
    left_to_right: str
    right_to_left: str


def route(members: list[str], edges: list[Combine]) -> list[tuple[str, list[tuple[int, str, str, str]]]]:
    """For each kind a record may start from: edges (number, from, to, path) in the order they are followed, each once."""
    out = []
    for start in members:
        used, way, queue = set(), [], [start]
        while queue:
            at = queue.pop(0)
            for i, e in enumerate(edges):
                if i not in used and at in (e.left, e.right):
                    used.add(i)
                    to, path = (e.right, e.left_to_right) if at == e.left else (e.left, e.right_to_left)
                    way.append((i, at, to, path))
                    queue.append(to)
        out.append((start, way))
    return out


def apply_network(contexts: DataFrame, nodes: DataFrame, members: list[str], edges: list[Combine]) -> DataFrame:
    """(doc_id, start_id, basis, fields): one record per start, the fields of all contexts it leads to in one multimap.

    contexts has doc_id, node_id, basis (its kind) and fields (already renamed).  Kinds start in
    the order given; a context that a record has reached starts none.  A path that leads to
    nothing leaves the record as it is (outer), one that leads to several takes the first.
    """
    consumed, records = None, None
    empty = F.array().cast(FIELDS)
    for start, way in route(members, edges):
        own = contexts.where(F.col("basis") == start)
        if consumed is not None:
            own = own.join(consumed, ["doc_id", "node_id"], "left_anti")
        record = own.select("doc_id", F.col("node_id").alias("start_id"), F.col("node_id").alias(f"at_{start}"), F.col("fields").alias("fields"))
        for _, source, target, path in way:
            starts = record.where(F.col(f"at_{source}").isNotNull()).select("doc_id", F.col(f"at_{source}").alias("node_id")).distinct()
            # Contexts first, then the first of them in document order: other nodes on the way count for nothing.
            to = contexts.where(F.col("basis") == target).select("doc_id", "node_id", F.col("fields").alias("_more")).join(nodes.select("doc_id", "node_id", "path"), ["doc_id", "node_id"])
            hit = xpath.evaluate(starts, nodes, path).select("doc_id", "start_id", "node_id").join(to, ["doc_id", "node_id"])
            hit = hit.groupBy("doc_id", "start_id").agg(F.min(F.struct("path", "node_id", "_more")).alias("to"))
            hit = hit.select("doc_id", F.col("start_id").alias(f"at_{source}"), F.col("to.node_id").alias(f"to_{target}"), "to._more")
            record = record.join(hit, ["doc_id", f"at_{source}"], "left").withColumn("fields", F.concat("fields", F.coalesce("_more", empty))).drop("_more")
            if f"at_{target}" not in record.columns:
                record = record.withColumnRenamed(f"to_{target}", f"at_{target}")
            else:
                record = record.withColumn(f"at_{target}", F.coalesce(f"at_{target}", f"to_{target}")).drop(f"to_{target}")
        made = record.select("doc_id", "start_id", F.lit(start).alias("basis"), "fields")
        records = made if records is None else records.union(made)
        reached = None
        for c in (c for c in record.columns if c.startswith("at_") and c != f"at_{start}"):
            ids = record.where(F.col(c).isNotNull()).select("doc_id", F.col(c).alias("node_id"))
            reached = ids if reached is None else reached.union(ids)
        if reached is not None:
            consumed = reached.distinct() if consumed is None else consumed.union(reached).distinct()
    return records


def network_of_equals(parts: list[DataFrame]) -> DataFrame:
    """Kinds that mean the same complete thing become one network: a union of their records."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_bound(candidates: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
