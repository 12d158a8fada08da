"""Axes and other relations of a node table.

A node table has doc_id, node_id, parent_id, ordinal, depth, path array<int> and name.
Ancestors are found by exploding a node's own path into its prefixes, so that every axis is
an equi-join on (doc_id, key) and none needs a comparison of all pairs of a document.
`pos` numbers the candidates of one context node from 1 in the order of the axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from .scratch import kept

AXES = ("child", "parent", "self", "descendant", "ancestor", "following-sibling", "preceding-sibling", "following", "preceding")


def path_key(path: str) -> str:
    return f"array_join({path}, '.')"


def with_ancestors(nodes: DataFrame, or_self: bool = False) -> DataFrame:
    """doc_id, node_id and up (path key) and distance of each of a node's ancestors, nearest first."""
    last = "size(path)" if or_self else "size(path) - 1"
    ups = F.expr(f"if({last} < 0, array(), transform(sequence(0, {last}), k -> named_struct('up', array_join(slice(path, 1, k), '.'), 'distance', size(path) - k)))")
    return nodes.withColumn("_u", F.explode(ups)).select("*", "_u.up", "_u.distance").drop("_u")


def _candidates(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", F.col("node_id").alias("to_id"), F.col("parent_id").alias("to_parent"), F.col("ordinal").alias("to_ordinal"), F.col("depth").alias("to_depth"), F.col("path").alias("to_path"), F.col("name").alias("to_name"))


def step(contexts: DataFrame, nodes: DataFrame, axis: str, aimed: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx, node_id, o1, o2, o3): the nodes on an axis of each context (doc_id, ctx, node_id) and their order.

    aimed: those of the nodes that are looked for, where not all are; the axes self and parent don't read it.
    """
    aimed = nodes if aimed is None else aimed
    at = contexts.select("doc_id", "ctx", "node_id").join(nodes.select("doc_id", "node_id", "parent_id", "ordinal", "path", "depth"), ["doc_id", "node_id"])
    to = _candidates(aimed)
    none = F.array().cast("array<int>")
    if axis == "self":
        return at.select("doc_id", "ctx", "node_id", F.lit(0).alias("o1"), F.lit(0).alias("o2"), none.alias("o3"))
    if axis == "parent":
        found = at.where("parent_id is not null")
        return found.select("doc_id", "ctx", F.col("parent_id").alias("node_id"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), none.alias("o3"))
    if axis == "child":
        hit = at.join(to.where("to_parent is not null"), (at.doc_id == to.doc_id) & (at.node_id == to.to_parent))
        return hit.select(at.doc_id, "ctx", F.col("to_id").alias("node_id"), F.lit(0).alias("o1"), F.col("to_ordinal").alias("o2"), none.alias("o3"))
    if axis == "ancestor":
        ups = with_ancestors(at)
        keyed = to.withColumn("_k", F.expr(path_key("to_path")))
        hit = ups.join(keyed, (ups.doc_id == keyed.doc_id) & (ups.up == keyed._k))
        return hit.select(ups.doc_id, "ctx", F.col("to_id").alias("node_id"), F.col("distance").alias("o1"), F.lit(0).alias("o2"), none.alias("o3"))
    if axis == "descendant":
        ups = with_ancestors(aimed.select("doc_id", F.col("node_id").alias("to_id"), "path", F.col("depth").alias("to_depth")))
        own = at.select("doc_id", "ctx", F.expr(path_key("path")).alias("_k"))
        hit = own.join(ups, (own.doc_id == ups.doc_id) & (own._k == ups.up))
        return hit.select(own.doc_id, "ctx", F.col("to_id").alias("node_id"), F.lit(0).alias("o1"), F.col("to_depth").alias("o2"), F.col("path").alias("o3"))
    later = axis in ("following-sibling", "following")
    side = (lambda a, b: a > b) if later else (lambda a, b: a < b)
    if axis in ("following-sibling", "preceding-sibling"):
        hit = at.join(to, (at.doc_id == to.doc_id) & (at.parent_id == to.to_parent) & side(F.col("to_ordinal"), F.col("ordinal")))
        return hit.select(at.doc_id, "ctx", F.col("to_id").alias("node_id"), F.lit(0).alias("o1"), F.col("to_ordinal").alias("o2"), none.alias("o3"))
    if axis in ("following", "preceding"):
        # For each ancestor-or-self, its siblings on that side, and below each of them breadth first.
        ups = with_ancestors(at, or_self=True).where("size(path) - distance > 0")
        ups = ups.select("doc_id", "ctx", "distance", F.expr("array_join(slice(path, 1, size(path) - distance - 1), '.')").alias("_k"), F.expr("get(path, size(path) - distance - 1)").alias("_o"))
        sub = with_ancestors(aimed.select("doc_id", F.col("node_id").alias("to_id"), "path", F.col("depth").alias("to_depth")), or_self=True).where("size(path) - distance > 0")
        sub = sub.select("doc_id", "to_id", "to_depth", F.col("path").alias("to_path"), F.expr("array_join(slice(path, 1, size(path) - distance - 1), '.')").alias("_tk"), F.expr("get(path, size(path) - distance - 1)").alias("_to"))
        hit = ups.join(sub, (ups.doc_id == sub.doc_id) & (ups._k == sub._tk) & side(F.col("_to"), F.col("_o")))
        return hit.select(ups.doc_id, "ctx", F.col("to_id").alias("node_id"), (F.col("distance").cast("long") * (1 << 32) + F.col("_to")).alias("o1"), F.col("to_depth").alias("o2"), F.col("to_path").alias("o3"))
    raise ValueError(f"unknown axis {axis}")


def axis(contexts: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(doc_id, ctx, node_id, pos) of an axis; contexts have doc_id, ctx and node_id."""
    found = step(contexts, nodes, name)
    order = Window.partitionBy("doc_id", "ctx").orderBy("o1", "o2", "o3", "node_id")
    return found.withColumn("pos", F.row_number().over(order)).select("doc_id", "ctx", "node_id", "pos")


def with_places(nodes: DataFrame) -> DataFrame:
    """index_in_parent and index_by_name of every node, from 0."""
    one = Window.partitionBy("doc_id", "parent_id").orderBy("ordinal", "node_id")
    alike = Window.partitionBy("doc_id", "parent_id", "name").orderBy("ordinal", "node_id")
    return nodes.withColumns({"index_in_parent": F.row_number().over(one) - 1, "index_by_name": F.row_number().over(alike) - 1})


def shallow_subgraph(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, subgraph_hash): the sorted hashes of the children, then the own."""
    below = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.collect_list("hash").alias("below"))
    both = nodes.select("doc_id", "node_id", "hash").join(below, ["doc_id", "node_id"], "left")
    return both.select("doc_id", "node_id", ident.subgraph_hash("hash", F.coalesce("below", F.array().cast("array<string>"))).alias("subgraph_hash"))


def deep_subgraph(nodes: DataFrame, acyclic: bool = True, depth: int | None = None) -> DataFrame:
    """(doc_id, node_id, deep_hash), one pass per level from the deepest up; acyclic leaves out cyclic children."""
    deepest = depth if depth is not None else nodes.agg(F.max("depth")).first()[0] or 0
    made = None
    for d in range(deepest, -1, -1):
        level = nodes.where(F.col("depth") == d).select("doc_id", "node_id", "parent_id", "hash", *(["is_cyclic"] if acyclic else []))
        if made is None:
            now = level.withColumn("deep_hash", ident.digest("hash"))
        else:
            below = made.where("not is_cyclic") if acyclic else made
            below = below.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.collect_list("deep_hash").alias("below"))
            now = level.join(below, ["doc_id", "node_id"], "left")
            now = now.withColumn("deep_hash", ident.finalize(F.array_sort(F.concat(F.array("hash"), F.coalesce("below", F.array().cast("array<string>")))))).drop("below")
        done = now.select("doc_id", "node_id", "deep_hash")
        out = done if made is None else out.union(done)  # noqa: F821
        made = now
    return out


def envelope(contexts: DataFrame, nodes: DataFrame, most: int = 51) -> DataFrame:
    """(doc_id, ctx, node_id, hops, rank): up to `most` nodes around a context, breadth first, a node's children before its parent.

    It goes on until each context has `most` nodes or no more exist, `most` rounds at the very most.
    """
    key = ["doc_id", "ctx"]
    below = nodes.where("parent_id is not null")
    down = below.select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("to"), F.lit(0).alias("up"), "ordinal")
    up = below.select("doc_id", "node_id", F.col("parent_id").alias("to"), F.lit(1).alias("up"), F.lit(0).alias("ordinal"))
    links = down.unionByName(up)
    seen = contexts.select(*key, "node_id", F.lit(0).alias("hops"), F.lit(1).alias("rank"))
    rim = seen
    for hops in range(1, most):
        found = rim.join(links, ["doc_id", "node_id"]).groupBy(*key, F.col("to").alias("node_id")).agg(F.min(F.struct("rank", "up", "ordinal")).alias("by"))
        found = found.join(seen.select(*key, "node_id"), [*key, "node_id"], "left_anti")
        so_far = seen.groupBy(*key).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*key).orderBy("by", "node_id")
        rim = found.join(so_far, key).withColumn("rank", F.col("n") + F.row_number().over(order)).where(F.col("rank") <= most)
        rim = kept(rim.select(*key, "node_id", F.lit(hops).alias("hops"), F.col("rank").cast("int").alias("rank")))
        if rim.isEmpty():
            break
        seen = seen.union(rim)
    return seen


def first_per_lineage(nodes: DataFrame, breadth_first: bool = True) -> DataFrame:
    """One node per document and lineage: the first by level, or in document order."""
    order = ["depth", "path"] if breadth_first else ["path"]
    w = Window.partitionBy("doc_id", "lineage").orderBy(*order, "node_id")
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
