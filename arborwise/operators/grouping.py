"""Groups of nodes that play the same role, by acyclic, exact and indexed lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def meaningful(nodes: DataFrame, basis_fields: DataFrame) -> DataFrame:
    """Nodes with at least one field whose key is a basis field: a semi join on the exploded keys."""
    keys = nodes.select("doc_id", "node_id", F.explode("fields.key").alias("key"))
    hit = keys.join(basis_fields.select(F.col("name").alias("key")), "key", "left_semi").select("doc_id", "node_id").distinct()
    return nodes.join(hit, ["doc_id", "node_id"], "left_semi")


def by_field(nodes: DataFrame) -> DataFrame:
    """key and how many fields and nodes carry it; text is left out."""
    return nodes.select("doc_id", "node_id", F.explode("fields.key").alias("key")).where("key <> 'text'").groupBy("key").agg(F.count("*").alias("n_fields"), F.count_distinct("doc_id", "node_id").alias("n_nodes"))


def index_depth(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the smallest distance at which the indexed lineages differ; null if they never do."""
    deep = nodes.select(*keys, F.posexplode("indexed_lineages").alias("d", "indexed"))
    return deep.groupBy(*keys, "d").agg(F.count_distinct("indexed").alias("n")).where("n > 1").groupBy(*keys).agg(F.min("d").alias("d"))


def group_levels(nodes: DataFrame, matches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups (level, acyclic_lineage, lineage, indexed_lineage, d, size) of a table with those lineages.

    Level 1 groups by acyclic lineage, level 2 parts those that don't match by lineage, level 3
    by indexed lineage at the first distance that parts them.  Groups of one node and groups that
    nothing parts further are accepted.  matches(keys with size) returns the keys that match.
    """
    none = F.lit(None).cast("string")
    one = nodes.groupBy("acyclic_lineage").agg(F.count("*").alias("size"))
    ok1 = one.where("size = 1").select("acyclic_lineage").union(matches(one.where("size > 1")).select("acyclic_lineage")).distinct()
    out = one.join(ok1, "acyclic_lineage", "left_semi").select(F.lit(1).alias("level"), "acyclic_lineage", none.alias("lineage"), none.alias("indexed_lineage"), F.lit(None).cast("int").alias("d"), "size")
    rest = nodes.join(ok1, "acyclic_lineage", "left_anti")
    k2 = ["acyclic_lineage", "lineage"]
    two = rest.groupBy(*k2).agg(F.count("*").alias("size"))
    ok2 = two.where("size = 1").select(*k2).union(matches(two.where("size > 1")).select(*k2)).distinct()
    out = out.union(two.join(ok2, k2, "left_semi").select(F.lit(2), "acyclic_lineage", "lineage", none, F.lit(None).cast("int"), "size"))
    rest = rest.join(ok2, k2, "left_anti")
    depth = index_depth(rest, k2)
    whole = rest.groupBy(*k2).agg(F.count("*").alias("size")).join(depth, k2, "left_anti")
    out = out.union(whole.select(F.lit(2), "acyclic_lineage", "lineage", none, F.lit(None).cast("int"), "size"))
    three = rest.join(depth, k2).withColumn("indexed_lineage", F.get("indexed_lineages", F.col("d"))).where("indexed_lineage is not null")
    return out.union(three.groupBy(*k2, "indexed_lineage", "d").agg(F.count("*").alias("size")).select(F.lit(3), "acyclic_lineage", "lineage", "indexed_lineage", "d", "size"))


def resolve(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes with group_id, by the first tier that fits: acyclic alone, with lineage, with the nearest index; others drop out.

    groups has group_id and acyclic_lineage, lineage and indexed_lineage, null where not used.
    """
    g1 = groups.where("lineage is null and indexed_lineage is null").groupBy("acyclic_lineage").agg(F.min("group_id").alias("g1"))
    g2 = groups.where("lineage is not null and indexed_lineage is null").groupBy("acyclic_lineage", "lineage").agg(F.min("group_id").alias("g2"))
    g3 = groups.where("indexed_lineage is not null").select("acyclic_lineage", "lineage", F.col("indexed_lineage").alias("indexed"), "group_id")
    deep = nodes.select("doc_id", "node_id", "acyclic_lineage", "lineage", F.posexplode("indexed_lineages").alias("d", "indexed"))
    g3 = deep.join(g3, ["acyclic_lineage", "lineage", "indexed"]).groupBy("doc_id", "node_id").agg(F.min_by("group_id", F.struct("d", "group_id")).alias("g3"))
    out = nodes.join(g1, "acyclic_lineage", "left").join(g2, ["acyclic_lineage", "lineage"], "left").join(g3, ["doc_id", "node_id"], "left")
    return out.withColumn("group_id", F.coalesce("g1", "g2", "g3")).where("group_id is not null").drop("g1", "g2", "g3")


def coverage(nodes: DataFrame, basis_fields: DataFrame) -> DataFrame:
    """Per basis field: nodes that have it, all nodes and the share in percent."""
    total = nodes.agg(F.count("*").alias("n_all"))
    have = nodes.select("doc_id", "node_id", F.explode(F.array_distinct("fields.key")).alias("name")).groupBy("name").agg(F.count("*").alias("n_nodes"))
    out = basis_fields.select("name").distinct().join(have, "name", "left").join(F.broadcast(total))  # one row
    return out.select("name", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), "n_all", F.round(F.coalesce("n_nodes", F.lit(0)) * 100.0 / F.col("n_all"), 1).alias("percent"))


def samples(nodes: DataFrame, keys: list[str], most: int = 10, order: list[str] | None = None) -> DataFrame:
    """Up to `most` rows of each group in a given order."""
    w = Window.partitionBy(*keys).orderBy(*(order or ["doc_id", "node_id"]))
    return nodes.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= most)
