"""From documents to records: the stages of normalising, each a DataFrame of the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import FIELDS, trim
from ..operators import grouping
from ..sources.html import with_identity
from .reasoner import Reasoner, RuleReasoner


@dataclass
class Normalized:
    """The tables of all stages."""

    nodes: DataFrame
    fields: DataFrame
    groups: DataFrame
    basis: DataFrame
    records: DataFrame


def normalize(raw_nodes: DataFrame, reasoner: Reasoner | None = None) -> Normalized:
    """Identity, meaningful fields, groups, renames and one record per document.

    A record is the multimap of its document's content fields in document order, named by the
    group's tag and field.
    """
    reasoner = reasoner or RuleReasoner()
    full = with_identity(raw_nodes.where("node_id is not null"))
    up = F.substring_index(F.try_element_at("signatures", F.lit(-2)), ":", 1)
    # Parsed once for all the stages below; what an executor loses is parsed again.
    nodes = full.select("doc_id", "node_id", "path", "name", "fields", "acyclic_lineage", up.alias("up")).persist(StorageLevel.MEMORY_AND_DISK)
    keys = nodes.select(F.explode("fields.key").alias("key")).distinct()
    good = reasoner.basis_fields(keys).where("is_meaningful").select(F.col("key").alias("name"))
    good = good.union(nodes.sparkSession.createDataFrame([("text",)], "name string")).distinct()
    kept = grouping.meaningful(nodes, good)
    groups = kept.groupBy("acyclic_lineage").agg(F.count("*").alias("size"), F.min("name").alias("name"))
    values = kept.select("acyclic_lineage", "name", F.explode("fields").alias("f")).select(F.col("acyclic_lineage").alias("group_id"), "name", F.col("f.key").alias("field"), F.col("f.value").alias("value"))
    parent = kept.groupBy("acyclic_lineage").agg(F.min("up").alias("up"))
    stats = values.join(good.withColumnRenamed("name", "field"), "field", "left_semi").groupBy("group_id", "field").agg(F.count("*").alias("n"), F.approx_count_distinct("value").alias("n_values"), F.min("name").alias("own"))
    stats = stats.join(parent.withColumnRenamed("acyclic_lineage", "group_id"), "group_id").withColumn("tag", F.when(F.col("own") == "#text", F.coalesce("up", F.lit("text"))).otherwise(F.col("own")))
    basis = reasoner.basis_nodes(stats).where("is_content").select("group_id", "field", "image")
    rows = kept.select("doc_id", "path", F.col("acyclic_lineage").alias("group_id"), F.posexplode("fields").alias("pos", "f")).select("doc_id", "path", "pos", "group_id", F.col("f.key").alias("field"), trim(F.col("f.value")).alias("value"))
    named = rows.join(basis, ["group_id", "field"])
    item = F.struct("path", "pos", F.struct(F.col("image").alias("key"), F.col("value").alias("value")).alias("f"))
    records = named.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.f).cast(FIELDS).alias("fields"))
    return Normalized(full, good, groups, basis, records)


def repeated_records(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, lineage, node_id, item): the subtrees that a document repeats, as items in document order."""
    w = Window.partitionBy("doc_id", "lineage")
    many = nodes.where("node_kind = 'element'").withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    order = Window.partitionBy("doc_id", "lineage").orderBy("path")
    return many.select("doc_id", "lineage", "node_id", F.row_number().over(order).alias("item"))
