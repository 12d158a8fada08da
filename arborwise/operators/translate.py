"""Mapping records to a target schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_by_lineage(nodes: DataFrame) -> DataFrame:
    """The first node of each lineage."""
    w = Window.partitionBy("lineage").orderBy("doc_id", "depth", "path")
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candidate_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """All (source_lineage, target_lineage): kinds of nodes on both sides, not nodes."""
    left = source.select(F.col("lineage").alias("source_lineage")).distinct()
    right = target.select(F.col("lineage").alias("target_lineage")).distinct()
    return left.join(right, F.lit(True))


def one_mapping(mappings: DataFrame) -> DataFrame:
    """One mapping per source lineage: the one with the least target lineage."""
    w = Window.partitionBy("source_lineage").orderBy("target_lineage")
    return mappings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def translate_fields(nodes: DataFrame, mappings: DataFrame) -> DataFrame:
    """doc_id, node_id and fields renamed by the node's mapping: transformations array<struct<field, image>>."""
    m = one_mapping(mappings).select(F.col("source_lineage").alias("lineage"), "transformations")
    out = F.expr("flatten(transform(transformations, t -> transform(filter(fields, f -> f.key = t.field), f -> named_struct('key', t.image, 'value', f.value))))")
    return nodes.join(m, "lineage").select("doc_id", "node_id", out.alias("fields"))


def translate_network(records: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per parent and image: an array mapping gathers one object per child, an object mapping the first alone.

    records has doc_id, parent_id, ordinal, lineage and object (JSON text); mappings has
    source_lineage, target_lineage, image and cardinality (array, object or primitive).
    """
    m = one_mapping(mappings).select(F.col("source_lineage").alias("lineage"), "image", "cardinality")
    met = records.join(m, "lineage")
    keys = ["doc_id", "parent_id", "image"]
    item = F.struct("ordinal", "object")
    listed = met.where("cardinality = 'array'").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.object).alias("objects"))
    single = met.where("cardinality <> 'array'").groupBy(*keys).agg(F.min_by("object", "ordinal").alias("object")).select(*keys, F.array("object").alias("objects"))
    return listed.withColumn("cardinality", F.lit("array")).unionByName(single.withColumn("cardinality", F.lit("object")))
