"""What was inferred once is kept: one Parquet table per entity under a root folder.

A lookup is a left join; a key may be unknown, known to have no value, or known with one.
Writing replaces the rows of the keys it brings and keeps the others, in a new version
folder that a pointer file names last, so that readers never see half a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {
    "documents": ["hash"], "classifications": ["lineage_hash"], "basis_fields": ["acyclic_subgraph_hash"], "basis_nodes": ["lineage_hash"], "basis_graphs": ["hash"],
    "node_relationships": ["left_basis_lineage", "right_basis_lineage"], "basis_groups": ["acyclic_lineage_hash", "lineage_hash", "indexed_lineage_hash"],
    "translation_nodes": ["lineage_from", "lineage_to"], "translation_networks": ["lineage_from", "lineage_to"],
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose keys they don't have."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys).distinct(), _all(same), "left_anti").unionByName(new)


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def lookup(asked: DataFrame, table: DataFrame, keys: list[str], regenerate: bool = False) -> DataFrame:
    """asked with data and state: missing, negative (known to have none) or positive; regenerate finds nothing."""
    if regenerate:
        return asked.withColumns({"data": F.lit(None).cast("string"), "state": F.lit("missing")})
    known = table.select(*keys, "data", F.lit(True).alias("_hit"))
    out = asked.join(known, keys, "left")
    state = F.when(F.col("_hit").isNull(), "missing").when(F.col("data").isNull(), "negative").otherwise("positive")
    return out.withColumn("state", state).drop("_hit")


def groups_of(groups: DataFrame, acyclic: str, lineage: str | None = None, indexed: str | None = None) -> DataFrame:
    """Groups by one, two or three keys; by the first alone, of all levels."""
    out = groups.where(F.col("acyclic_lineage_hash") == acyclic)
    if lineage is not None:
        out = out.where(F.col("lineage_hash") == lineage)
    if indexed is not None:
        out = out.where(F.col("indexed_lineage_hash") == indexed)
    return out


class Catalog:
    """Tables of KEYS under a folder; an absent one is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/current")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        keys = KEYS[name]
        path, fs = self._pointer(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", data string")
        version = self.spark.read.text(path.toString()).first()[0]
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        keys = KEYS[name]
        rows = rows.select(*keys, "data").dropDuplicates(keys)
        version = uuid.uuid4().hex
        upsert(self.read(name), rows, keys).write.parquet(f"{self.root}/{name}/{version}")
        path, fs = self._pointer(name)
        out = fs.create(path, True)
        out.write(bytearray((version + "\n").encode()))
        out.close()

    def find(self, name: str, asked: DataFrame, regenerate: bool = False) -> DataFrame:
        return lookup(asked, self.read(name), KEYS[name], regenerate)


class NoCatalog:
    """Knows nothing and keeps nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in KEYS[name]) + ", data string")

    def write(self, name: str, rows: DataFrame) -> None:
        pass

    def find(self, name: str, asked: DataFrame, regenerate: bool = False) -> DataFrame:
        return lookup(asked, self.read(name), KEYS[name], True)
