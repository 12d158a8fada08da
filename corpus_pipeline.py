"""The corpus pipeline: quality, near copies, repeated passages, mixture and packing.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept.  All but the last
return the columns they were given, whatever those are called; a document of which nothing is
left once earlier documents' passages are out goes.  run() writes each stage's rows as Parquet
in the shared folder, reads them for the next, and removes what no later stage reads.

Defined results: null and empty texts pass the first stages and are packed as an end token;
rows with null doc_id or null source are kept as rows of their own; rows that repeat a doc_id
share the near-copy stage's verdict on that id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborwise.llm import cotraining, lsh_forest, mixing, packing, substring_dedup
from arborwise.llm.common import discard, fresh, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    scored = cotraining.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("not rejected").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, Jaccard 0.8)."""
    own = fresh("kept", docs)
    kept = lsh_forest.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[own]), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; other texts stay as they are."""
    row = fresh("row", docs)
    done = substring_dedup.substring_dedup(docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias(row)))
    cut = F.col("n_removed") > 0
    new = {c: F.col(row)[c] for c in docs.columns if c != "text"} | {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in new:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(new["n_chars"])
    return done.where("n_removed = 0 or n_removed < n_words").select(*(new[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_copies), ("substring_dedup", passages), ("mixing_sources", mixture), ("best_fit_packing", packed)]

#: A trained classifier decides; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
