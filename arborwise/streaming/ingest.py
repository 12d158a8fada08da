"""Pages as they arrive: each micro-batch is flattened, and shapes not seen before go to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Catalog
from ..sources.html import html_nodes


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (page_id, url, html) Parquet files."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(folder)


def ingest(stream: DataFrame, out: str, catalog: Catalog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the node table of each batch under out/batch=n; a batch that is repeated replaces its own folder."""

    def batch(rows: DataFrame, n: int) -> None:
        nodes = html_nodes(rows)
        nodes.write.mode("overwrite").parquet(f"{out}/batch={n}")
        made = rows.sparkSession.read.schema(nodes.schema).parquet(f"{out}/batch={n}")
        shapes = made.where("depth = 0").select(F.col("shape_hash").alias("hash")).distinct()
        new = catalog.find("documents", shapes).where("state = 'missing'").select("hash", F.lit(None).cast("string").alias("data"))
        if not new.isEmpty():
            catalog.write("documents", new)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window of a stream, with late data up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
