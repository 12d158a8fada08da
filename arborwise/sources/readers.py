"""Where documents come from: specs, files, inline text, rows of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import url_ok

TYPES = {"js": "JavaScript", "json": "Json", "html": "Html", "xml": "Xml"}
ROLES = ("instance", "schema")


class DocumentError(ValueError):
    """A document, or what describes it, can't be used."""


@dataclass(frozen=True)
class Spec:
    uri: str
    type: str | None = None
    origin: str | None = None
    role: str | None = None


def parse_spec(text: str) -> Spec:
    """uri=..,type=..,origin=..,role=..; an unknown key, type or role is an error."""
    found: dict[str, str] = {}
    for part in text.split(","):
        key, mark, value = part.partition("=")
        key = key.strip()
        if not mark or key not in ("uri", "type", "origin", "role"):
            raise DocumentError(f"unexpected parameter {key!r}")
        found[key] = value.strip()
    if "uri" not in found:
        raise DocumentError("uri is missing")
    if "type" in found and found["type"].lower() not in TYPES:
        raise DocumentError(f"unexpected document type {found['type']!r}")
    if "role" in found and found["role"].lower() not in ROLES:
        raise DocumentError(f"unexpected role {found['role']!r}")
    return Spec(found["uri"], TYPES.get(found.get("type", "").lower()), found.get("origin"), found["role"].lower() if "role" in found else None)


def with_fallback(specs: DataFrame, type_: str | None = None, origin: str | None = None, role: str = "instance") -> DataFrame:
    """Each spec's own metadata, or else the common one; a missing type is an error."""
    kind = F.coalesce("type", F.lit(type_))
    return specs.withColumns(
        {"type": F.when(kind.isNull(), F.raise_error(F.lit("document type is missing")).cast("string")).otherwise(kind), "origin": F.coalesce("origin", F.lit(origin)), "role": F.coalesce("role", F.lit(role))}
    )


def kind_of_uri(uri: Column, exists: Column) -> Column:
    """stdin, http, file or inline."""
    return F.when(uri == "-", "stdin").when(url_ok(uri), "http").when(exists, "file").otherwise("inline")


def files(spark: SparkSession, path: str, type_: str) -> DataFrame:
    """One document per file: doc_id (by hash of the path), uri, document_type, data."""
    rows = spark.read.text(path, wholetext=True).withColumn("uri", F.input_file_name())
    return rows.select(F.xxhash64("uri").alias("doc_id"), "uri", F.lit(type_).alias("document_type"), F.col("value").alias("data"))


def inline(spark: SparkSession, texts: list[str], type_: str) -> DataFrame:
    return spark.createDataFrame([(i, "inline", type_, t) for i, t in enumerate(texts)], "doc_id long, uri string, document_type string, data string")


def rows_as_json(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows of a table as JSON documents."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.to_json(F.struct(*columns)).alias("data"))


def not_blank(docs: DataFrame, column: str = "data", strict: bool = False) -> DataFrame:
    """Documents with text; strict makes a blank one an error."""
    ok = F.length(F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))) > 0
    if strict:
        return docs.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("document is empty")).cast("boolean")))
    return docs.where(ok)


def fetched(urls: DataFrame, fetch=None) -> DataFrame:
    """(url, text, error) by a fetch(url) function on the executors; without one, by urllib."""
    def run(frames):
        import pandas as pd

        def get(url: str) -> str:
            from urllib.request import Request, urlopen

            with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as r:  # noqa: S310
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

        for f in frames:
            rows = []
            for u in f["url"]:
                try:
                    rows.append((u, (fetch or get)(u), None))
                except Exception as e:  # noqa: BLE001 - one bad address must not end the job
                    rows.append((u, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "text", "error"])

    return urls.where(url_ok(F.col("url"))).select("url").mapInPandas(run, "url string, text string, error string")
