"""Substring dedup: words covered by a window that a document with a smaller id also has are removed.

1. Every task hashes all windows of its documents (Rabin-Karp).  Within a chunk of documents
   all but the smallest id of each hash are settled at once; the smallest goes, packed with
   others, to the bucket of its hash.  So a hash costs a bucket at most one entry per chunk,
   however many copies it has.
2. A bucket sorts its entries and returns the hashes that a smaller id also has.
3. Settled and returned hashes meet the text by blocks of doc_ids; windows are hashed again, those
   listed are marked, and overlapping ones merge into maximal intervals.

Equality of windows is that of 64 hash bits and of the bucket, which comes from further bits
of an independent mix: 64 + log2(buckets) bits, where buckets grow with the input.  A word's
hash is a polynomial with a finaliser, and BLAKE2 for long words, which could be made to collide.

Defined results: null text has no words; a document of fewer than `width` words keeps all;
documents with null doc_id are neither smaller nor larger than any other and keep all; rows
that repeat a doc_id are judged each on its own against smaller ids; an empty table gives an
empty result; further columns are carried along under their own names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, blocks_for, mix, slices, tidy, windows, words

_PACKED = "bucket int, ids binary, counts binary, hashes binary"
_LISTED = "home int, ids binary, counts binary, hashes binary"


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The block of documents that a doc_id belongs to: crc32 of its decimal digits."""
    return np.array([zlib.crc32(str(d).encode()) % homes for d in doc.tolist()], np.int64)


def _packed(key: np.ndarray, doc: np.ndarray, h: np.ndarray) -> dict[str, list]:
    """One row per key: its doc_ids, how many hashes each has, and the hashes."""
    out: dict[str, list] = {"key": [], "ids": [], "counts": [], "hashes": []}
    order = np.lexsort((doc, key))
    key, doc, h = key[order], doc[order], h[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=False):
        d = doc[a:z]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out["key"].append(int(key[a]))
        out["ids"].append(d[first].tobytes())
        out["counts"].append(np.diff(np.r_[first, len(d)]).astype(np.uint32).tobytes())
        out["hashes"].append(h[a:z].tobytes())
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, hash) of all entries of packed rows."""
    ids, counts, hashes = (np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in (("ids", np.int64), ("counts", np.uint32), ("hashes", U64)))
    return np.repeat(ids, counts), hashes


def _entries(ids: np.ndarray, texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc_id) of all windows, once per document, sorted by hash and then doc_id."""
    w = words(texts)
    h, start = windows(w.hashes, w.first, width)
    doc = ids[np.searchsorted(w.first, start, "right") - 1]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _later(h: np.ndarray) -> np.ndarray:
    """In sorted hashes, those that are not the first of their value."""
    out = np.zeros(len(h), bool)
    out[1:] = h[1:] == h[:-1]
    return out


def _mapper(width: int, buckets: int, homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(i, j - i).to_numpy()
                h, doc = _entries(ids, batch.column("text").slice(i, j - i), width)
                late = _later(h)
                where, at = np.unique(doc, return_inverse=True)
                settled = _packed(-1 - _home(where, homes)[at[late]], doc[late], h[late])
                h, doc = h[~late], doc[~late]
                sent = _packed((mix(h + U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int64), doc, h)
                yield pa.RecordBatch.from_arrays([pa.array(settled[k] + sent[k], pa.int32() if k == "key" else pa.binary()) for k in sent], ["bucket", "ids", "counts", "hashes"])
        tidy()

    return run


def _reducer(homes: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: the hashes of each document that a smaller doc_id has too, packed by block of documents."""
        bucket = table.column("bucket")[0].as_py()
        doc, h = _unpacked(table)
        if bucket < 0:  # settled in the mapper
            out = _packed(np.full(len(doc), -1 - bucket), doc, h)
        else:
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(~_later(h))
            again = doc > np.repeat(doc[first], np.diff(np.r_[first, len(h)]))
            where, at = np.unique(doc[again], return_inverse=True)
            out = _packed(_home(where, homes)[at], doc[again], h[again])
        return pa.table([pa.array(out[k], pa.int32() if k == "key" else pa.binary()) for k in out], ["home", "ids", "counts", "hashes"])

    return run


def _marker(width: int, schema: pa.Schema):
    def run(docs: pa.Table, listed: pa.Table) -> pa.Table:
        """A block of documents: marks the windows that are listed for each and joins what is left."""
        owner, known = _unpacked(listed)
        order = np.lexsort((known, owner))
        owner, known = owner[order], known[order]
        tidy()
        docs, made = docs.combine_chunks(), []
        ids, texts = docs.column("doc_id").combine_chunks(), docs.column("text").combine_chunks()
        for i, j in slices(texts):
            w = words(texts.slice(i, j - i))
            h, start = windows(w.hashes, w.first, width)
            edge = np.searchsorted(start, w.first)
            kept, removed, spans = [], [], []
            for k, doc in enumerate(ids.slice(i, j - i).to_pylist()):
                a, z = int(w.first[k]), int(w.first[k + 1])
                gone = np.zeros(z - a + 1, np.int64)
                lo, hi = (0, 0) if doc is None else np.searchsorted(owner, [doc, doc + 1]).tolist()
                if lo < hi:
                    own = h[edge[k] : edge[k + 1]]
                    place = lo + np.minimum(np.searchsorted(known[lo:hi], own), hi - lo - 1)
                    hit = start[edge[k] : edge[k + 1]][known[place] == own] - a
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + width, -1)
                out = np.cumsum(gone[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.r_[0, out.astype(np.int8), 0])).tolist()
                spans.append([{"first": x, "last": y - 1} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                removed.append(int(out.sum()))
                keep = np.flatnonzero(~out) + a
                kept.append(" ".join([w.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.begin[keep].tolist(), w.end[keep].tolist(), strict=True)]))
            own = {"n_words": w.count(), "n_removed": removed, "removed_spans": spans, "kept_text": kept}
            made.append(pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else docs.column(f.name).combine_chunks().slice(i, j - i).cast(f.type) for f in schema], schema=schema))
        return pa.Table.from_batches(made, schema)

    return run


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with n_words, n_removed, removed_spans (word ranges, both ends within) and kept_text (words joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = ("n_words", "n_removed", "removed_spans", "kept_text")
    others = [c for c in docs.columns if c not in (id_col, text_col, *made)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*others).alias("others") if others else F.lit(None).cast("int").alias("others"))
    buckets = blocks_for(base.select("doc_id", "text"), 8 << 20)
    packed = base.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_mapper(width, buckets, buckets), _PACKED)
    listed = packed.groupBy("bucket").applyInArrow(_reducer(buckets), _LISTED)
    spans = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "removed_spans": spans, "kept_text": T.StringType()}
    out = T.StructType([*base.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])
    home = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")
    blocks = base.withColumn("home", home).groupBy("home").cogroup(listed.groupBy("home"))
    done = blocks.applyInArrow(_marker(width, to_arrow_schema(out)), out)
    return done.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), *(F.col(f"others.`{c}`").alias(c) for c in others), *made)


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM w
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM g
), m AS (
  SELECT h, min(doc_id) AS least FROM h GROUP BY h
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (h) WHERE doc_id > least
), n AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w
), r AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n_kept
  FROM k ANTI JOIN c ON k.doc_id = c.doc_id AND k.p = c.p GROUP BY k.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(r.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
