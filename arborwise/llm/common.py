"""What the training-data operators share: scratch tables, word hashing, components.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  They are hashed
straight out of Arrow's string buffers with numpy, so no Python string is made
per word.  A word hash is 64 bits wide and well mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_BASE, _STEP, _LENGTH = U64(0x9E6C63D0876A3F4B), U64(0xD1342543DE82EF95), U64(0xA0761D6478BD642F)
#: Bytes of text that are hashed at once; a longer document is hashed alone.
SLICE_BYTES = 3 << 20


# -- scratch tables -------------------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            folder = kept.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="arborwise-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the scratch tables that df reads directly; only for tables that nothing reads any more."""
    folder, jvm = scratch_dir(df.sparkSession), df.sparkSession._jvm
    for part in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stash-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(part)
        if path.getParent().getName() == folder.rsplit("/", 1)[-1]:
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever case they use."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of what df holds, for a file scan the files' bytes; counted where it has none (local rows)."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 60:
        return known
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes), F.lit(8))
    return int(df.agg(F.sum(each.cast("long"))).first()[0] or 0)


def blocks_for(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """Number of blocks so that one holds about bytes_each of input; at least one per shuffle partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, input_bytes(df) // bytes_each + 1))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def tidy(cycles: bool = True) -> None:
    """Gives memory that is free but still held back to the system; workers are used again by other stages."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# -- hashing --------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 ... base**(n-1) modulo 2**64; grown by doubling and kept for the next call."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        full = np.full(size, base, U64)
        full[0] = 1
        have = _kept[base] = np.cumprod(full, dtype=U64)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


#: A polynomial modulo 2**64 can be made to collide by long regular words: longer ones are hashed by BLAKE2.
_LONG = 256
#: Bytes whose running sums are made at once.
_RUN = (1 << 18) - _LONG
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of several documents: hashes, where each begins and ends in data, and each document's range of words."""

    __slots__ = ("hashes", "begin", "end", "first", "data")

    def __init__(self, hashes, begin, end, first, data):
        self.hashes, self.begin, self.end, self.first, self.data = hashes, begin, end, first, data

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        return self.data[self.begin[i] : self.end[j - 1]].tobytes()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets, data


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `most` bytes; a longer text has a range of its own."""
    offsets, _ = _buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _polynomials(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of each word's bytes plus one times powers of _BASE, from differences of running sums; those of long words are not to be used."""
    h = np.empty(len(begin), U64)
    up, down = powers(_BASE, _RUN + _LONG), powers(inverse(_BASE), _RUN)
    cut = np.searchsorted(begin, np.arange(0, len(data) + _RUN, _RUN)).tolist()
    for i, j in zip(cut, cut[1:], strict=False):
        if i == j:
            continue
        at = int(begin[i])
        each = data[at : at + _RUN + _LONG].astype(U64)
        total = np.zeros(len(each) + 1, U64)
        each += U64(1)
        each *= up[: len(each)]
        np.cumsum(each, out=total[1:])
        first, last = begin[i:j] - at, np.minimum(end[i:j] - at, len(each))
        h[i:j] = (np.take(total, last) - np.take(total, first)) * np.take(down, first)
    return h


def words(texts: pa.Array, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """The words of whole texts and their hashes; lower folds A-Z only, table maps each byte first."""
    offsets, whole = _buffers(texts)
    data = whole[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if table is not None:
        data = table[data]
    if lower:
        data = np.take(_LOWER, data)
    n = len(data)
    solid = np.take(_SOLID, data)
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(begin, offsets)
    if not len(begin):
        return Words(np.zeros(0, U64), begin, end, first, data)
    lens = end - begin
    h = mix(_polynomials(data, begin, end) + lens.astype(U64) * _LENGTH)
    for i in np.flatnonzero(lens > _LONG).tolist():
        h[i] = U64(int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little"))
    return Words(h, begin, end, first, data)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every `width` consecutive words of one document, and the word each starts at."""
    n = len(h)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * powers(_STEP, n), out=total[1:], dtype=U64)
    rolled = (total[width:] - total[:-width]) * powers(inverse(_STEP), n - width + 1)
    inside = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    held = np.maximum(lens - width + 1, 0)
    has = held > 0
    np.add.at(inside, first[:-1][has], 1)
    np.add.at(inside, (first[:-1] + held)[has], -1)
    start = np.flatnonzero(np.cumsum(inside[:n])[: n - width + 1])
    return mix(rolled[start]), start


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of width-word shingles of one document; of fewer words the whole sequence is one."""
    n = len(h)
    if not n:
        return h
    k = min(n, width)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= _STEP
        out += h[i : n - k + 1 + i]
    return np.unique(mix(out + U64(k)))


# -- connected components -------------------------------------------------------------------


#: Links of a block that a task contracts at once (16 bytes each).
LINKS_A_BLOCK = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 ... n - 1 the least that links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one block as (a, b): each node but the least to the least that the block's links reach."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    ends = [table.column(c).to_numpy() for c in ("a", "b")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = least_reached(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(own), 100_000):
        k = own[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[root[k]])], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60, block: int = LINKS_A_BLOCK) -> DataFrame:
    """(node, root): the smallest node that links reach, for all nodes of (a, b) long pairs but the smallest of each component.

    Links are dealt into blocks of about `block`, and each block is contracted to stars; this goes
    on with what is left while it shrinks, and is all where one block holds them.  Stars of several
    blocks are then joined by large-star and small-star steps (Kiveris et al., 2014), whose rounds
    grow as the logarithm of the longest path; each round is a table in the shared folder.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while n:
        parts = -(-n // block)
        # One block must be one task whatever the session makes of counts that go with keys: its stars are the result.
        dealt = edges.repartition(parts, "a", "b") if parts > 1 else edges.repartition(1)
        edges = stash(dealt.mapInArrow(_contract, "a long, b long"))
        before, n = n, edges.count()
        if parts == 1:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if n > 0.8 * before:
            break
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stash(small.select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
