"""Best-fit packing by patterns: documents' tokens into as few sequences of `size` as can be.

Only the histogram of piece lengths (at most `size` numbers) reaches the driver.  There,
patterns of few lengths that fill a sequence are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares and rounded down, and what is left is packed
best fit first, largest piece first.  The plan is a table of ranges: the pieces of length L
with ranks from a to b go to sequences s, s+1, ... at one offset.  Ranks within a length come
from counts per (length, block), so no task sees all pieces of a length.

Defined results: null text is empty, so it is one piece that holds the end id; rows that
repeat a document are packed each; an empty table gives an empty result; further columns of
the input are not carried.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stash, tidy

END_ID, SIZE = 2, 1024
SPECIAL = "<|endoftext|>"


class Tokens:
    """Byte-level BPE ids, of whole texts at once: a call or a kept entry a word costs more where most words are rare."""

    def __init__(self, ranks_path: str, whole_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole_path, self.whole = whole_path, None

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:  # its own id, as the tokenizers library does it
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.whole_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.encode(text)).tobytes()


@lru_cache(maxsize=2)
def tokens(ranks_path: str | None, whole_path: str | None) -> Tokens:
    """Of this worker; without paths, the files that are installed beside it."""
    import public_tokenizers

    return Tokens(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), whole_path or public_tokenizers.path("byte_bpe_50k.json"))


def _tokenise(ranks_path: str | None, whole_path: str | None, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        coder, last = tokens(ranks_path, whole_path), np.uint32(end_id).tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            for i, j in slices(batch.column("text")):
                rows: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("text").slice(i, j - i), strict=True):
                    ids = coder.ids(text.as_py() or "") + last
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[4 * a : 4 * z]
                        for row, v in zip(rows, (doc, k, a, z - a, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                            row.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)][: 5 + with_ids], names[: 5 + with_ids])
        tidy()

    return run


# -- the plan, from the histogram alone -----------------------------------------------------


def patterns(counts: np.ndarray, each: int = 6) -> list[tuple[int, ...]]:
    """Sets of two to four lengths that fill a sequence whole, `each` for a length at most, frequent ones first."""
    size = len(counts) - 1
    has = counts > 0
    found: dict[tuple[int, ...], None] = {}
    for a in range(size - 1, 0, -1):
        if not has[a]:
            continue
        rest = size - a
        if rest <= a and has[rest]:
            found[(a, rest)] = None
        b = np.arange(1, min(rest, a + 1))
        c = rest - b
        ok = (c <= b) & has[b] & has[c]
        pairs = np.stack([b[ok], c[ok]], 1)
        order = np.argsort(-np.minimum(counts[pairs[:, 0]], counts[pairs[:, 1]]), kind="stable")[:each]
        for x, y in pairs[order].tolist():
            found[(a, x, y)] = None
        for x in np.flatnonzero(has[: min(a, rest // 3) + 1])[-each // 2 :].tolist():  # one of a, three alike or nearly
            if (y := rest - 2 * x) > 0 and y <= a and has[y]:
                found[tuple(sorted((a, x, x, y), reverse=True))] = None
    return list(found)


def fit(counts: np.ndarray, made: list[tuple[int, ...]], steps: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|: accelerated projected gradient."""
    if not made:
        return np.zeros(0)
    a = np.zeros((len(counts), len(made)))
    for j, p in enumerate(made):
        np.add.at(a[:, j], list(p), 1)
    scale = max(1.0, float(counts.max()))
    want = counts / scale
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(a @ v) ** 2 * 1.01)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * (a.T @ (a @ y - want)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def _fill(left: np.ndarray, room: int) -> list[int]:
    """Lengths that fill the room as well as one to three can, else the largest that fits and so on."""
    out: list[int] = []
    while room > 0:
        lens = np.flatnonzero(left[: room + 1])
        lens = lens[lens > 0]
        if not len(lens):
            break
        if lens[-1] == room:
            best = [room]
        else:
            two = lens[(room - lens > 0) & (left[room - lens] > 0)]
            two = two[(2 * two != room) | (left[two] > 1)]
            best = [int(two[-1]), room - int(two[-1])] if len(two) else [int(lens[-1])]
        for b in best:
            left[b] -= 1
        out += best
        room -= sum(best)
    return out


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) for all pieces; counts[n] pieces have length n."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    # A piece over half of a sequence needs one of its own: these lead, and what they can't use is packed among itself.
    for least in (size // 2 + 1, 1):
        made = [p for p in patterns(left) if p[0] >= least]
        for p, x in sorted(zip(made, fit(left.astype(float), made), strict=True), key=lambda v: (len(v[0]), -v[1])):
            use = np.bincount(p, minlength=size + 1)
            n = min(int(x), int(min(left[k] // use[k] for k in set(p))))
            if n > 0:
                out.append((p, n))
                left -= n * use
        while left[least:].any():
            a = int(np.flatnonzero(left)[-1])
            trial = left.copy()
            trial[a] -= 1
            p = (a, *_fill(trial, size - a))
            use = np.bincount(p, minlength=size + 1)
            n = int(min(left[k] // use[k] for k in set(p)))
            out.append((p, n))
            left -= n * use
    return out


def ranges(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place in each kind of sequence."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p, n in made:
        at = 0
        for k in p:
            r = used.get(k, 0)
            out.append((k, r, r + n, sequence, at))
            used[k], at = r + n, at + k
        sequence += n
    return out


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, ranks_path: str | None = None, whole_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    spark = docs.sparkSession
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(base.mapInArrow(_tokenise(ranks_path, whole_path, size, end_id, with_ids), kinds))
    found = pieces.groupBy("length").count().collect()  # one row per length, at most `size`
    counts = np.zeros(size + 1, np.int64)
    for length, n in found:
        counts[length] = n
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // 50_000 + 1)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = pieces.groupBy("length", "block").count()
    before = before.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("block")) - F.col("count")).drop("count")
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rn", F.row_number().over(own)).join(before, ["length", "block"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    # The ranges follow from the histogram: their number has a bound whatever the input is.
    made = spark.createDataFrame(ranges(plan(counts)), "length long, first_rank long, end_rank long, first_sequence long, offset long")
    placed = ranked.join(F.broadcast(made), "length").where("rank >= first_rank and rank < end_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for every piece of every document."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
