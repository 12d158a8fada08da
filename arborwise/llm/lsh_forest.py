"""MinHash near-dedup with an LSH forest: documents whose shingle sets have a Jaccard index of `threshold` or more are linked.

1. Each document's set of distinct word shingles gives its size, a 128-bit set hash and a
   signature of TREES x DEPTH MinHash values.  Equal sets meet by their hash and go on as one.
2. Each tree is the sorted order of its DEPTH values.  It is dealt out by ranges, so that no
   prefix, however common, lands in one task; the rows at the ranges' borders go on to a second
   pass, which meets them across.  All documents of a region by LEAST values meet if they are
   REGION at most, else all of a region by CROWD values do.  Where more than REGION documents
   share CROWD values, they form a crowd, joined with those that it shares documents with.  So
   all that share CROWD values in any tree are compared: a link at the threshold of 0.8 is missed
   with a chance of (1 - 0.8**3)**16, which is 1 in 96,000.
3. Within a crowd all pairs are compared on the full sets, block by block.
4. A one-byte sketch of the signatures drops other pairs that are nearly 5 standard deviations short.
5. Those left are confirmed on the full sets, first each document's likeliest ones, then all that
   still lie between two components.  A pair within a component is not looked at again.

Components come from confirmed links alone.  Step 2 is the only one that can miss a link;
the README has the recall measured against all pairs.

Defined results: null text and texts without words have no shingles and no links; rows that
repeat a doc_id are one document, with the text of fewest shingles (then least set hash); rows
with null doc_id stay alone with null component; an empty table gives an empty result; further
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, least_reached, mix, shingles, slices, stash, tidy, words

TREES, DEPTH, LEAST, CROWD, REGION = 16, 6, 2, 3, 16
#: Rows of the sorted trees that a range holds, about: the number of ranges grows with the documents.
RANGE = 500_000
#: Sets that hold more than this share of all documents are at most its inverse, so these few are broadcast.
HOT = 0.001
#: Documents and shingles of a block of a crowd, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
_K = TREES * DEPTH
_RNG = np.random.default_rng(20240917)
_XOR = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, _K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set of 64-bit shingles."""
    x = (s >> U64(32)).astype(np.uint32)[:, None]
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, ((x[i : i + 256] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def _documents(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j in slices(texts):
        w = words(texts.slice(i, j - i), lower=True)
        for k in range(j - i):
            yield i + k, shingles(w.hashes[w.first[k] : w.first[k + 1]], width)


def _one(s: np.ndarray) -> int:
    """Half of the hash of a set; 0 for the empty one."""
    return int(mix(s).sum(dtype=U64).view(np.int64)) if len(s) else 0


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for _, s in _documents(batch.column("text"), width):
                n.append(len(s))
                one.append(_one(s))
                two.append(np.int64(mix(s ^ U64(0x6A09E667F3BCC909)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "one", "two", "sig"])
        tidy()

    return run


def _meet(ids: np.ndarray, tree: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in sorted order: pairs that are neighbours by their common prefix, and (document, first one) of crowds."""
    n = len(ids)
    same = tree[1:] == tree[:-1]
    common = np.zeros(n - 1, np.int8)  # length of the common prefix with the next row
    for d in range(DEPTH):
        same &= values[1:, d] == values[:-1, d]
        common += same
    small, crowds = {}, None
    for d in (LEAST, CROWD):
        cut = np.flatnonzero(np.r_[True, common < d])
        lens = np.diff(np.r_[cut, n])
        small[d] = np.repeat(lens <= REGION, lens)
        crowds = np.stack([ids, ids[np.repeat(cut, lens)]], 1)[~small[d]]
    a, b = [ids[:0]], [ids[:0]]
    low = common.copy()  # least common prefix from a row to the one `gap` further on
    for gap in range(1, REGION):
        if gap > 1:
            low = np.minimum(low[:-1], common[gap - 1 :])
        if not len(low) or low.max() < LEAST:
            break
        deep = low >= CROWD
        i = np.flatnonzero((low >= LEAST) & np.where(deep, small[CROWD][: n - gap], small[LEAST][: n - gap]))
        a.append(ids[i])
        b.append(ids[i + gap])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0), crowds


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowd", pa.bool_()), ("tree", pa.int32()), ("branch", pa.binary())])


def _neighbours(borders: bool):
    """One sorted range of the trees: pairs and crowds and, where asked for, the rows at its borders (b is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids, tree = table.column("rep").to_numpy(), table.column("tree").to_numpy()
        values = np.frombuffer(b"".join(table.column("branch").to_pylist()), ">u4").reshape(len(ids), DEPTH)
        for crowd, pairs in enumerate(_meet(ids, tree, values)):
            for i in range(0, len(pairs), 50_000):
                part = pairs[i : i + 50_000]
                none = [pa.nulls(len(part), f.type) for f in (_MET.field("tree"), _MET.field("branch"))]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array([bool(crowd)] * len(part)), *none], schema=_MET)
        if borders:
            edge = np.arange(len(ids))
            edge = pa.array(edge[(edge < REGION) | (edge >= len(ids) - REGION)])
            rep, at, branch = (table.column(c).take(edge).combine_chunks() for c in ("rep", "tree", "branch"))
            yield pa.RecordBatch.from_arrays([rep, pa.nulls(len(edge), pa.int64()), pa.nulls(len(edge), pa.bool_()), at.cast(pa.int32()), branch.cast(pa.binary())], schema=_MET)

    return run


def _overlaps(doc: np.ndarray, value: np.ndarray, left: int, start: int, n: int) -> np.ndarray:
    """(left, n - start) sizes of intersections of the first `left` sets with those from `start` on; below the diagonal they may be short."""
    _, col, df = np.unique(value, return_inverse=True, return_counts=True)
    out = np.zeros((left, n - start), np.int32)
    often = df > 32
    number = np.cumsum(often) - 1
    at = np.flatnonzero(often[col])
    d, c = doc[at], number[col[at]]
    order = np.argsort(c, kind="stable")
    d, c = d[order], c[order]
    for k in range(0, int(often.sum()), 1024):  # common shingles: matrix products
        i, j = np.searchsorted(c, [k, k + 1024])
        x = np.zeros((n, min(1024, int(often.sum()) - k)), np.float32)
        x[d[i:j], c[i:j] - k] = 1
        out += (x[:left] @ x[start:].T).astype(np.int32)
    at = np.flatnonzero((df > 1)[col] & ~often[col])
    d, c = doc[at], col[at]
    order = np.lexsort((d, c))
    d, c = d[order], c[order]
    for gap in range(1, 32):  # rare ones: pair by pair
        i = np.flatnonzero(c[gap:] == c[:-gap])
        if not len(i):
            break
        x, y = d[i], d[i + gap]
        both = (x < left) & (y >= start)
        out += np.bincount(x[both] * (n - start) + y[both] - start, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _crowd(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        """Two blocks of a crowd, or one with itself: all pairs are compared; links to the least document that links reach."""
        table = table.sort_by([("home", "ascending"), ("node", "ascending")])
        ids, home, n = table.column("node").to_numpy(), table.column("home").to_numpy(), table.num_rows
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, start = (n, 0) if lo == hi else (int((home == lo).sum()), int((home == lo).sum()))
        sets = [np.frombuffer(x.as_py(), U64) for x in table.column("members")]
        size = np.array([len(x) for x in sets], np.int64)
        inter = _overlaps(np.repeat(np.arange(n), size), np.concatenate(sets), left, start, n)
        linked = 100 * inter >= threshold * (size[:left, None] + size[None, start:] - inter)
        a, b = np.nonzero(np.triu(linked, 1) if lo == hi else linked)
        root = least_reached(a, b + start, n)
        at = np.flatnonzero(root != np.arange(n))
        if n > BLOCK:
            del sets, inter, linked, a, b
            tidy()
        return pa.table({"a": ids[at], "b": ids[root[at]]})

    return run


def _within(crowds: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links that join what the links of all pairs within each crowd (node, root) do."""
    rows = crowds.join(sets.select(F.col("id").alias("node"), "members"), "node")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("members") / 8).alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int")
    large = sizes.select("root", blocks.alias("blocks")).where("blocks > 1")  # few: those of a block are left out
    rows = rows.join(F.broadcast(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), "home", "node", "members")
    return rows.groupBy("root", "lo", "hi").applyInArrow(_crowd(threshold), "a long, b long")


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, _K) for k in ("x", "y"))
            found = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = np.flatnonzero(found >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(found[keep])], ["a", "b", "near"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, wanted = [], [], batch.column("one").to_pylist()
            for i, s in _documents(batch.column("text"), width):
                if _one(s) == wanted[i]:  # of rows that repeat a doc_id, the text that stands for it
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sets, pa.binary())], ["id", "members"])

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= threshold * (len(x) + len(y) - inter):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, rounds: int = 2, spare: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; threshold is the least Jaccard index in percent."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stash(base.mapInArrow(_sign(width), "doc_id long, n_shingles long, one long, two long, sig binary"))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["n_shingles", "one", "two"]
    groups = known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    groups = stash(groups)
    least = groups.groupBy("rep").agg(F.min(F.struct(*key, "sig")).alias("s"))
    reps = stash(least.select("rep", "s.one", "s.sig"))
    branches = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    branches = branches.select("rep", "tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("branch"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() * TREES // RANGE + 1)
    ordered = branches.repartitionByRange(parts, "tree", "branch", "rep").sortWithinPartitions("tree", "branch", "rep")
    kind = "a long, b long, crowd boolean, tree int, branch binary"
    first = stash(ordered.mapInArrow(_neighbours(True), kind))
    edges = first.where("branch is not null").select(F.col("a").alias("rep"), "tree", "branch")
    across = edges.repartition(TREES, "tree").sortWithinPartitions("tree", "branch", "rep").mapInArrow(_neighbours(False), kind)
    found = stash(first.where("branch is null").union(across).select("a", "b", "crowd"))
    crowds = components(found.where("crowd").select("a", "b"))
    crowds = stash(crowds.union(crowds.select(F.col("root").alias("node"), "root").distinct()))
    pairs = found.where("not crowd").select("a", "b").distinct()
    sketch = reps.select("rep", F.expr(f"unhex(array_join(transform(sequence(1, {_K}), i -> hex(substring(sig, 4 * i, 1))), ''))").alias("sketch"))
    sketch = sketch.join(crowds.withColumnRenamed("node", "rep"), "rep", "left")
    for side, as_ in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sketch.select(F.col("rep").alias(side), F.col("sketch").alias(as_), F.col("root").alias(f"r{side}")), side)
    met = pairs.where("ra is null or rb is null or ra <> rb")
    pairs = stash(met.select("a", "b", "x", "y").mapInArrow(_likely(threshold / 100 - spare), "a long, b long, near double"))
    met = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(crowds.select("node")).distinct().join(reps.select("rep", "one"), "rep").withColumnRenamed("rep", "doc_id")
    # The same plan at every size: the ids grow with the input, so they are not broadcast.
    sets = stash(base.join(met.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "one", "text").mapInArrow(_sets(width), "id long, members binary"))
    links = stash(_within(crowds, sets, threshold))
    for k in range(rounds + 1):
        if k < rounds:  # each document's likeliest pair of those left
            best = F.max(F.struct("near", F.col("a").alias("a"), F.col("b").alias("b"))).alias("p")
            turn = pairs.groupBy("a").agg(best).select("p.*").union(pairs.groupBy("b").agg(best).select("p.*")).distinct()
        else:
            turn = pairs
        new = _confirmed(turn, sets, threshold)
        links = stash(links.union(new))
        roots = components(links)
        if k < rounds:
            pairs = pairs.join(turn.select("a", "b"), ["a", "b"], "left_anti")
            for side in ("a", "b"):
                pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
            pairs = stash(pairs.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "near"))
    # A copy belongs where the first document of its set does; the few sets with many copies go to all tasks.
    owner = groups.select(*key, "n", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "n", F.coalesce("root", "rep").alias("own"))
    many = F.col("n") > HOT * signed.count()
    rows = signed.select("doc_id", *key)
    hot = F.broadcast(owner.where(many).drop("n"))
    full = rows.where("n_shingles > 0")
    out = full.join(hot, key).unionByName(full.join(hot, key, "left_anti").join(owner.where(~many).drop("n"), key, "left"))
    out = out.unionByName(rows.where("n_shingles = 0").withColumn("own", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, over all documents: four words a shingle."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), c AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.r
), m AS (
  SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id
)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
