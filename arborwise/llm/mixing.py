"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size gives each of its documents a whole number of copies and a
fractional inclusion probability.  The flight phase moves these probabilities through the
null-space of two constraints, the source's expected words and its expected documents, until
they are 0 or 1: three documents at a time within a block of BLOCK, then what each block could
not settle (two documents at most) together with others', round by round, so that no task
sees a whole source.  The last one or two of a source land on the nearest total of words.

Draws depend on SEED, source and block alone: reruns agree.

Defined results: null text has size 0 and takes 0; the null source is a source, the last in
order; rows that repeat a doc_id are documents of their own, told apart by what they hold, and
equal rows are alike; if all sizes are 0 so are all targets; an empty table gives an empty
result; a table without further columns and one with any, whatever their names, are mixed
alike, and `mix` returns the columns it was given.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash

BLOCK, SEED, MOST_COPIES, WEIGHTS = 2000, 17, 3, (1, 2, 3)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities with sum p and sum p*size kept and all but two at most 0 or 1."""
    p, eps = p.astype(float).copy(), 1e-9
    rest = np.flatnonzero((p > eps) & (p < 1 - eps)).tolist()
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    sizes, draws, hand = size.astype(float).tolist(), iter(rng.random(len(rest) + 3).tolist()), []
    rest.reverse()
    value = p.tolist()
    while True:
        while rest and len(hand) < 3:
            hand.append(rest.pop())
        if len(hand) == 3:
            a, b, c = (sizes[i] for i in hand)
            u = [b - c, c - a, a - b]
        elif len(hand) == 2 and sizes[hand[0]] == sizes[hand[1]]:
            u = [1.0, -1.0]
        else:
            break
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - value[i]) / d if d > 0 else value[i] / -d for i, d in zip(hand, u, strict=True) if d)
        down = min(value[i] / d if d > 0 else (1 - value[i]) / -d for i, d in zip(hand, u, strict=True) if d)
        go = up if next(draws, 0.5) < down / (up + down) else -down
        for i, d in zip(hand, u, strict=True):
            value[i] += go * d
            value[i] = 0.0 if value[i] < eps else 1.0 if value[i] > 1 - eps else value[i]
        hand = [i for i in hand if 0.0 < value[i] < 1.0]
    return np.array(value)


def land(p: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """Rounds the last few nearest to the wanted total of words, then swaps documents in and out while that comes nearer."""
    out = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        want = wanted - float((p[p == 1.0] * size[p == 1.0]).sum())
        picks = [[(k >> j) & 1 for j in range(len(left))] for k in range(1 << len(left))]
        out[left] = min(picks, key=lambda x: (abs(float(np.dot(x, size[left])) - want), sum(x)))
    for _ in range(3):
        off = float((out * size).sum()) - wanted
        inside, outside = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not len(inside) or not len(outside):
            break
        ranked = outside[np.argsort(size[outside], kind="stable")]
        at = np.clip(np.searchsorted(size[ranked], size[inside] - off), 1, len(ranked) - 1) if len(ranked) > 1 else np.zeros(len(inside), int)
        both = np.concatenate([at, np.maximum(at - 1, 0)])
        change = size[ranked[both]] - np.r_[size[inside], size[inside]]
        k = int(np.argmin(np.abs(off + change)))
        if abs(off + change[k]) >= abs(off):
            break
        out[inside[k % len(inside)]], out[ranked[both[k]]] = 0, 1
    return out


def _settle(last: bool, turn: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("nth", "ascending")])
        size, p = table.column("size").to_numpy(), table.column("p").to_numpy()
        key = f"{SEED}/{turn}/{table.column('no_source')[0]}/{table.column('name')[0]}/{table.column('block')[0]}"
        wanted = float((p * size).sum())
        p = flight(p, size, np.random.default_rng(zlib.crc32(key.encode())))
        if last:
            p = land(p, size, wanted)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return run


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with their place by code point, null last: sorted ranges, each ranked on its own."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(sources.repartitionByRange(parts, "no_source", "name").withColumn("range", F.spark_partition_id()))
    before, offsets = 0, [0] * parts
    for k, n in sorted(dealt.groupBy("range").count().collect()):  # a number per range
        offsets[k], before = before, before + n
    own = F.row_number().over(Window.partitionBy("range").orderBy("no_source", "name"))
    return dealt.withColumn("rank", own - 1 + F.get(F.array(*(F.lit(x) for x in offsets)), F.col("range"))).drop("range")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Per source: n_docs, source_size and target; excess over `most` times a source's size is shared out again by weight.

    The level (target per weight of the sources that are not at their most) rises as sources reach
    their most; each step is one aggregate over the sources, and ends when none is above.
    """
    one = ranked(sizes.groupBy("no_source", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    one = one.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("rank", F.lit(len(weights)))))
    one = stash(one.withColumn("most", F.col("source_size") * float(most)).drop("rank"))
    total, level, full = one.agg(F.sum("source_size").cast("double")).first()[0] or 0.0, 0.0, -1
    while True:
        over = F.col("most") < F.col("weight") * level
        capped, weight, n = one.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == full or not weight:
            break
        level, full = (total - capped) / weight, n
    return one.withColumn("target", F.least("most", F.col("weight") * level)).select("no_source", "name", "n_docs", "source_size", "target")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with no_source, name, size and nth; nth tells rows of one doc_id, source and size apart by what they hold."""
    whole = ["row"] if not any(k in dict(docs.dtypes)["row"] for k in ("map<", "variant")) else ["text"]
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    docs = docs.withColumns({"no_source": F.col("source").isNull(), "name": name, "size": n_words(F.col("text")), "tie": F.struct(F.xxhash64(*whole), F.hash(*whole))})
    same = Window.partitionBy("doc_id", "no_source", "name", "size").orderBy("tie")
    return docs.withColumn("nth", F.row_number().over(same))


def _given(docs: DataFrame) -> DataFrame:
    """doc_id, source and text, and the row itself, in which no name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))


def decide(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, no_source, name, size, nth, source_size, target, copies and taken of every document."""
    sizes = stash(_keyed(_given(docs)).select("doc_id", "no_source", "name", "size", "nth"))
    aims = stash(targets(sizes, weights, most))
    sizes = sizes.join(aims, ["no_source", "name"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("whole", F.floor(ratio + 1e-12).cast("int")).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    most_docs = aims.agg(F.max("n_docs")).first()[0] or 0
    done, turn, rest = None, 0, sizes
    while True:
        last = most_docs <= BLOCK
        n = F.lit(1) if last else F.ceil(F.col("n_docs") / F.lit(BLOCK * max(1, (BLOCK // 4) ** turn))).cast("int")
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(turn)), F.greatest(n, F.lit(1))).cast("int"))
        moved = dealt.groupBy("no_source", "name", "block").applyInArrow(_settle(last, turn), dealt.schema).drop("block")
        if last:
            break
        moved = stash(moved)
        settled = moved.where("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        rest, turn = moved.where("p > 0 and p < 1"), turn + 1
        most_docs = rest.groupBy("no_source", "name").count().agg(F.max("count")).first()[0] or 0
    done = moved if done is None else done.union(moved)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return done.select("doc_id", "no_source", "name", "size", "nth", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it."""
    chosen = decide(docs, weights, most).where("copies > 0")
    keys = ["no_source", "name", "size", "nth"]
    left, right = _keyed(_given(docs)), chosen.select(F.col("doc_id").alias("_id"), *(F.col(k).alias(f"_{k}") for k in keys), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return left.join(right, same).withColumn("again", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for every document."""
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
