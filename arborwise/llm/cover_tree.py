"""Embedding near-dedup: dual traversal of cover trees, exact for pairs of cosine >= threshold within a label.

1. Equal vectors of a label meet by their values and go on as one with a weight.
2. The top of the tree, over the cluster: a cell of more than BLOCK vectors is split around the
   centres of a net over a sample of its own, at the finest of halving radii that has few enough,
   level by level until its parts are small, and once more where these are a few tight clusters.
   Every cell's covering radius is exact.  Pairs of cells are walked from the top: children of
   pairs whose balls come near enough, and no others.  A cell too tight to split is dealt into
   several blocks.
3. Pairs of blocks whose balls come near enough go to a task each.  It builds a cover tree of
   nested levels with halving radii per block and walks both: pairs of nodes are dropped when
   their centres are further apart than the radii and the threshold allow, taken whole when
   all their points must link, and compared in double precision at the leaves.  A node that
   half its points would have to be centres of stays a leaf, compared by matrix products.
4. A task returns a row per linked vector: its weight of links and its component in the task.

Defined results: null labels, null, zero, empty and non-finite vectors and null vec_ids link
with nothing; so do vectors of different lengths; repeated rows count as further vectors; an
empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash

#: Vectors of a block and a leaf, sampled vectors of a cell, centres that split it, levels of splits.
BLOCK, LEAF, SAMPLE, MOST_CENTRES, LEVELS = 4096, 64, 1024, 64, 16
_SLACK = 1e-7


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(u: np.ndarray, radius: float, most: int, cut: bool = False) -> np.ndarray | None:
    """Points, the first included, so that every point is within radius of one; if more than `most`, None or those."""
    open_, out = np.ones(len(u), bool), []
    while open_.any():
        if len(out) == most:
            return np.array(out) if cut else None
        i = int(np.argmax(open_))
        out.append(i)
        open_ &= _distance(u[i : i + 1], u)[0] > radius
        open_[i] = False
    return np.array(out)


class Node:
    __slots__ = ("at", "children", "points", "radius")

    def __init__(self, u: np.ndarray, points: np.ndarray, level: float = 2.0):
        """points[0] is the centre; `level` is the radius its level stands for, the covering radius is exact."""
        self.points, self.at, self.children = points, int(points[0]), []
        d = _distance(u[self.at : self.at + 1], u[points])[0]
        self.radius = float(d.max())
        while len(points) > LEAF and level > self.radius and level > 1e-6:
            level /= 2
        if len(points) <= LEAF or self.radius <= 1e-6:
            return
        # A net that doesn't compress is seen from a few points, before it is built.
        chosen = net(u[points[:: max(1, len(points) // 256)]], level, 128)
        centres = net(u[points], level, len(points) // 2) if chosen is not None else None
        if centres is None or len(centres) < 2:
            return
        near = np.argmin(_distance(u[points], u[points[centres]]), axis=1)
        near[centres] = np.arange(len(centres))
        for k, c in enumerate(centres.tolist()):
            own = np.flatnonzero(near == k)
            self.children.append(Node(u, np.r_[points[c], points[own[own != c]]], level))


class Links:
    """Weights of links and components of a task's vectors."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.total, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def _join(self, members: np.ndarray) -> None:
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def block(self, p: np.ndarray, q: np.ndarray) -> None:
        self.total[p] += self.weight[q].sum()
        self.total[q] += self.weight[p].sum()
        self._join(np.r_[p, q])

    def within(self, p: np.ndarray) -> None:
        self.total[p] += self.weight[p].sum() - self.weight[p]
        self._join(p)

    def some(self, p: np.ndarray, q: np.ndarray, hit: np.ndarray, both: bool) -> None:
        """hit[i, j]: p[i] links q[j]; both: count the links for q too."""
        self.total[p] += hit @ self.weight[q]
        if both:
            self.total[q] += self.weight[p] @ hit
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            self._join(np.r_[p[i], q[hit[i]]])


def traverse(v: np.ndarray, first: Node, second: Node, u: np.ndarray, threshold: float, links: Links) -> None:
    """All pairs between two trees (or within one, if they are the same) of cosine >= threshold."""
    reach = float(np.sqrt(2 - 2 * threshold))
    norm = np.sqrt((v * v).sum(axis=1))
    todo = [(first, second)]
    while todo:
        p, q = todo.pop()
        if p is q:
            if 2 * p.radius <= reach - _SLACK:
                links.within(p.points)
            elif p.children:
                todo += [(a, b) for i, a in enumerate(p.children) for b in p.children[i:]]
            else:
                _leaves(v, norm, p.points, p.points, threshold, links, True)
            continue
        d = float(np.sqrt(max(0.0, 2 - 2 * (u[p.at] @ u[q.at]))))
        if d > p.radius + q.radius + reach + _SLACK:
            continue
        if d + p.radius + q.radius <= reach - _SLACK:
            links.block(p.points, q.points)
        elif p.children and (p.radius >= q.radius or not q.children):
            todo += [(a, q) for a in p.children]
        elif q.children:
            todo += [(p, b) for b in q.children]
        else:
            _leaves(v, norm, p.points, q.points, threshold, links, False)


def _leaves(v, norm, p, q, threshold, links, own: bool) -> None:
    for i in range(0, len(p), 1024):
        part = p[i : i + 1024]
        hit = (v[part] @ v[q].T) / (norm[part][:, None] * norm[q][None, :]) >= threshold
        if own:
            hit[np.arange(len(part)), np.arange(i, i + len(part))] = False
        links.some(part, q, hit, not own)


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)


def _pair(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        ids, weight = table.column("rep").to_numpy()[order], table.column("weight").to_numpy()[order]
        v = _vectors(table)[order]
        # Scaling by a power of two is exact and keeps products of huge or tiny values finite.
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
        u, n = _unit(v), int((side == 0).sum())
        links = Links(weight)
        first = Node(u, np.arange(n))
        second = first if n == len(ids) else Node(u, np.arange(n, len(ids)))
        traverse(v, first, second, u, threshold, links)
        has = np.flatnonzero(links.total)
        return pa.table({"rep": ids[has], "n_links": links.total[has], "root": ids[links.root[has]]})

    return run


KEYS = ["label", "dim"]
CELL = [*KEYS, "cell"]


def _centres(reach: float, block: int):
    def run(table: pa.Table) -> pa.Table:
        """Centres that split one cell, from its sample: the finest level of a nested net that has few enough, or part of one.

        A cell of a block is split only into a few clusters that are tight, else it has one centre.
        """
        u, size = _unit(_vectors(table)), table.column("size")[0].as_py()
        most = min(MOST_CENTRES, max(2, 8 * size // block))
        if size <= block:
            best = net(u, reach / 2, most)
            best = np.zeros(1, np.int64) if best is None else best
        else:
            level = max(float(_distance(u[:1], u).max()), 1e-9)
            best, k = net(u, level / 2, most, cut=True), 2
            while len(best) < most and level / 2**k > reach / 8 and (found := net(u, level / 2**k, most)) is not None:
                best, k = found, k + 1
        head = {c: pa.array([table.column(c)[0].as_py()] * len(best), table.schema.field(c).type) for c in CELL}
        return pa.table(head | {"k": pa.array(np.arange(len(best)), pa.int32()), "centre": pa.array(list(u[best]), pa.list_(pa.float64()))})

    return run


def _assign(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Some rows of one cell, each with its nearest centre's number and distance."""
    near = _distance(_unit(_vectors(rows)), np.array(centres.column("centre").to_pylist()))
    at = near.argmin(axis=1)
    return pa.table({c: rows.column(c) for c in [*CELL, "rep", "weight", "v"]} | {"k": centres.column("k").take(pa.array(at)), "far": near[np.arange(len(at)), at]})


def cells(reps: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their leaf cell, nodes: label, dim, cell, up, centre, radius, size, leaf); cells are paths like /3/17."""
    kind = {f.name: f.dataType.simpleString() for f in reps.schema}
    columns = [*CELL, "rep", "weight", "v"]
    open_ = reps.withColumn("cell", F.lit("")).select(*columns)
    sizes = open_.groupBy(*CELL).agg(F.count("*").alias("size")).withColumn("leaf", F.col("size") <= BLOCK)
    nodes = [stash(sizes.select(*CELL, F.lit(None).cast("string").alias("up"), F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("radius"), "size", "leaf"))]
    done = []
    for level in range(LEVELS):
        split = nodes[-1].where("not leaf").select(*CELL, "size")
        if split.isEmpty():
            break
        done.append(open_.join(nodes[-1].where("leaf").select(*CELL), CELL, "left_semi"))
        wide = open_.join(split, CELL).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
        some = wide.where(F.pmod(F.xxhash64("rep", F.lit(level)), F.greatest(F.floor(F.col("size") / SAMPLE), F.lit(1))) == 0).select(*CELL, "size", "v")
        head = ", ".join(f"{c} {kind.get(c, 'string')}" for c in CELL)
        centres = stash(some.groupBy(*CELL).applyInArrow(_centres(reach, BLOCK), f"{head}, k int, centre array<double>"))
        dealt = wide.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).select(*columns, "part")
        told = centres.join(split, CELL).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1))).select(*CELL, "part", "k", "centre")
        near = dealt.groupBy(*CELL, "part").cogroup(told.groupBy(*CELL, "part")).applyInArrow(_assign, f"{head}, rep long, weight long, v array<double>, k int, far double")
        near = stash(near.withColumns({"up": F.col("cell"), "cell": F.concat_ws("/", "cell", "k")}))
        sizes = near.groupBy(*CELL, "up", "k").agg(F.count("*").alias("size"), F.max("far").alias("radius"))
        sizes = sizes.join(centres.withColumnRenamed("cell", "up"), [*KEYS, "up", "k"])
        sizes = sizes.join(split.select(*KEYS, F.col("cell").alias("up"), F.col("size").alias("before")), [*KEYS, "up"])
        # A cell whose points all link has nothing that splits could prune within it; one of a block is tried once.
        once = (F.col("size") <= BLOCK) & ((F.col("before") <= BLOCK) | (4 * F.col("size") < BLOCK))
        leaf = once | (2 * F.col("radius") <= reach - _SLACK) | F.lit(level == LEVELS - 1)
        nodes.append(stash(sizes.select(*CELL, "up", "centre", "radius", "size", leaf.alias("leaf"))))
        open_ = near.select(*columns)
    rows = open_.join(nodes[-1].where("leaf").select(*CELL), CELL, "left_semi")
    every = nodes[0]
    for more in done:
        rows = rows.unionByName(more)
    for more in nodes[1:]:
        every = every.unionByName(more)
    return rows, every


def cell_pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """(label, dim, cell, size, cell_b, size_b): pairs of leaf cells, cell <= cell_b, whose balls come near enough."""
    nodes = stash(nodes)
    # What a cell opens into: its children, a leaf into itself.
    step = nodes.where("up is not null").withColumnRenamed("up", "from").unionByName(nodes.where("leaf").withColumn("from", F.col("cell")).drop("up"))
    side = lambda b: step.select(*KEYS, *(F.col(c).alias(f"{c}{b}") for c in ("from", "cell", "centre", "radius", "size", "leaf")))
    tops = nodes.where("up is null")
    found = [tops.where("leaf").select(*CELL, "size", F.col("cell").alias("cell_b"), F.col("size").alias("size_b"))]
    open_ = stash(tops.where("not leaf").select(*KEYS, F.col("cell").alias("from"), F.col("cell").alias("from_b")))
    while not open_.isEmpty():
        met = open_.join(side(""), [*KEYS, "from"]).join(side("_b"), [*KEYS, "from_b"]).where("`from` <> from_b or cell <= cell_b")
        apart = F.expr("sqrt(greatest(0D, 2D - 2D * aggregate(zip_with(centre, centre_b, (x, y) -> x * y), 0D, (n, x) -> n + x)))")
        met = met.where((F.col("cell") == F.col("cell_b")) | (apart <= F.col("radius") + F.col("radius_b") + F.lit(reach + _SLACK)))
        met = stash(met.select(*CELL, "size", "leaf", "cell_b", "size_b", "leaf_b"))
        found.append(met.where("leaf and leaf_b").select(*CELL, "size", "cell_b", "size_b"))
        open_ = met.where("not (leaf and leaf_b)").select(*KEYS, F.col("cell").alias("from"), F.col("cell_b").alias("from_b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def block_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of cells as pairs of their blocks of at most about BLOCK vectors."""
    parts = lambda size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / BLOCK).cast("int") - 1))
    return pairs.withColumn("part", parts("size")).withColumn("part_b", parts("size_b")).where("cell <> cell_b or part <= part_b")


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    ok = F.expr("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.withColumn("ok", F.coalesce(ok, F.lit(False)))
    reps = stash(base.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("v")))
    reach = float(np.sqrt(2 - 2 * threshold))
    rows, nodes = cells(reps, reach)
    pairs = stash(block_pairs(cell_pairs(nodes, reach)).select(*CELL, "part", "cell_b", "part_b"))
    at = lambda side, c, p: [*CELL, "part", "cell_b", "part_b", F.lit(side).alias("side"), F.col(c).alias("c"), F.col(p).alias("p")]
    sides = pairs.select(*at(0, "cell", "part")).union(pairs.where("cell <> cell_b or part <> part_b").select(*at(1, "cell_b", "part_b")))
    size = nodes.where("leaf").select(*CELL, F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    told = rows.join(size, CELL).withColumn("p", F.pmod(F.xxhash64("rep"), "parts").cast("int")).select(*KEYS, F.col("cell").alias("c"), "p", "rep", "weight", "v")
    met = sides.join(told, [*KEYS, "c", "p"]).select(*CELL, "part", "cell_b", "part_b", "side", "rep", "weight", "v")
    found = stash(met.groupBy(*CELL, "part", "cell_b", "part_b").applyInArrow(_pair(threshold), "rep long, n_links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    own = reps.select("label", "v", "rep", "weight").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("label", "v", "weight", "n", F.coalesce("root", "rep").alias("component"))
    good = base.where("ok").join(own, ["label", "v"]).select("vec_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    rest = base.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
    / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) >= 0.93
), c AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.r
), m AS (
  SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
