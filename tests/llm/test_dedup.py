"""Cover tree, substring dedup and LSH forest against brute force."""

import random

import numpy as np
import pytest

from arborwise.llm import cover_tree, lsh_forest, substring_dedup


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 40])
def test_cover_tree(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    vecs = [(centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 1])).tolist() for _ in range(300)]
    vecs += vecs[:20] + [[0.0] * 8, None, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [], [1e300] * 8, [2e300] * 8, [1.0] * 3, [float("inf")] * 8]
    rows = [(i, v, None if i % 50 == 0 else i % 2) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df).collect()}

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.sqrt(v @ v)

    u = [unit(v) for v in vecs]
    links = [(i, j) for i in range(len(u)) for j in range(i) if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93]
    count = np.bincount(np.array(links).ravel(), minlength=len(u))
    want = {i: (int(count[i]), r, r == i) for i, r in enumerate(roots(len(u), links))}
    assert got == want
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_cells_of_many_clusters_prune(spark, monkeypatch):
    """200 tight clusters in one label: block pairs grow with the vectors, not with their square."""
    monkeypatch.setattr(cover_tree, "BLOCK", 20)
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(200, 32))
    reach = float(np.sqrt(2 - 2 * 0.93))
    made = []
    for n in (1500, 6000):
        v = centres[np.arange(n) % 200] + rng.normal(size=(n, 32)) * 0.02
        df = spark.createDataFrame([(1, 32, i, 1, x.tolist()) for i, x in enumerate(v)], "label int, dim int, rep long, weight long, v array<double>")
        rows, nodes = cover_tree.cells(df, reach)
        assert rows.count() == n == rows.select("rep").distinct().count()
        made.append(cover_tree.block_pairs(cover_tree.cell_pairs(nodes, reach)).count())
    assert made[0] < 400 and made[1] < 1200, made  # all pairs: 2850 and 45,150 of full blocks


def brute_removed(docs, width):
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        w = (t or "").split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, t in docs:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    rng = random.Random(7)
    passages = [[rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(5, 12))] for _ in range(6)]
    docs = []
    for i in range(120):
        w = sum((rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(400)}" for _ in range(6)] for _ in range(rng.randint(0, 6))), [])
        docs.append((i, " \n".join(w)))
    docs += [(5, docs[9][1]), (None, docs[3][1]), (200, None), (201, ""), (202, docs[3][1]), (203, " ".join(["z"] * 30))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_words int")
    got = substring_dedup.substring_dedup(df, width=5).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_removed(docs, 5)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.removed_spans) == r.n_removed for r in got)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def shingle_set(t, k):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_lsh_forest(spark):
    rng = random.Random(8)
    docs = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 80))]
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    docs += [None, "", "  ", "One two", "one TWO", docs[0].upper()]
    sets = [shingle_set(t, 4) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i: (len(sets[i]), r, r == i) for i, r in enumerate(roots(len(docs), links))}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(df, width=4).collect()}
    assert got == want


def test_lsh_forest_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in lsh_forest.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)
    assert lsh_forest.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [4, 300])
def test_lsh_forest_of_a_crowd(spark, parts):
    """Distinct variants of one text, thousands or a few; with 300 ranges the few have almost one each."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for _ in range(2500 if parts == 4 else 18):
        w = list(base)
        for _ in range(rng.choice([2, 3, 4]) if parts == 4 else 1):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append(" ".join(w))
    sets = [shingle_set(t, 4) for t in docs]
    number = {}
    masks = [sum(1 << number.setdefault(x, len(number)) for x in s) for s in sets]
    links = []
    for i, m in enumerate(masks):
        for j in range(i):
            inter = (m & masks[j]).bit_count()
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                links.append((i, j))
    want = dict(enumerate(roots(len(docs), links)))
    assert 1 < len(set(want.values())) < len(docs) if parts == 4 else len(set(want.values())) == 1
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df, width=4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_crowds_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    test_lsh_forest(spark)
