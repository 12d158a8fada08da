import random
import re

import numpy as np
import pyarrow as pa
import pytest

from arborwise.llm import common as C

TEXTS = ["a b\tc", "", None, "héé x", "x", "aa  bb \x85 z", "\n", " lead trail ", "A a A", "漢字 and\x0bmore\x0cwords"]


def test_words_match_the_pattern():
    w = C.words(pa.array(TEXTS))
    want = [re.findall(C.WORD, t or "") for t in TEXTS]
    assert [[w.text(i, i + 1).decode() for i in range(a, z)] for a, z in zip(w.first, w.first[1:])] == want
    flat = [x for t in want for x in t]
    assert len({h for h in w.hashes.tolist()}) == len(set(flat))
    assert all((w.hashes[i] == w.hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_words_of_slices_and_lower():
    a = pa.array(["Éa B", "b", "Éa b"]).slice(1)
    w = C.words(a, lower=True)
    assert w.count().tolist() == [1, 2] and w.hashes[0] == w.hashes[2]


def test_hashes_do_not_depend_on_where_running_sums_begin(monkeypatch):
    text = pa.array(["ab c  defgh " * 9 + "x" * 300 + " é", "ab c", "漢字 defgh"])
    want = C.words(text).hashes
    first = [int(C.mix(np.array([sum((b + 1) * pow(int(C._BASE), k, 1 << 64) for k, b in enumerate(w)) + len(w) * int(C._LENGTH) & (1 << 64) - 1], np.uint64))[0]) for w in (b"ab", b"c", b"defgh")]
    assert want[:3].tolist() == first
    monkeypatch.setattr(C, "_RUN", 7)
    assert C.words(text).hashes.tolist() == want.tolist()


def test_windows_are_equal_only_for_equal_words():
    rng = random.Random(1)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(40)]
    w = C.words(pa.array([" ".join(d) for d in docs]))
    h, start = C.windows(w.hashes, w.first, 4)
    want = [tuple(d[i : i + 4]) for d in docs for i in range(len(d) - 3)]
    assert len(h) == len(want) and len(set(h.tolist())) == len(set(want))
    assert len({(x, y) for x, y in zip(h.tolist(), want)}) == len(set(want))


@pytest.mark.parametrize("block", [10**6, 30, 7])
def test_components(spark, block):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()}
    assert all(got.get(n, n) == find(n) for n in root)


def test_components_where_keyed_counts_are_raised(spark, monkeypatch):
    """A session may deal keyed repartitions to more tasks than asked for: one block still gives one root a node."""
    frame = type(spark.range(1))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: plain(self, max(n, 13) if keys else n, *keys))
    edges = [(i, i + 1) for i in range(60)] + [(i, 2 * i) for i in range(100, 130)]
    got = sorted((r.node, r.root) for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted([(i, 0) for i in range(1, 61)] + [(2 * i, i) for i in range(100, 130)])


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles():
    w = C.words(pa.array(["a b c d e", "a b", "a b", "b a", ""]))
    s = [C.shingles(w.hashes[a:z], 3) for a, z in zip(w.first, w.first[1:])]
    assert [len(x) for x in s] == [3, 1, 1, 1, 0] and s[1][0] == s[2][0] != s[3][0]


def test_mix_is_injective_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(C.mix(x))) == len(x)
