"""Mixing, packing, language model, classifier and pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from arborwise.llm import common, cotraining, maxent, mixing, packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160, seed=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 120]))) if i % 5 else " ".join(f"{rng.choice(words)}***" for _ in range(60))
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t)))
    return rows


# -- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.floats(0, 1), st.integers(0, 99))
def test_flight_keeps_both_totals(sizes, p, seed):
    size = np.array(sizes)
    start = np.full(len(size), p)
    out = mixing.flight(start, size, np.random.default_rng(seed))
    assert ((out == 0) | (out == 1)).sum() >= len(size) - 2
    assert abs(out.sum() - start.sum()) < 1e-6 * len(size) + 1e-6 and abs((out * size).sum() - (start * size).sum()) < 1e-4
    landed = mixing.land(out, size, float((start * size).sum()))
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * size).sum() - (start * size).sum()) <= 2 * size.max()


def test_flight_is_unbiased():
    size = np.array([3, 9, 4, 7, 5, 6])
    mean = np.mean([mixing.flight(np.full(6, 0.4), size, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.05


@pytest.mark.parametrize("block", [2000, 8])
def test_mix_meets_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [*corpus(), (7, "again again", "en", "a", 1), (None, "no id", "en", "b", 1), (900, None, "en", "d", 0), (901, "", "en", "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.decide(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            open_.discard(s)
        left = sum(size.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in got:
        s = None if r.no_source else r.name
        assert math.isclose(r.target, target[s], abs_tol=1e-6) and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= (130 if block == 8 else 8) for s in order)
    again = mixing.decide(df.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.name, r.size, r.taken) for r in rs)
    assert key(again) == key(got)
    mixed = mixing.mix(df.selectExpr("*", "'kept' as size", "'too' as name")).collect()
    assert len(mixed) == sum(r.copies for r in got) and {(r["size"], r["name"]) for r in mixed} == {("kept", "too")}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.decide(empty).count() == 0
    zero = mixing.decide(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first()
    assert (zero.target, zero.taken) == (0.0, 0)


# -- packing

TEXTS = [None, "", " ", "a", "Hello world.\nNext line", "two  spaces", "tab\tend ", "é漢字  nb", "it's we'll 123abc", "x <|endoftext|> y", "\n\n\n", " lead", "a\x85b \x1cc", "word " * 3000, "1024 " * 1023]


def test_tokens_are_those_of_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = packing.tokens(None, None)
    for t in [x for x in TEXTS if x is not None] + [r[1] for r in corpus(40)]:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab1'sé漢.\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000     \n\n"), max_size=14))
def test_tokens_of_any_white_space(text):
    assert np.frombuffer(packing.tokens(None, None).ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_tokens_of_runs_and_as_many_other_blanks():
    text = "x\n\n\nb\tc\td"
    assert np.frombuffer(packing.tokens(None, None).ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_tokens_of_rare_words_take_one_call(monkeypatch):
    coder, calls = packing.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")), []
    one_by_one = coder.encode
    monkeypatch.setattr(coder, "encode", lambda text: calls.append(text) or one_by_one(text))
    for kept in (getattr(coder, k, None) for k in ("first", "mid")):
        if kept is not None:
            kept.encode = coder.encode
    text = " ".join(f"word{i}" for i in range(500)) + "\nend"
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert len(calls) == 1  # was one for each word not met before


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_plan_uses_every_piece_once(hist):
    counts = np.zeros(65, np.int64)
    for k, n in hist.items():
        counts[k] = n
    made = packing.plan(counts)
    used = np.zeros(65, np.int64)
    for p, n in made:
        assert sum(p) <= 64
        used += n * np.bincount(p, minlength=65)
    assert (used == counts).all()
    least = max(-(-int((counts * np.arange(65)).sum()) // 64), int(counts[33:].sum()))  # pieces over half can't share
    assert sum(n for _, n in made) <= 1.3 * least + 2


def test_plan_is_tight_on_many_lengths():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1025, 20_000), minlength=1025)
    made = packing.plan(counts)
    assert sum(n for _, n in made) <= 1.01 * (counts * np.arange(1025)).sum() / 1024


def test_pack(spark):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (3, "a"), (None, "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 1024
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- language model


def lm_model(tok, first, bits=14, scale=0.5):
    cells = np.zeros((maxent.LEVELS << bits) * maxent.WAYS, np.int32)
    maxent.count_ways(cells, tok, first, bits)
    totals = np.bincount(maxent.slot(tok), minlength=maxent.SLOTS) + 1.0
    return maxent.Model(totals, maxent.as_logs(cells), bits, np.full((maxent.LEVELS, maxent._FEATURES, maxent._SIZES), scale)), cells


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    model, _ = lm_model(*maxent.tokens(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 40, 300)) for _ in range(20)])))
    context, _ = maxent.tokens(pa.array(["w1 w2 w3"]))
    total = 0.0
    slots = np.arange(maxent.SLOTS, dtype=np.uint64) << np.uint64(64 - 4 * maxent.LEVELS)
    for part in np.array_split(slots, 16):
        tok = np.stack([*(np.full(len(part), c) for c in context[:3]), part], 1).ravel()
        got = model.log10_slots(tok, np.arange(0, len(tok) + 1, 4))
        total += (10 ** got[3::4]).sum()
    assert abs(total - 1) < 1e-3


def test_lm_scores_match_brute_force():
    """Counts, weights and softmax written out token by token."""
    rng = np.random.default_rng(3)
    tok, first = maxent.tokens(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 30, 60)) for _ in range(8)]))
    model, cells = lm_model(tok, first)
    assert (maxent.from_logs(maxent.as_logs(cells)) == cells).all()
    f, s = maxent.features(tok, first), maxent.slot(tok)
    totals = np.bincount(s, minlength=maxent.SLOTS) + 1.0
    seen = Counter()
    for level in range(4):
        row, _, way = maxent.rows_of(f, level, s, 14)
        for rs, w in zip(row.tolist(), way.tolist()):
            for r in rs:
                seen[r, w] += 1
    assert {(k // 16, k % 16): int(cells[k]) for k in np.flatnonzero(cells)} == dict(seen)
    got = model.log10_slots(tok, first)
    for i in rng.integers(0, len(tok), 25).tolist():
        want = 0.0
        for level in range(4):
            row, node, way = maxent.rows_of(f[i : i + 1], level, s[i : i + 1], 14)
            width = 16 ** (4 - level)
            share = totals[int(node[0]) * width : (int(node[0]) + 1) * width].reshape(16, -1).sum(1)
            share = share / share.sum()
            z = [math.log(share[w]) + 0.5 * sum(math.log((seen[r, w] / share[w] + 16) / (sum(seen[r, x] for x in range(16)) + 16)) for r in row[0].tolist()) for w in range(16)]
            want += z[int(way[0])] / math.log(10) - math.log10(sum(math.exp(x) for x in z))
        assert abs(got[i] - want) < 1e-4


def test_lm_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    tok, first = maxent.tokens(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 30, 60)) for _ in range(8)]))
    model, _ = lm_model(tok, first)

    def loss(scales):
        m = maxent.Model(model.totals, model.cells, model.bits, scales)
        return -sum(np.log(p[np.arange(len(w)), w] / p.sum(axis=1)).sum() for _, p, w, _, _ in m.choices(tok, first, without=True))

    got, second = model.gradient(tok, first)
    assert np.allclose(second, second.T)
    for k in np.argsort(-np.abs(got))[:6].tolist():
        up, down = (model.scales.astype(float).copy() for _ in range(2))
        up.ravel()[k] += 0.01
        down.ravel()[k] -= 0.01
        assert abs((loss(up) - loss(down)) / 0.02 - got[k]) < 0.02 * abs(got[k]) + 0.5


def test_lm_learns_every_feature_of_every_token():
    """Three interleaved chains: only the word three back tells the next."""
    rng = np.random.default_rng(4)
    after = rng.permutation(20)
    texts = []
    for _ in range(200):
        w = rng.integers(0, 20, 3).tolist()
        while len(w) < 150:
            w.append(int(after[w[-3]]))
        texts.append(" ".join(f"v{k}" for k in w))
    tok, first = maxent.tokens(pa.array(texts))
    model, cells = lm_model(tok, first, scale=0.3)
    assert cells.sum() == 4 * 4 * len(tok)
    flat = maxent.Model(model.totals, model.cells, model.bits, np.zeros_like(model.scales))
    model = model.stepped(*model.gradient(tok, first))
    assert model.log10_slots(tok, first).mean() > flat.log10_slots(tok, first).mean() + 0.6


def test_lm_is_the_same_on_any_number_of_tasks(spark):
    rng = random.Random(18)
    docs = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(80))) for i in range(250)] + [(i, "the same words again and again " * 9) for i in range(300, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in maxent.lm_scores(df.repartition(n)).collect()} for n in (1, 13))
    assert one.keys() == many.keys() and max(abs(one[d] - many[d]) for d in one) < 1e-6 * 100


def test_lm_base_and_gain(spark):
    rng = random.Random(11)
    langs = [[f"{k}{i}" for i in range(60)] for k in "pqrs"]
    docs = [(i, " ".join(rng.choice(langs[i % 4]) for _ in range(rng.randint(1, 200)))) for i in range(300)]
    docs += [(300, None), (301, "NEVER seen"), (None, "p1 p2"), (2, docs[2][1])]
    got = maxent.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    toks = [(d, [x.lower() for x in re.findall(common.WORD, t or "")] + ["\0end"]) for d, t in docs]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(x for d, t in toks if not held(d) for x in t)
    n, v = sum(c.values()), len(c)
    want = {d: (held(d), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for d, t in toks}
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert maxent.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- classifier


def test_classifier_held_out(spark):
    rows = corpus(600)
    df = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 1 and i % 2)) for i in range(0, 400)] + [(5, None, 1), (99999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.quality(df, labels, bad=()).collect()}
    assert len(got) == 602
    right = [(got[i].quality_score > 0.5) == (i % 5 != 0) for i in range(400, 600)]
    assert np.mean(right) > 0.95
    assert all(got[i].rejected == (got[i].quality_score < 0.5) for i in got)


def test_exchange_names_the_surest_of_all(spark):
    rows = [*corpus(500), (3, "twice", "en", "a", 5), (None, "no id", "en", "a", 5), (700, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    rng, meta = np.random.default_rng(5), ["lang", "source", "n_chars"]
    views = [cotraining.View(1 << cotraining.BITS, 10), cotraining.View(1 << cotraining.META_BITS, 0)]
    views[0].w, views[0].d, views[1].w = rng.normal(size=1 << cotraining.BITS) * 4, rng.normal(size=10), rng.normal(size=1 << cotraining.META_BITS) * 4
    models, taken = {"q": cotraining._slim(views)}, np.arange(0, 60, 3)
    got = cotraining.exchange(df, models, meta, taken, most=25, sure=0.6)
    batch = pa.RecordBatch.from_pylist([dict(zip(["doc_id", "text", *meta], r)) for r in rows if r[0] is not None], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    z = cotraining._logits(models["q"], batch.num_rows, cotraining.text_features(batch.column("text")), cotraining.meta_features(batch, meta))
    ids = batch.column("doc_id").to_pylist()
    for view in (0, 1):
        for side in (0, 1):
            best = {}
            for d, x in zip(ids, z[view] if side else -z[view]):
                if d not in taken and x > math.log(0.6 / 0.4):
                    best[d] = max(best.get(d, -99), x)
            named = [r.doc_id for r in got if (r["view"], r.side) == (view, side)]
            assert len(named) == len(set(named)) == min(25, len(best))
            assert np.allclose(sorted(best[d] for d in named), sorted(best.values())[-len(named) :])


def test_classifier_without_labels(spark):
    df = spark.createDataFrame(corpus(20), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in cotraining.quality(df, none).collect())
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in cotraining.quality(df, one).collect())
    assert cotraining.quality(df.limit(0), one).count() == 0


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(120):
        t = " ".join(f"w{rng.randrange(500)}" for _ in range(80)) if i % 4 else " ".join(f"w{rng.randrange(500)}***" for _ in range(80))
        rows.append((i, t + (" " + passage if i in (9, 41) else ""), "en", "ab"[i % 2], len(t)))
    rows += [(200, rows[1][1], "en", "a", 1), (201, rows[1][1] + " more", "en", "a", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, d))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) >= {i for i in range(120) if i % 4} and not set(seen[0]) & set(range(0, 120, 4))
    assert 200 not in seen[1] and 201 not in seen[1] and set(seen[0]) - set(seen[1]) == {200, 201}
    assert passage in seen[2][9] and passage not in seen[2][41] and len(seen[2][41].split()) == 80
    assert all(seen[2][i] == seen[1][i] for i in seen[1] if i != 41)
    assert set(seen[3]) <= set(seen[2])
    packed = corpus_pipeline.packed(spark, docs, d)
    assert packed.count() == docs.count()


def test_queries_are_named():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)


def test_lm_words_of_a_block_are_found_by_sorting(monkeypatch):
    texts = pa.array(["b a b", "", "c a", None])
    monkeypatch.setattr(np, "union1d", lambda *_: pytest.fail("by a hash table"))
    made = maxent._ask(1)(pa.table({"home": pa.array([3] * 4, pa.int32()), "text": texts}))
    assert sorted(set(maxent.tokens(texts)[0].tolist())) == np.frombuffer(made.column("hashes")[0].as_py(), np.uint64).tolist()
    h, n = maxent._added_up(np.array([5, 2, 5], np.uint64), np.array([1, 2, 3]))
    assert (h.tolist(), n.tolist()) == ([2, 5], [2, 4])
