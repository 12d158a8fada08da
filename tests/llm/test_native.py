"""Chat formatting, URL filter and Merkle fingerprints."""

import bisect
import hashlib
import random

from pyspark.sql import functions as F

from arborwise.llm import chat_format, merkle, url_filter

CHATS = [
    (1, 0, "system", "s"), (1, 1, "user", "a <|end|> b\\<|"), (1, 2, "assistant", "x</s>[INST] \\ y"), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "tail"),
    (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (None, None, None, None), (4, 1, "assis<|text|>tant", "r\n<|turn|>"),
]


def test_chat_round_trip(spark, tmp_path):
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.digest(spark, str(tmp_path)).collect()}
    said: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, _, role, text in CHATS:
        said.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = chat_format.chat_examples(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"))
    for r in made.collect():
        assert r.formatted.count("</s>") == 0
    assert sum(r.target_turn is not None for r in made.where("conv_id = 1").collect()) == 2


def test_chat_of_nothing(spark):
    assert chat_format.chat_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


URLS = [
    "http://example.com/en/x", "https://WWW.Example.com/en/", "http://a.www.example.com/en/?q", "http://example.com/fr/", "http://example.com", "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/", "ftp://a.org/en/",
    "no scheme", "", None, "http://x.net/es", "a://b://example.com/en/", "http://example.com/en", "http:///en/", "http://example.com:80/en/", "http://.com/", "http://EXAMPLE.COM/EN/", "http://a.com\n/en/",
]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h.count(".") + bool(h), len(p), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(3)
    hosts, paths = ["com", "example.com", "net", "a.net", ""], ["/", "/en/", "/en", "/e", "/en/x", ""]
    many = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(12)]
    df = spark.createDataFrame([(i, u, "old", 1, 2, 3) for i, u in enumerate(URLS)], "page_id long, url string, rule string, hit int, best int, _hit int")
    for rules in (url_filter.RULES, many):
        want = {i: brute(u, rules) for i, u in enumerate(URLS)}
        for most in (1000, 0):
            rows = url_filter.url_filter(df, [*rules, (None, "/", "block"), ("com", None, "block")], most_rules=most).collect()
            assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
            assert all((r.hit, r.best, r._hit) == (1, 2, 3) for r in rows)
            table = spark.createDataFrame([*rules, (None, "/", "block"), ("com", "/", None)], "host string, path string, verdict string")
            rows = url_filter.url_filter(df, table, most_rules=most).collect()
            assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert url_filter.url_filter(df.limit(0), url_filter.RULES).count() == 0


def test_fingerprints(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "δέλτα", "\n", "eps"]
    texts = [None, "", "a", " ".join(rng.choice(words) for _ in range(300)), "same\n\ntext", "same\n\ntext", "same\n\ntext ", "# head\nbody\n# head\nmore"]
    rows = list(enumerate(texts)) + [(50, "x " * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in merkle.digest(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (edited == t)
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert got[5].near_next == 1.0 and got[1].near_next == 1.0 and 0 < got[3].near_edited < 1


def test_next_over_many_ranges(spark):
    ids = random.Random(5).sample(range(10**9), 3000)
    got = {r.doc_id: r.next_text for r in merkle.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), 200).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: str(order[(i + 1) % len(order)]) for i, d in enumerate(order)}


def test_next_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "n"), (3, "a"), (3, "b"), (1, "c")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.text, r.next_text) for r in merkle.with_next(df).collect()) == [(-1, "n", "a"), (1, "c", "n"), (3, "a", "b"), (3, "b", "c")]
    assert merkle.with_next(df.limit(0)).count() == 0


def test_differing_paragraphs(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nX\nc")], "t string, u string")
    made = merkle.with_tree(merkle.with_tree(df, "t", "ft"), "u", "fu")
    assert made.select(merkle.differing(F.col("ft"), F.col("fu")).alias("d")).first().d == [1]
    assert made.select(merkle.differing(F.col("ft"), F.col("ft")).alias("d")).first().d == []


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute_tree(text):
    """(root, sections: (hash, paragraphs: (hash, pieces)))."""
    sections, open_ = [], []
    for line in text.split("\n"):
        pieces, run = [], []
        for w in line.split(" "):
            run.append(w)
            if md5(w)[0] < "4":
                pieces.append(run)
                run = []
        pieces = [" ".join(x).strip(" ") for x in [*pieces, run]]
        h = hashlib.sha256(line.encode()).hexdigest()
        open_.append((h, tuple(md5(x)[:6] for x in pieces if x)))
        if not line.strip(" ") or line.startswith("#") or h[0] < "4":
            sections.append(open_)
            open_ = []
    sections += [open_] if open_ else []
    made = [(hashlib.sha256("".join(h for h, _ in s).encode()).hexdigest(), s) for s in sections]
    return hashlib.sha256("".join(h for h, _ in made).encode()).hexdigest(), made


def brute_fingerprint(text):
    root, sections = brute_tree(text)
    return root + "|" + ";".join(h[:16] + ":" + ",".join(p[:16] + "=" + "".join(x) for p, x in s) for h, s in sections)


def brute_likeness(one, two):
    (ra, a), (rb, b) = brute_tree(one), brute_tree(two)
    if ra == rb:
        return 1.0
    a, b = ({h: s for h, s in x} for x in (a, b))
    n = sum(len(x) for h in a.keys() & b.keys() for _, x in a[h])
    pa, pb = ({p: leaves for h in x.keys() - y.keys() for p, leaves in x[h]} for x, y in ((a, b), (b, a)))
    n += sum(len(pa[p]) for p in pa.keys() & pb.keys())
    la, lb = ({v for p in x.keys() - y.keys() for v in x[p]} for x, y in ((pa, pb), (pb, pa)))
    total = 2 * n + len(la) + len(lb)
    return 2 * (n + len(la & lb)) / total if total else 0.0


def test_fingerprints_and_likeness_match_brute_force(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(60)] + ["δ", "#", "x\u0001y"]
    texts = ["", " ", "\n", "  \n\n", "a"]
    for _ in range(60):
        t = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n"]) for _ in range(rng.randint(1, 120))]
        texts.append("".join(t))
        u = list(t)
        for _ in range(rng.randint(0, 4)):
            u.insert(rng.randrange(len(u) + 1), rng.choice(words) + " ")
        texts.append("".join(u))
    pairs = list(zip(texts, texts[1:])) + [(a, rng.choice(texts)) for a in texts]
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("*", "1 AS paragraphs", "2 AS ends", "3 AS fingerprint", "4 AS own_sections")
    made = merkle.with_likeness(merkle.with_tree(merkle.with_tree(df, "a", "fa"), "b", "fb"), "fa", "fb", "near")
    for r in made.collect():
        if "\u0001" not in r.a + r.b:
            assert r.fa == brute_fingerprint(r.a) and abs(r.near - brute_likeness(r.a, r.b)) < 1e-12
        assert (r.paragraphs, r.ends, r.fingerprint, r.own_sections) == (1, 2, 3, 4)
    own = merkle.fingerprints(df, "a").select("a", "fingerprint", "paragraphs").collect()
    assert all(r.paragraphs == 1 and ("\u0001" in r.a or r.fingerprint == brute_fingerprint(r.a)) for r in own)


def test_one_word_changes_few_pieces(spark):
    rng = random.Random(15)
    w = [f"word{rng.randrange(5000)}" for _ in range(300)]
    df = spark.createDataFrame([(" ".join(w), " ".join(["new", *w])), (" ".join(w), " ".join(w[:150] + w[151:]))], "a string, b string")
    made = merkle.with_likeness(merkle.with_tree(merkle.with_tree(df, "a", "fa"), "b", "fb"), "fa", "fb", "near")
    assert all(r.near > 0.95 for r in made.collect())


def test_bounds_of_several_levels(spark):
    bounds = sorted(random.Random(16).sample(range(10**6), 40_000))
    values = [-1, 0, *bounds[::997], *(b + 1 for b in bounds[::1009]), 10**6 + 1]
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").select("v", merkle._bucket(bounds, F.col("v")).alias("b")).collect()
    assert {r.v: r.b for r in got} == {v: bisect.bisect_left(bounds, v) for v in values} | {None: -1}
