import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborwise.functions import fields as fld
from arborwise.operators import grouping, networks, render, sampling, translate, tree, xpath
from arborwise.plans import catalog, pipeline, reasoner
from arborwise.sources.html import html_nodes, with_identity
from arborwise.streaming import ingest

PAGE = '<ul class="list"><li id="a"><a href="/x">A</a><b>1</b></li><li id="b"><a href="/y">B</a></li></ul><p>end</p>'


@pytest.fixture(scope="module")
def nodes(spark):
    return with_identity(html_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))).cache()


def lead(spark, nodes, start, path, single=False):
    starts = nodes.where(F.col("node_id") == start).select("doc_id", "node_id")
    return sorted(r.node_id for r in xpath.evaluate(starts, nodes, path, single).collect())


def test_axes_keep_their_order(nodes):
    ctx = nodes.where("node_id = 'r.1.0.0.0'").select("doc_id", F.col("node_id").alias("ctx"), "node_id")
    told = {a: [r.node_id for r in tree.axis(ctx, nodes, a).orderBy("pos").collect()] for a in tree.AXES}
    assert told["ancestor"] == ["r.1.0.0", "r.1.0", "r.1", "r"] and told["child"] == ["r.1.0.0.0.0"] and told["parent"] == ["r.1.0.0"]
    assert told["following"] == ["r.1.0.0.1", "r.1.0.0.1.0", "r.1.0.1", "r.1.0.1.0", "r.1.0.1.0.0", "r.1.1", "r.1.1.0"]
    assert told["preceding"] == ["r.0"] and told["following-sibling"] == ["r.1.0.0.1"]


def test_paths(spark, nodes):
    assert lead(spark, nodes, "r", "body/ul/li[2]/a/text()") == ["r.1.0.1.0.0"]
    assert lead(spark, nodes, "r", "//li[@id='a']/b") == ["r.1.0.0.1"]
    assert lead(spark, nodes, "r", "//a[starts-with(@href, '/')][last()]") == ["r.1.0.1.0"]
    assert lead(spark, nodes, "r.1.0.0.0", "../following-sibling::li/a") == ["r.1.0.1.0"]
    assert lead(spark, nodes, "r", "//li[@x]") == []
    assert lead(spark, nodes, "r.1.0.0", "./a", single=True) == ["r.1.0.0.0"]
    with pytest.raises(Exception, match="more than one"):
        lead(spark, nodes, "r", "//li", single=True)


@pytest.mark.parametrize("text", ["a", "//a[@href]", "../td[2]/text()", "following-sibling::tr[last()]", "x[contains(@c, 'v')][1]", "a[@b='x/y']", "a[@x and @y]", './b[@q="it\'s"]'])
def test_print_parse_round_trip(text):
    assert xpath.parse(xpath.show(xpath.parse(text))) == xpath.parse(text)


@pytest.mark.parametrize("text", ["", " ", "/", "a[", "a[@b=]", "foo::a"])
def test_bad_paths(text):
    with pytest.raises(ValueError):
        xpath.parse(text)


def test_xpath_of_nodes_leads_back(spark, nodes):
    made = {r.node_id: r.xpath for r in xpath.of_nodes(nodes).collect()}
    assert made["r.1.0.1.0.0"] == "/html/body/ul/li[2]/a/text()"
    assert lead(spark, nodes, "r", made["r.1.0.1.0"].removeprefix("/html/")) == ["r.1.0.1.0"]


def test_deep_hash_matches_the_parser(nodes):
    root = tree.deep_subgraph(nodes).where("node_id = 'r'").first().deep_hash
    assert root == nodes.where("node_id = 'r'").first().shape_hash
    shallow = {r.node_id: r.subgraph_hash for r in tree.shallow_subgraph(nodes).collect()}
    assert all(shallow[r.node_id] == r.subgraph_hash for r in nodes.collect())


def test_envelope(nodes):
    ctx = nodes.where("node_id = 'r.1.0.0'").select("doc_id", F.col("node_id").alias("ctx"), "node_id")
    got = tree.envelope(ctx, nodes, most=5).orderBy("hops", "node_id").collect()
    assert len(got) == 5 and got[0].node_id == "r.1.0.0" and got[-1].hops <= 2


def test_envelope_of_a_chain_goes_all_the_way(spark):
    rows = [(1, f"n{i:02d}", f"n{i - 1:02d}" if i else None, 0) for i in range(12)]
    n = spark.createDataFrame(rows, "doc_id long, node_id string, parent_id string, ordinal int")
    ctx = n.where("node_id = 'n03'").select("doc_id", F.col("node_id").alias("ctx"), "node_id")
    got = [r.node_id for r in tree.envelope(ctx, n).orderBy("rank").collect()]
    assert got == ["n03", "n04", "n02", "n05", "n01", "n06", "n00", *(f"n{i:02d}" for i in range(7, 12))]
    assert tree.envelope(ctx, n, most=3).count() == 3


def test_omitted_is_said_once():
    row = lambda i, parent, path, name: {"node_id": i, "parent_id": parent, "path": path, "name": name, "fields": [{"key": "k" + i, "value": i}]}
    rows = [row("r", None, [], "top"), row("a", "r", [0], ""), row("b", "r", [1], ""), row("c", "r", [2], "li"), row("d", "r", [3], "kept"), row("e", "d", [3, 0], "li")]
    assert render.nested(rows, {"r", "d"}) == {"kr": "r", "_omitted": True, "kept": {"kd": "d", "_omitted": True}}


def test_network_takes_the_first_context(spark):
    """Ten list items of which the first is no context, and whose places sort otherwise as text."""
    rows = [(1, "r", None, 0, [], 0, "ul")] + [(1, f"r.{i}", "r", i, [i], 1, "li") for i in range(12)]
    n = spark.createDataFrame([(*r, []) for r in rows], "doc_id long, node_id string, parent_id string, ordinal int, path array<int>, depth int, name string, fields array<struct<key:string,value:string>>")
    told = F.array(F.struct(F.lit("k").alias("key"), F.col("node_id").alias("value")))
    ctx = n.where("node_id = 'r' or ordinal in (2, 10, 11)").select("doc_id", "node_id", F.col("name").alias("basis"), told.alias("fields"))
    got = {r.start_id: [f.value for f in r.fields] for r in networks.apply_network(ctx, n, ["ul", "li"], [networks.Combine("ul", "li", "li", "..")]).collect()}
    assert got["r"] == ["r", "r.2"] and set(got) == {"r", "r.10", "r.11"}


def test_grouping_by_levels(nodes):
    texts = nodes.where("name = '#text'")
    all_match = grouping.group_levels(texts, lambda g: g).collect()
    assert {(r.level, r["size"]) for r in all_match} == {(1, 2), (1, 1)}
    none = grouping.group_levels(texts, lambda g: g.where("false")).collect()
    three = [r for r in none if r.level == 3]
    assert len(three) == 2 and {r.d for r in three} == {2}
    groups = grouping.group_levels(texts, lambda g: g.where("false")).withColumn("group_id", F.monotonically_increasing_id())
    assert grouping.resolve(texts, groups).count() == texts.count()


def test_fields(spark):
    df = spark.createDataFrame([([("a", " 1 "), ("b", "2"), ("a", "3")],)], f"fields {fld.FIELDS}")
    row = df.select(fld.values("fields", "a").alias("v"), fld.first_value("fields", "z").alias("z"), fld.rename("fields", F.lit("a"), F.lit("x")).alias("r")).first()
    assert row.v == [" 1 ", "3"] and row.z is None and [tuple(x) for x in row.r] == [("x", " 1 "), ("x", "3")]
    df = df.withColumn("id", F.lit(1))
    assert render.flat_json(df, ["id"]).first().json == '{"a":["1","3"],"b":"2"}'
    assert render.flat_json(df, ["id"], "last").first().json == '{"a":"3","b":"2"}'


def test_urls(spark):
    urls = ["http://a.com/x?q=" + "v" * 31 + "&r=1#f", "http://a.com/x", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(fld.shown_attribute(F.col("u"))).collect()]
    assert got == ["http://a.com/x?q=" + "v" * 30 + "...&r=1#f", "http://a.com/x", "nothing"]


def test_network_apply_is_outer_and_consumes(spark, nodes):
    contexts = nodes.where("name in ('a', 'b')").select("doc_id", "node_id", F.col("name").alias("basis"), F.array(F.struct(F.lit("k").alias("key"), F.col("node_id").alias("value"))).alias("fields"))
    edge = networks.Combine("a", "b", "following-sibling::b", "preceding-sibling::a")
    got = {(r.start_id, r.basis): [f.value for f in r.fields] for r in networks.apply_network(contexts, nodes, ["a", "b"], [edge]).collect()}
    assert got == {("r.1.0.0.0", "a"): ["r.1.0.0.0", "r.1.0.0.1"], ("r.1.0.1.0", "a"): ["r.1.0.1.0"]}


def test_components_and_reachability(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([("a", "c"), ("c", "e"), ("e", "a"), ("f", "g")], "left string, right string")
    assert {r.id: r.component for r in networks.components(n, e).collect()} == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "a", "f": "f", "g": "f"}
    asked = spark.createDataFrame([("a", "e"), ("a", "f"), ("a", "zz")], "left string, right string")
    assert [r.connected for r in networks.reachable(n, e, asked).orderBy("right").collect()] == [True, False, False]


def test_render_round_trip(spark):
    docs = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    once = html_nodes(docs)
    again = html_nodes(render.document_html(once).withColumnRenamed("doc_id", "page_id"))
    pick = ["node_id", "name", "fields", "shape_hash"]
    assert sorted(map(str, once.select(*pick).collect())) == sorted(map(str, again.select(*pick).collect()))


def test_nested_json():
    rows = [{"node_id": "r", "parent_id": None, "path": [], "name": "", "fields": [{"key": "a", "value": " 1 "}]}]
    rows += [{"node_id": f"r.{i}", "parent_id": "r", "path": [i], "name": "x", "fields": [{"key": "v", "value": str(i)}]} for i in range(2)]
    assert render.nested(rows) == {"a": "1", "x": [{"v": "0"}, {"v": "1"}]}
    assert render.nested(rows, {"r", "r.1"}) == {"a": "1", "_omitted": True, "x": {"v": "1"}}


def test_translation_takes_the_first_mapping(spark):
    nodes = spark.createDataFrame([(1, "r", "L", [("a", "1")])], f"doc_id long, node_id string, lineage string, fields {fld.FIELDS}")
    maps = spark.createDataFrame([("L", "t2", [("a", "y")]), ("L", "t1", [("a", "x")])], "source_lineage string, target_lineage string, transformations array<struct<field:string,image:string>>")
    assert [tuple(f) for f in translate.translate_fields(nodes, maps).first().fields] == [("x", "1")]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 60), st.integers(1, 5))
def test_spread(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True) if n else 1
    at = sampling.spread(v)
    assert len(set(at)) == len(at) and (at == list(range(n)) if n < 5 else at[0] == 0 and len(at) <= 20)


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "1"), ("b", None)], "hash string, data string")
    c.write("documents", rows)
    c.write("documents", spark.createDataFrame([("a", "2"), ("c", "3")], "hash string, data string"))
    asked = spark.createDataFrame([(x,) for x in "abcd"], "hash string")
    assert {r.hash: (r.data, r.state) for r in c.find("documents", asked).collect()} == {"a": ("2", "positive"), "b": (None, "negative"), "c": ("3", "positive"), "d": (None, "missing")}
    assert {r.state for r in c.find("documents", asked, regenerate=True).collect()} == {"missing"}
    assert {r.state for r in catalog.NoCatalog(spark).find("documents", asked).collect()} == {"missing"}


def test_reasoner_helpers():
    s = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "integer"}}}}}}
    strict = reasoner.strict_schema(s)
    assert strict["required"] == ["a"] and strict["properties"]["a"]["items"]["additionalProperties"] is False
    assert reasoner.instance_of(s) == {"a": [{"b": 0}]}
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise reasoner.TransientError
        return 7

    assert reasoner.retried(call, wait=lambda s: None) == 7 and len(tries) == 3
    with pytest.raises(reasoner.TransientError):
        reasoner.retried(lambda: (_ for _ in ()).throw(reasoner.TransientError()), wait=lambda s: None)


def test_normalize(spark):
    docs = spark.createDataFrame([(i, PAGE.replace("A", f"A{i}").replace("/x", f"/x{i}")) for i in range(3)], "page_id long, html string")
    made = pipeline.normalize(html_nodes(docs))
    got = {r.doc_id: [tuple(f) for f in r.fields] for r in made.records.collect()}
    assert set(got) == {0, 1, 2} and ("a_href", "/x1") in got[1] and ("a", "A1") in got[1]
    assert all(k not in ("li_id", "ul_class") for r in got.values() for k, _ in r)


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string").coalesce(1).write.parquet(str(src))
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    q = ingest.ingest(ingest.pages(spark, str(src)), str(tmp_path / "out"), c, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 2
    assert c.read("documents").count() == 1


def test_components_that_do_not_settle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "left long, right long")
    with pytest.raises(RuntimeError):
        networks.components(nodes, edges, most_rounds=1).collect()
    assert {r.component for r in networks.components(nodes, edges).collect()} == {0}


def test_heads_of_pages_are_parsed_once(spark, tmp_path):
    from arborwise import queries

    pages = [(1, "<html lang='en'><body><h1> One <b>bold</b></h1><h1>A</h1><p>no</p></body></html>"), (2, "<html><body><p>x</p></body></html>"), (3, "<html lang=de><div><h1>Drei</h1></div></html>"), (4, " ")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = queries.html_h1(spark, str(tmp_path))
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()  # was there for each use of the nodes
    assert sorted(tuple(r) for r in made.collect()) == [(1, "en", "A"), (2, None, None), (3, "de", "Drei")]


def test_heads_of_pages_keep_references_as_sql_does(spark, tmp_path):
    import duckdb

    from arborwise import queries

    heads = ["a &amp;&amp; b&amp", "&copy 1 &copy; 2", "&lt;b&gt; &middot; &quot;c&quot", "&amp;copy; &amp;amp; & &#65; x&y=1", "d &am\np; e &\ncopy; f", "plain"]
    pages = [(i, f'<html lang="en"><body><h1>{h}</h1><p>&lt;</p></body></html>') for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = con.execute(queries.SQL["html_h1"]).fetchall()
    got = [tuple(r) for r in queries.html_h1(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (0, "en", "a && b&amp") in got
