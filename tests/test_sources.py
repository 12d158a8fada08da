import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborwise.sources import html, jsondoc, readers

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

LINKS = '<ul><li><a href="/x">A</a></li><li><a href="/y">B</a></li></ul>'


def names(text):
    return [(".".join(map(str, n["path"])), n["name"]) for n in html.walk(html.parse(text))]


def test_identity_of_a_small_page(spark):
    """Worked by hand from the formulas: hashes of names and attribute names, lineages from the root."""
    docs = spark.createDataFrame([(1, LINKS)], "page_id long, html string")
    rows = {r.node_id: r for r in html.with_identity(html.html_nodes(docs)).collect()}
    a = rows["r.1.0.0.0"]
    assert a.hash[:12] == "5148af64e299" and a.lineage[:12] == "f759de0784fe" and a.subgraph_hash[:12] == "e0d8c7aa1b55"
    assert [x[:8] for x in a.indexed_lineages] == ["2d6f0efb", "6baa3122", "31c2dfbf", "84dcbae2", "0754a12b"]
    assert [x[:8] for x in rows["r.1.0.1.0"].indexed_lineages][:2] == ["2d6f0efb", "b716edd6"]
    assert a.lineage == a.acyclic_lineage and not a.is_cyclic
    assert rows["r.1.0.0.0.0"].hash == sha("text") and rows["r.1.0.0.0.0"].indexed_lineages[2].startswith("3f5f7d63")
    assert rows["r"].shape_hash == "95280898766cb611b68af0f98a90598f8234aebf0d696bcb4f21ddd43e015444"


def test_cyclic_lineage(spark):
    nodes = list(html.walk(html.parse("<div><div>x</div></div>")))
    rows = html.with_identity(spark.createDataFrame([(n["name"], list(n["signatures"][2:]), list(n["path"]), []) for n in nodes if len(n["path"]) > 1], "name string, signatures array<string>, path array<int>, child_signatures array<string>")).collect()
    outer, inner, text = rows
    assert outer.lineage[:12] == "6e94298183c3" and inner.lineage[:12] == "1d72c7b4ba14" and inner.acyclic_lineage == outer.lineage
    assert inner.is_cyclic and not outer.is_cyclic and text.lineage[:12] == "97649a37022f" and text.acyclic_lineage[:12] == "e388700cd3a2"


@pytest.mark.parametrize(
    "text, want",
    [
        ("x", ["html", "head", "body", "#text"]),
        ("<p>a<p>b", ["html", "head", "body", "p", "#text", "p", "#text"]),
        ("<title>t</title><p>a", ["html", "head", "title", "#text", "body", "p", "#text"]),
        ("<p><b>a<p>c", ["html", "head", "body", "p", "b", "#text", "p", "b", "#text"]),
        ("a<br>b</br>", ["html", "head", "body", "#text", "br", "#text", "br"]),
        ("<script>'</p>'</script><p>x", ["html", "head", "body", "p", "#text"]),
        ("<ul><li>a<li>b</ul>", ["html", "head", "body", "ul", "li", "#text", "li", "#text"]),
        ("<!-- c --><div> </div>", ["html", "head", "body", "div"]),
        ("", ["html", "head", "body"]),
    ],
)
def test_tree_building(text, want):
    assert [n for _, n in names(text)] == want


def test_blocked_and_markup_attributes():
    rows = list(html.walk(html.parse('<p title="a <b>c</b> <i>d</i>" id=" i "><svg><g>x</g></svg><button>y</button>z &amp; w</p>')))
    assert [r["name"] for r in rows] == ["html", "head", "body", "p", "#text"]
    assert rows[3]["fields"] == [("id", "i")] and rows[4]["fields"] == [("text", "z & w")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/apbli =\"'!-x", max_size=60))
def test_any_text_gives_a_tree(text):
    rows = list(html.walk(html.parse(text)))
    assert rows[0]["name"] == "html" and {r["path"][:-1] for r in rows[1:]} <= {r["path"] for r in rows}


def test_json_tree():
    rows = list(jsondoc.walk({"id": 1, "tags": ["a"], "o": {"x": 2}, "L": [{"y": 3}, 5], "n": None, "b": True}))
    told = [(r["name"], r["fields"], r["signatures"][-1]) for r in rows]
    assert told == [
        ("", [("b", "true"), ("id", "1"), ("n", "null"), ("tags", '"a"')], "object:L,b,id,n,o,tags"),
        ("L", [], "object:L"), ("", [("y", "3")], "object:y"), ("o", [], "object:o"), ("", [("x", "2")], "object:x"),
    ]


def test_bad_documents_give_error_rows(spark):
    docs = spark.createDataFrame([(1, "[1]"), (2, "{"), (3, " "), (4, None), (5, '{"a":1}')], "doc_id long, data string")
    rows = jsondoc.json_nodes(docs).collect()
    assert {r.doc_id for r in rows if r.error} == {1, 2, 3, 4} and [r.node_id for r in rows if r.doc_id == 5] == ["r"]


def test_empty_table(spark):
    assert html.html_nodes(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_specs():
    s = readers.parse_spec("uri=a.html,type=html,origin=o,role=Schema")
    assert s == readers.Spec("a.html", "Html", "o", "schema")
    for bad in ("uri=a,kind=x", "type=html", "uri=a,type=doc", "uri=a,role=x"):
        with pytest.raises(readers.DocumentError):
            readers.parse_spec(bad)


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": 1}))
    assert readers.files(spark, str(tmp_path), "Json").select("data").first()[0] == '{"a": 1}'
    docs = readers.inline(spark, ["x", " ", "y"], "Html")
    assert readers.not_blank(docs).count() == 2
    with pytest.raises(Exception, match="document is empty"):
        readers.not_blank(docs, strict=True).collect()
    urls = spark.createDataFrame([("http://a.com/x",), ("ftp://a",), ("http://",), (None,)], "url string")
    got = readers.fetched(urls, lambda u: "page " + u).collect()
    assert [(r.url, r.text) for r in got] == [("http://a.com/x", "page http://a.com/x")]
    specs = spark.createDataFrame([("a", None, None, None)], "uri string, type string, origin string, role string")
    assert readers.with_fallback(specs, "Html", "o").first()[1:] == ("Html", "o", "instance")
    with pytest.raises(Exception, match="type is missing"):
        readers.with_fallback(specs).collect()


def test_marked_sections_are_comments(spark):
    from arborwise.sources.html import html_nodes

    df = spark.createDataFrame([(1, "<p>a<![foo[x]]>b</p>"), (2, "<![CDATA[y]]><p>c</p>"), (3, "<p>d<![if")], "page_id long, html string")
    rows = html_nodes(df).collect()
    assert {r.doc_id for r in rows if r.name == "p"} == {1, 2, 3}
