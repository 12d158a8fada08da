"""HTML to a node table.

A small tree builder on the standard library's tokenizer follows the parts of the HTML5 rules
that real pages need: html, head and body are implied, void elements close themselves, p, li
and table parts end by implication, open formatting elements are taken up again in later
blocks, script and style hold raw text.  Newlines are deleted before parsing, comments and blank text
dropped, text trimmed; elements that carry no content are left out with all they hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident

# The elements that the data model leaves out, in their usual order.
BLOCKED = ("svg", "script", "iframe", "input", "button", "link", "meta", "style", "noscript")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template button".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_PARTS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot")}
TABLE_PARTS["thead"] = TABLE_PARTS["tfoot"] = TABLE_PARTS["tbody"]


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


class Builder(HTMLParser):
    """Builds the tree; `stack` holds the open elements, `active` the formatting ones to take up again."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.head, self.body = Element("head", {}), None
        self.root.children.append(self.head)
        self.stack: list[Element] = [self.root, self.head]
        self.active: list[Element] = []
        self.done_head = False

    # -- helpers

    def _open_body(self) -> None:
        if self.body is None:
            self.done_head = True
            self.body = Element("body", {})
            self.root.children.append(self.body)
            self.stack = [self.root, self.body]

    def _pop_to(self, name: str, stop: frozenset[str] = SCOPE) -> bool:
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return True
            if self.stack[i].name in stop:
                return False
        return False

    def _take_up(self) -> None:
        for k, e in enumerate(self.active):
            if not any(x is e for x in self.stack):
                new = Element(e.name, dict(e.attrs))
                self.stack[-1].children.append(new)
                self.stack.append(new)
                self.active[k] = new

    def _add(self, name: str, attrs: dict[str, str]) -> Element:
        e = Element(name, attrs)
        self.stack[-1].children.append(e)
        if name not in VOID:
            self.stack.append(e)
        return e

    # -- tokens

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![...>` outside of foreign content is a comment up to the next `>`."""
        end = self.rawdata.find(">", i + 3)
        if end < 0:
            return -1
        self.handle_comment(self.rawdata[i + 2 : end])
        return end + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, "" if v is None else v)
        if tag in ("html", "body"):
            target = self.root
            if tag == "body":
                self._open_body()
                target = self.body
            for k, v in found.items():
                target.attrs.setdefault(k, v)
            return
        if tag == "head":
            if not self.done_head:
                self.head.attrs.update({k: v for k, v in found.items() if k not in self.head.attrs})
            return
        if self.body is None:
            if tag in HEAD:
                if self.stack[-1] is self.root:
                    self.stack.append(self.head)
                self._add(tag, found)
                return
            self._open_body()
        if tag in CLOSES_P:
            self._pop_to("p", SCOPE)
        if tag == "li":
            self._pop_to("li", LIST_SCOPE)
        elif tag in ("dd", "dt"):
            self._pop_to("dd") or self._pop_to("dt")
        elif tag in TABLE_PARTS:
            for part in TABLE_PARTS[tag]:
                self._pop_to(part, frozenset({"table"}))
        elif tag in ("option", "optgroup"):
            self._pop_to("option", frozenset({"select"}))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.stack.pop()
        if tag == "a":
            for e in [x for x in self.active if x.name == "a"]:
                self._end_formatting(e)
        if tag in FORMATTING or tag not in CLOSES_P:
            self._take_up()
        e = self._add(tag, found)
        if tag in FORMATTING:
            alike = [x for x in self.active if x.name == tag and x.attrs == found]
            if len(alike) >= 3:
                self.active = [x for x in self.active if x is not alike[0]]
            self.active.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _end_formatting(self, e: Element) -> None:
        self.active = [x for x in self.active if x is not e]
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i] is e:
                del self.stack[i:]
                return
            if self.stack[i].name in SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            if self.body is None:
                self.stack = [self.root]
            return
        if tag in ("body", "html"):
            return
        if self.body is None and tag in HEAD:
            self._pop_to(tag)
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p":
            if not self._pop_to("p"):
                self._open_body()
                self._add("p", {})
                self.stack.pop()
            return
        if tag in FORMATTING:
            for e in reversed(self.active):
                if e.name == tag:
                    self._end_formatting(e)
                    return
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            for i in range(len(self.stack) - 1, 1, -1):
                if self.stack[i].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    del self.stack[i:]
                    return
                if self.stack[i].name in SCOPE:
                    return
            return
        self._pop_to(tag, LIST_SCOPE if tag == "li" else SCOPE)

    def handle_data(self, data: str) -> None:
        if self.body is None and not self.stack[-1].name in HEAD:
            if not data.strip(" \t\n\f\r"):
                return
            self._open_body()
        if self.body is not None and self.stack[-1].name not in ("script", "style"):
            self._take_up()
        last = self.stack[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(text: str) -> Element:
    """The tree of a page; whatever the input, it has html, head and body."""
    b = Builder()
    b.feed(text.replace("\n", ""))
    b.close()
    b._open_body()
    return b.root


def looks_like_html(value: str) -> bool:
    """An attribute value that is itself markup with more than the implied elements."""
    if len(value.encode()) < 3 or "<" not in value or ">" not in value:
        return False
    if not any(c == "<" and value[i + 1 : i + 2].isalpha() and i + 2 < len(value) for i, c in enumerate(value)):
        return False
    todo, n = [parse(value)], 0
    while todo:
        e = todo.pop()
        n += 1
        todo += [c for c in e.children if isinstance(c, Element)]
    return n > 3


def cleaned(attrs: dict[str, str]) -> list[tuple[str, str]]:
    """Trimmed attributes, without those whose value is markup."""
    return [(k.strip(), v.strip()) for k, v in attrs.items() if not looks_like_html(v)]


def walk(root: Element, blocked: frozenset[str] = frozenset(BLOCKED)) -> Iterator[dict]:
    """Nodes in document order: path, kind, name, fields, hashed strings of the path and of the children."""
    def signature(node) -> str:
        return "text" if isinstance(node, str) else node.name + ":" + ",".join(sorted(k for k, _ in cleaned(node.attrs)))

    def kept(e: Element) -> list:
        return [c for c in e.children if (c.strip() if isinstance(c, str) else c.name not in blocked)]

    todo: list = [(root, (), (signature(root),))]
    while todo:
        node, path, line = todo.pop()
        if isinstance(node, str):
            yield {"path": path, "node_kind": "text", "name": "#text", "fields": [("text", node.strip())], "signatures": line, "child_signatures": []}
            continue
        below = kept(node)
        signs = [signature(c) for c in below]
        yield {"path": path, "node_kind": "element", "name": node.name, "fields": cleaned(node.attrs), "signatures": line, "child_signatures": signs}
        todo += [(c, (*path, i), (*line, s)) for (i, c), s in reversed(list(zip(enumerate(below), signs, strict=True)))]


def shape(root: Element, blocked: frozenset[str] = frozenset(BLOCKED)) -> str:
    """Deep hash of the tree without nodes whose lineage turns back on itself."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    below: dict[tuple, list[str]] = {}
    rows = list(walk(root, blocked))
    for r in reversed(rows):
        own = sha(r["signatures"][-1])
        deep = sha("".join(sorted([own, *below.pop(r["path"], [])])))
        if not r["path"]:
            return deep
        if r["signatures"][-1] not in r["signatures"][:-1]:
            below.setdefault(r["path"][:-1], []).append(deep)
    return ""


_RAW = "doc_id long, node_id string, parent_id string, ordinal int, depth int, path array<int>, node_kind string, name string, fields array<struct<key:string,value:string>>, signatures array<string>, child_signatures array<string>, shape_hash string, error string"


def as_rows(doc_id, nodes: list[dict], shape_hash: str | None, error: str | None = None) -> list[dict]:
    if error is not None:
        return [{"doc_id": doc_id, "path": [], "fields": [], "signatures": [], "child_signatures": [], "error": error}]
    out = []
    for n in nodes:
        p = n["path"]
        ids = ".".join(map(str, ("r", *p)))
        out.append(
            {"doc_id": doc_id, "node_id": ids, "parent_id": ids.rpartition(".")[0] or None, "ordinal": p[-1] if p else 0, "depth": len(p), "path": list(p), "node_kind": n["node_kind"], "name": n["name"],
             "fields": [{"key": k, "value": v} for k, v in n["fields"]], "signatures": list(n["signatures"]), "child_signatures": n["child_signatures"], "shape_hash": shape_hash, "error": None}
        )
    return out


def flattened(docs: DataFrame, parse_one, id_col: str, text_col: str) -> DataFrame:
    """The node table of documents that parse_one turns into (nodes, shape hash); failures give one row with error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(_RAW)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    if text is None or not text.strip():
                        raise ValueError("document is empty")
                    rows += as_rows(doc, *parse_one(text))
                except (ValueError, AssertionError, RecursionError) as e:
                    rows += as_rows(doc, [], None, str(e))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, kind)


def with_identity(nodes: DataFrame, origin: Column | None = None) -> DataFrame:
    """Adds hash, lineage_hashes, lineage, acyclic_lineage, is_cyclic and subgraph_hash natively."""
    out = nodes.withColumn("lineage_hashes", ident.lineage_hashes("signatures", origin)).withColumn("hash", F.element_at("lineage_hashes", -1))
    return out.withColumns(
        {
            "lineage": ident.lineage("lineage_hashes"),
            "acyclic_lineage": ident.acyclic_lineage("lineage_hashes"),
            "is_cyclic": ident.is_cyclic("lineage_hashes"),
            "subgraph_hash": ident.subgraph_hash("hash", F.transform("child_signatures", lambda s: F.sha2(s, 256))),
            "indexed_lineages": ident.indexed_lineages("path", "slice(lineage_hashes, 2, size(lineage_hashes))"),
        }
    )


def _page(text: str):
    root = parse(text)
    return list(walk(root)), shape(root)


def html_nodes(docs: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """The node table of pages, one row per element or text."""
    return flattened(docs, _page, id_col, text_col)
