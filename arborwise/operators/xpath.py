"""The XPath subset of the data model: parser, printer and compiler to joins and windows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import trim
from . import tree


@dataclass(frozen=True)
class Predicate:
    kind: str  # position, last, equals, present, contains, starts-with
    names: tuple[str, ...] = ()
    value: str = ""
    n: int = 0


@dataclass(frozen=True)
class Segment:
    axis: str
    test: str
    predicates: tuple[Predicate, ...] = field(default=())


class XPathError(ValueError):
    pass


_QUOTED = r"""(?:'([^']*)'|"([^"]*)")"""


def _split(text: str) -> list[str]:
    """Parts between slashes that stand outside of quotes and brackets."""
    out, part, quote, depth = [], "", "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        if c == "/" and not quote and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _predicate(text: str) -> Predicate:
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return Predicate("position", n=int(text))
    if text == "last()":
        return Predicate("last")
    if m := re.fullmatch(rf"(contains|starts-with)\(\s*@([\w:.-]+)\s*,\s*{_QUOTED}\s*\)", text):
        return Predicate(m[1], (m[2],), m[3] if m[3] is not None else m[4])
    if m := re.fullmatch(rf"@([\w:.-]+)\s*=\s*{_QUOTED}", text):
        return Predicate("equals", (m[1],), m[2] if m[2] is not None else m[3])
    names = [p.strip() for p in text.split(" and ")] if text else []
    if all(re.fullmatch(r"@[\w:.-]+", p) for p in names):
        return Predicate("present", tuple(p[1:] for p in names))
    raise XPathError(f"predicate [{text}]")


def _segment(text: str) -> Segment:
    text = text.strip()
    parts = re.match(r"([^\[]*)((?:\[.*\])?)$", text, re.S)
    if not parts:
        raise XPathError(f"step {text!r}")
    body, marks = parts.groups()
    body = body.strip()
    axis, test = body.split("::", 1) if "::" in body else {".": ("self", "node()"), "..": ("parent", "node()")}.get(body, ("child", body))
    if axis not in tree.AXES or not test:
        raise XPathError(f"step {text!r}")
    inner = re.findall(r"""\[((?:[^\[\]'"]|'[^']*'|"[^"]*")*)\]""", marks)
    if "".join(f"[{p}]" for p in inner) != marks:
        raise XPathError(f"step {text!r}")
    return Segment(axis, test, tuple(_predicate(p) for p in inner))


def parse(text: str) -> tuple[Segment, ...]:
    """Segments of a path; // is a descendant step, a leading slash means nothing."""
    text = text.strip()
    if not text:
        raise XPathError("empty path")
    parts, out, deep = _split(text), [], False
    for i, p in enumerate(parts):
        if not p.strip():
            deep = deep or i > 0
            continue
        s = _segment(p)
        out.append(Segment("descendant", s.test, s.predicates) if deep and s.axis == "child" else s)
        deep = False
    if not out:
        raise XPathError("empty path")
    return tuple(out)


def show(path: tuple[Segment, ...]) -> str:
    """Text that parses to the same path."""
    out = []
    for s in path:
        step = s.test if s.axis == "child" else f"{s.axis}::{s.test}"
        for p in s.predicates:
            q = '"' if "'" in p.value else "'"
            step += "[" + {
                "position": str(p.n), "last": "last()", "equals": f"@{p.names[0]}={q}{p.value}{q}" if p.names else "", "present": " and ".join("@" + n for n in p.names),
                "contains": f"contains(@{p.names[0]}, {q}{p.value}{q})" if p.names else "", "starts-with": f"starts-with(@{p.names[0]}, {q}{p.value}{q})" if p.names else "",
            }[p.kind] + "]"
        out.append(step)
    return "/".join(out)


def _holds(p: Predicate) -> Column:
    value = lambda n: F.expr("get(filter(fields, f -> f.key = '%s'), 0).value" % n.replace("\\", "\\\\").replace("'", "\\'"))
    if p.kind == "present":
        out = F.lit(True)
        for n in p.names:
            out &= value(n).isNotNull()
        return out
    v = trim(value(p.names[0]))
    found = {"equals": v == p.value.strip(), "contains": v.contains(p.value), "starts-with": v.startswith(p.value)}[p.kind]
    return F.coalesce(found, F.lit(False))


def step(contexts: DataFrame, nodes: DataFrame, s: Segment) -> DataFrame:
    """One segment: (doc_id, ctx, node_id, pos), ctx being the context's own number."""
    aimed = nodes
    if s.axis not in ("self", "parent") and s.test not in ("*", "node()"):
        aimed = nodes.where(F.col("name") == ("#text" if s.test == "text()" else s.test))
    elif s.test == "*" and s.axis not in ("self", "parent"):
        aimed = nodes.where(F.col("name") != "#text")
    order = ["o1", "o2", "o3", "node_id"]
    found = tree.step(contexts, nodes, s.axis, aimed)
    found = found.join(aimed.select("doc_id", "node_id", "fields"), ["doc_id", "node_id"])
    for p in s.predicates:
        if p.kind in ("position", "last"):
            way = [F.col(c).desc() for c in order] if p.kind == "last" else order
            w = Window.partitionBy("doc_id", "ctx").orderBy(*way)
            found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == (p.n if p.kind == "position" else 1)).drop("_n")
        else:
            found = found.where(_holds(p))
    w = Window.partitionBy("doc_id", "ctx").orderBy(*order)
    return found.withColumn("pos", F.row_number().over(w)).select("doc_id", "ctx", "node_id", "pos")


def evaluate(starts: DataFrame, nodes: DataFrame, path: str | tuple[Segment, ...], single: bool = False) -> DataFrame:
    """(doc_id, start_id, node_id): what a path leads to from each start (doc_id, node_id); no row where it leads nowhere.

    The number of a context is the way that led to it, so positions count within one context
    node and nodes reached twice stay twice.  single: more than one result of a start is an error.
    """
    path = parse(path) if isinstance(path, str) else path
    now = starts.select("doc_id", F.col("node_id").alias("start_id"), F.col("node_id").cast("string").alias("ctx"), "node_id")
    for s in path:
        ways = now.select("doc_id", "ctx", "start_id")
        hit = step(now, nodes, s)
        now = hit.join(ways, ["doc_id", "ctx"]).select("doc_id", "start_id", F.concat_ws("/", "ctx", F.col("pos").cast("string")).alias("ctx"), "node_id")
    if single:
        w = Window.partitionBy("doc_id", "start_id")
        now = now.withColumn("_n", F.count("*").over(w)).withColumn("node_id", F.when(F.col("_n") > 1, F.raise_error(F.lit("path leads to more than one node")).cast("string")).otherwise(F.col("node_id")))
    return now.select("doc_id", "start_id", "node_id")


def of_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, xpath): names from the root down, a position from the second of a name on."""
    placed = tree.with_places(nodes)
    part = F.when(F.col("name") == "#text", F.lit("text()")).otherwise(F.when(F.col("index_by_name") > 0, F.concat("name", F.lit("["), (F.col("index_by_name") + 1).cast("string"), F.lit("]"))).otherwise(F.col("name")))
    parts = placed.select("doc_id", F.expr(tree.path_key("path")).alias("up_key"), part.alias("part"))
    ups = tree.with_ancestors(nodes.select("doc_id", "node_id", "path"), or_self=True)
    hit = ups.join(parts, (ups.doc_id == parts.doc_id) & (ups.up == parts.up_key))
    item = F.struct((-F.col("distance")).alias("d"), "part")
    return hit.groupBy(ups.doc_id, "node_id").agg(F.concat(F.lit("/"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.part), "/")).alias("xpath"))
