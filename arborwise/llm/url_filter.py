"""URL filter: allow and block rules in a trie over reversed host labels, then path segments.

A rule fits its host and every subdomain when the path starts with the rule's path.  Of the
rules that fit, the one with most host labels and then the longest path wins: that is the
deepest node a walk reaches.  A tie of one rule listed both ways goes to block.

The trie is broadcast only while the rules stay under `most_rules` and `most_chars`; larger
rule sets are joined instead, with the same answers: on the host's suffixes and the path's
whole segments to learn which lengths the rules there have, then on prefixes of these lengths.

Defined results: null urls and urls without "://" have an empty host and path and fit no
rule; a rule with an empty host or path fits any host or path; a rule with a null host, path
or verdict is left out; unmatched rows get the default verdict with a null rule; repeated rows
are judged each; empty tables give empty results; every column of the input is kept, whatever
it is called, but for those called host, path, rule or verdict, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: str) -> list[str]:
    """Parts that end in a slash, and what is left: /en/x -> /, en/, x."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class Trie:
    """hosts: label -> node from the last label on; each node may hold a trie of path segments."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.top: dict = {"next": {}, "paths": None}
        for host, path, verdict in rules:
            node = self.top
            for label in reversed(host.lower().split(".") if host else []):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            node["paths"] = node["paths"] or {"next": {}, "part": {}, "rule": None}
            at = node["paths"]
            whole, parts = host.lower() + path, segments(path)
            for s in parts:
                if not s.endswith("/"):  # a rule that ends within a segment
                    old = at["part"].get(s)
                    at["part"][s] = (whole, "block" if old and old[1] == "block" else verdict)
                    break
                at = at["next"].setdefault(s, {"next": {}, "part": {}, "rule": None})
            else:
                at["rule"] = (whole, "block" if at["rule"] and at["rule"][1] == "block" else verdict)

    @staticmethod
    def _deepest(at: dict, path: str) -> tuple[str, str] | None:
        best, i = at["rule"], 0
        while True:
            fits = [p for p in at["part"] if path.startswith(p, i)]
            if fits:
                best = at["part"][max(fits, key=len)]
            end = path.find("/", i)
            at = at["next"].get(path[i : end + 1]) if end >= 0 else None
            if at is None:
                return best
            best, i = at["rule"] or best, end + 1

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best, end = self.top, None, len(host)
        while node is not None:
            if node["paths"]:
                best = self._deepest(node["paths"], path) or best
            if end < 0 or not host:
                break
            dot = host.rfind(".", 0, end)
            node, end = node["next"].get(host[dot + 1 : end]), dot
        return best


def _walk(trie: Broadcast):
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for host, path in frames:
            found = [find(h, p) or (None, None) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return F.pandas_udf(run, "rule string, verdict string")


def _joined(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answers by equi-joins of the distinct (host, path) pairs' keys with the rules."""
    table = rules.select(F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    table = table.groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("rule_verdict") == "block").alias("first"), "rule_verdict"))["rule_verdict"].alias("rule_verdict"))
    # The whole segments of a rule's path, and the lengths that the rules below them have.
    stems = table.groupBy("rule_host", F.regexp_extract("rule_path", "(?s)^(.*/)", 1).alias("stem")).agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    pairs = df.select("host", "path").distinct()
    keys = pairs.withColumn("rule_host", F.explode(F.expr("concat(array(''), transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), -i, i), '.')))")))
    keys = keys.withColumn("stem", F.explode(F.expr("array_distinct(concat(array(''), transform(filter(sequence(1, greatest(length(path), 1)), i -> substring(path, i, 1) = '/'), i -> left(path, i))))")))
    keys = keys.join(stems, ["rule_host", "stem"]).withColumn("n", F.explode("lengths")).where("n <= length(path)").select("host", "path", "rule_host", F.expr("left(path, n)").alias("rule_path"))
    depth = F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\.")))
    hit = keys.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(depth.alias("d"), F.length("rule_path").alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
    best = fresh("best", df)
    out = df.join(hit.withColumnRenamed("best", best), ["host", "path"], "left")
    return out.withColumns({"rule": F.col(best)["rule"], "verdict": F.col(best)["rule_verdict"]}).drop(best)


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url_col: str = "url", default: str = "allow", most_rules: int = 200_000, most_chars: int = 1 << 24) -> DataFrame:
    """df with host, path, rule and verdict; rules are (host, path, allow or block)."""
    spark, url = df.sparkSession, F.col(url_col).cast("string")
    out = df.withColumns({"host": host_of(url), "path": path_of(url)})
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        n, chars = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
        few = [tuple(r) for r in rules.collect()] if n <= most_rules and chars <= most_chars else None
    else:
        rules = [r for r in rules if None not in r]
        few = rules if len(rules) <= most_rules and sum(len(h) + len(p) for h, p, _ in rules) <= most_chars else None
        rules = rules if few is not None else spark.createDataFrame(rules, "host string, path string, verdict string")
    if few is not None:
        hit = fresh("hit", out)
        out = out.withColumn(hit, _walk(spark.sparkContext.broadcast(Trie(few)))(F.col("host"), F.col("path")))
        out = out.withColumns({"rule": F.col(hit)["rule"], "verdict": F.col(hit)["verdict"]}).drop(hit)
    else:
        out = _joined(out, rules)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                        ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, rv)
), f AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)
"""
