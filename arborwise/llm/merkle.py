"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in native Spark functions.

A text is cut at newlines into paragraphs.  A paragraph's pieces end after words whose own hash
says so (one in four), so an edit changes the pieces it touches and no others.  A section ends
at a blank paragraph, before none but after a paragraph that starts with "#", and after a
paragraph whose hash says so (one in four), so that an edit moves no far border.

The fingerprint reads `root|section:paragraph=pieces,paragraph=pieces;section:...`.  The root is
SHA-256 over the sections' hashes, those over the paragraphs', those over the exact text: equal
roots mean equal texts, unequal branches lead to the edit (`differing`).

The likeness of two fingerprints is read from them alone, from the top: equal roots are alike;
equal sections count with all their pieces and are not looked into; of the other sections equal
paragraphs do; of the other paragraphs equal pieces.  It is the Dice coefficient of these
counts.

Defined results: null text counts as empty; an empty text has one empty paragraph, no pieces,
and likeness 1 to another empty one, 0 to anything else; texts without pieces are alike only if
equal; rows that repeat a doc_id follow each other by text; an empty table gives an empty result.
`fingerprints` keeps every column but one called fingerprint, which is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, fresh

#: Hexadecimal digits of a piece's hash in the fingerprint, and of a branch's.
LEAF, BRANCH = 6, 16
_FAN = 128


def with_tree(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the fingerprint of a text column; out replaces a column of that name."""
    p, e, s, h = (fresh(c, df) for c in ("paragraphs", "ends", "sections", "hashes"))
    kept = [c for c in df.columns if c != out]
    leaves = (
        r"transform(filter(transform(split(array_join(transform(split(l, ' '), w -> if(substring(md5(w), 1, 1) < '4', concat(w, '\u0001'), w)), ' '), '\u0001'), x -> trim(x)), x -> x <> ''), "
        f"x -> substring(md5(x), 1, {LEAF}))"
    )
    at = F.coalesce(F.col(column), F.lit(""))
    made = df.withColumn(p, F.split(at, "\n", -1))
    made = made.withColumn(p, F.expr(f"transform(`{p}`, l -> struct(sha2(l, 256) AS hash, array_join({leaves}, '') AS leaves, trim(l) = '' OR startswith(l, '#') AS ends))"))
    made = made.withColumn(e, F.expr(f"filter(sequence(1, size(`{p}`)), i -> i = size(`{p}`) or `{p}`[i - 1].ends or substring(`{p}`[i - 1].hash, 1, 1) < '4')"))
    part = f"slice(`{p}`, if(k = 0, 1, `{e}`[k - 1] + 1), `{e}`[k] - if(k = 0, 0, `{e}`[k - 1]))"
    made = made.withColumn(s, F.expr(f"transform(sequence(0, size(`{e}`) - 1), k -> {part})"))
    made = made.withColumn(h, F.expr(f"transform(`{s}`, s -> sha2(array_join(transform(s, p -> p.hash), ''), 256))"))
    told = f"transform(`{s}`, (s, k) -> concat(substring(`{h}`[k], 1, {BRANCH}), ':', array_join(transform(s, p -> concat(substring(p.hash, 1, {BRANCH}), '=', p.leaves)), ',')))"
    return made.select(*kept, F.expr(f"concat(sha2(array_join(`{h}`, ''), 256), '|', array_join({told}, ';'))").alias(out))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the likeness of two columns of fingerprints, from 0 to 1; out replaces a column of that name."""
    kept = [c for c in df.columns if c != out]
    sections, paragraphs, leaves = (fresh(c, df) for c in ("own_sections", "own_paragraphs", "own_leaves"))
    both = lambda x: f"array_intersect(`{x}`.a, `{x}`.b)"
    rest = lambda x, side: f"array_except(`{x}`.{side}, `{x}`.{'ab'[side == 'a']})"
    pair = lambda make: F.struct(*(F.expr(make(side)).alias(side) for side in "ab"))
    at = {"a": a, "b": b}
    made = df.withColumn(sections, pair(lambda side: f"array_distinct(split(substring_index(`{at[side]}`, '|', -1), ';'))"))
    made = made.withColumn(paragraphs, pair(lambda side: f"array_distinct(flatten(transform({rest(sections, side)}, s -> split(substring_index(s, ':', -1), ','))))"))
    made = made.withColumn(leaves, pair(lambda side: f"array_distinct(flatten(transform({rest(paragraphs, side)}, p -> regexp_extract_all(substring_index(p, '=', -1), '.{{{LEAF}}}', 0))))"))
    of_paragraph = f"(length(p) - {BRANCH + 1}) div {LEAF}"
    of_section = f"aggregate(split(substring_index(s, ':', -1), ','), 0L, (n, p) -> n + {of_paragraph})"
    alike = f"aggregate({both(sections)}, 0L, (n, s) -> n + {of_section}) + aggregate({both(paragraphs)}, 0L, (n, p) -> n + {of_paragraph})"
    made = made.withColumn(sections, F.struct(F.expr(alike).alias("n"), F.expr(f"size({both(leaves)})").alias("m"), F.expr(f"size(`{leaves}`.a) + size(`{leaves}`.b)").alias("rest")))
    same = F.substring_index(F.col(a), "|", 1) == F.substring_index(F.col(b), "|", 1)
    dice = f"if(2 * `{sections}`.n + `{sections}`.rest = 0, 0D, 2D * (`{sections}`.n + `{sections}`.m) / (2 * `{sections}`.n + `{sections}`.rest))"
    return made.select(*kept, F.when(same, 1.0).otherwise(F.expr(dice)).alias(out))


def differing(a: Column, b: Column) -> Column:
    """Places (from 0) of a's paragraphs whose branch b lacks; empty if the roots are equal."""
    paragraphs = lambda f: F.transform(F.regexp_extract_all(f, F.lit(f"([0-9a-f]{{{BRANCH}}})="), F.lit(1)), lambda h: h)
    own, other = paragraphs(a), paragraphs(b)
    lost = F.transform(own, lambda h, i: F.when(~F.array_contains(other, h), i))
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), F.array().cast("array<int>")).otherwise(F.array_compact(lost))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint."""
    own = fresh("own", docs)
    made = with_tree(docs, text_col, own)
    return made.select(*(c for c in docs.columns if c.lower() != "fingerprint"), F.col(own).alias("fingerprint"))


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are below value: chunks of _FAN at a time, from the coarsest level down; -1 for null."""
    levels = [np.array(bounds, np.int64)]
    while len(levels[-1]) > _FAN:
        levels.append(levels[-1][_FAN - 1 :: _FAN])
    at = F.lit(0)
    for level in reversed(levels if bounds else []):
        chunk = F.slice(F.lit(level), at * _FAN + 1, F.lit(_FAN))
        at = at * _FAN + F.size(F.filter(chunk, lambda x: x < value))
    return F.when(value.isNull(), -1).otherwise(at)


def with_next(docs: DataFrame, bytes_each: int = 32 << 20) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending doc_id, after the last that of the first.

    Ranges of doc_id of about bytes_each are ordered each on its own; the head of each also goes
    to the range above, as that one's end.  The driver holds a few numbers a range, no more.
    Nulls come last; equal ids go by text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = blocks_for(docs, bytes_each)
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit(np.arange(1, n) / n), min(20 * n, 1_000_000))).first()[0] if n > 1 else None
    bucket = _bucket(sorted(set(cuts or [])), F.col("doc_id"))
    heads = dict(sorted(docs.select("doc_id").groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("h")).collect()))
    if not heads:
        return docs.withColumn("next_text", F.col("text"))
    order = list(heads)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    span = range(-1, max(order) + 1)
    place = F.col("b") + 1
    given = F.get(F.lit(np.array([b in heads and heads[b] is not None for b in span])), place)
    head = F.when(given, F.get(F.lit(np.array([heads.get(b) or 0 for b in span], np.int64)), place))
    to = F.get(F.lit(np.array([above.get(b, 0) for b in span], np.int64)), place).cast("int")
    rows = docs.withColumn("b", bucket)
    own, halo = F.struct(F.col("b").alias("b"), F.lit(0).alias("halo")), F.struct(to.alias("b"), F.lit(1).alias("halo"))
    rows = rows.withColumn("at", F.explode(F.when(head.eqNullSafe(F.col("doc_id")), F.array(own, halo)).otherwise(F.array(own)))).select("doc_id", "text", "at.b", "at.halo")
    w = Window.partitionBy("b").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("halo = 0").drop("b", "halo")


def digest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for every document."""
    pairs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    pairs = pairs.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next_text", half)))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    made = with_tree(with_tree(with_tree(pairs, "text", "fingerprint"), "edited", "edited_fingerprint"), "next_text", "next_fingerprint")
    made = made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
    made = with_likeness(with_likeness(made, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return made.drop("next_fingerprint")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r FROM documents
), n AS (
  SELECT d.*, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS next_text FROM d
), k AS (
  SELECT r, 'own' AS kind, text FROM n UNION ALL SELECT r, 'next', next_text FROM n
  UNION ALL SELECT r, 'edited', left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) FROM n
), p AS (
  SELECT r, kind, text, list_transform(string_split(text, chr(10)), lambda l: {
    'hash': sha256(l), 'ends': trim(l) = '' OR starts_with(l, '#'),
    'leaves': array_to_string(list_transform(list_filter(list_transform(string_split(array_to_string(list_transform(string_split(l, ' '),
      lambda w: CASE WHEN substr(md5(w), 1, 1) < '4' THEN w || chr(1) ELSE w END), ' '), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: substr(md5(x), 1, 6)), '')}) AS p FROM k
), e AS (
  SELECT *, list_filter(range(1, len(p) + 1), lambda i: i = len(p) OR p[i].ends OR substr(p[i].hash, 1, 1) < '4') AS e FROM p
), s AS (
  SELECT r, kind, text, list_transform(range(1, len(e) + 1), lambda k: p[(CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END):(e[k])]) AS s FROM e
), h AS (
  SELECT *, list_transform(s, lambda x: sha256(array_to_string(list_transform(x, lambda y: y.hash), ''))) AS h FROM s
), f AS (
  SELECT r, kind, text, sha256(array_to_string(h, '')) AS root, list_transform(range(1, len(s) + 1), lambda k: substr(h[k], 1, 16) || ':' ||
    array_to_string(list_transform(s[k], lambda y: substr(y.hash, 1, 16) || '=' || y.leaves), ',')) AS s FROM h
), c AS (
  SELECT o.r, x.kind, o.root = x.root AS same, list_distinct(o.s) AS a, list_distinct(x.s) AS b FROM f o JOIN f x ON o.r = x.r AND o.kind = 'own' AND x.kind <> 'own'
), q AS (
  SELECT r, kind, same, list_filter(a, lambda s: list_contains(b, s)) AS cs,
    list_distinct(flatten(list_transform(list_filter(a, lambda s: NOT list_contains(b, s)), lambda s: string_split(split_part(s, ':', 2), ',')))) AS a,
    list_distinct(flatten(list_transform(list_filter(b, lambda s: NOT list_contains(a, s)), lambda s: string_split(split_part(s, ':', 2), ',')))) AS b FROM c
), t AS (
  SELECT r, kind, same, coalesce(list_sum(list_transform(cs, lambda s: list_sum(list_transform(string_split(split_part(s, ':', 2), ','), lambda p: (length(p) - 17) // 6)))), 0)
      + coalesce(list_sum(list_transform(list_filter(a, lambda p: list_contains(b, p)), lambda p: (length(p) - 17) // 6)), 0) AS n,
    list_distinct(flatten(list_transform(list_filter(a, lambda p: NOT list_contains(b, p)), lambda p: regexp_extract_all(split_part(p, '=', 2), '.{6}')))) AS a,
    list_distinct(flatten(list_transform(list_filter(b, lambda p: NOT list_contains(a, p)), lambda p: regexp_extract_all(split_part(p, '=', 2), '.{6}')))) AS b FROM q
), l AS (
  SELECT r, kind, CASE WHEN same THEN 1.0::DOUBLE WHEN 2 * n + len(a) + len(b) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * (n + len(list_filter(a, lambda x: list_contains(b, x)))) / (2 * n + len(a) + len(b))::DOUBLE END AS near FROM t
)
SELECT n.doc_id, CAST(length(n.text) AS BIGINT) AS n_chars, sha256(x.text) AS edited_sha256, o.root || '|' || array_to_string(o.s, ';') AS fingerprint,
       x.root || '|' || array_to_string(x.s, ';') AS edited_fingerprint, le.near AS near_edited, ln.near AS near_next
FROM n JOIN f o ON o.r = n.r AND o.kind = 'own' JOIN f x ON x.r = n.r AND x.kind = 'edited'
JOIN l le ON le.r = n.r AND le.kind = 'edited' JOIN l ln ON ln.r = n.r AND ln.kind = 'next'
"""
