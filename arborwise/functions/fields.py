"""Fields are an ordered multimap: array<struct<key string, value string>>, keys may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<key:string,value:string>>"
_TRIM = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def trim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, _TRIM, "")


def values(fields: str | Column, key: str | Column) -> Column:
    """All values of a key, in order."""
    f = F.col(fields) if isinstance(fields, str) else fields
    k = F.lit(key) if isinstance(key, str) else key
    return F.transform(F.filter(f, lambda x: x.key == k), lambda x: x.value)


def first_value(fields: str | Column, key: str | Column) -> Column:
    """The first value of a key, null if it has none."""
    return F.get(values(fields, key), F.lit(0))


def rename(fields: str | Column, source: Column, image: Column) -> Column:
    """(image, value) for each value of the source field."""
    f = F.col(fields) if isinstance(fields, str) else fields
    return F.transform(F.filter(f, lambda x: x.key == source), lambda x: F.struct(image.alias("key"), x.value.alias("value")))


def apply_transformations(fields: str, transformations: str) -> Column:
    """All renames of an array<struct<field, image>> in order; null where there are none."""
    out = F.expr(f"flatten(transform({transformations}, t -> transform(filter({fields}, f -> f.key = t.field), f -> named_struct('key', t.image, 'value', f.value))))")
    return F.when(F.size(transformations) > 0, out)


def source_field(spec: Column) -> Column:
    """TEXT -> text, ATTRIBUTE=x -> x, anything else null."""
    return F.when(spec == "TEXT", F.lit("text")).when(spec.startswith("ATTRIBUTE="), F.substring(spec, F.lit(11), F.length(spec)))


def exploded(nodes: DataFrame, *keep: str) -> DataFrame:
    """One row per field: the kept columns, pos, key and value."""
    return nodes.select(*keep, F.posexplode("fields").alias("pos", "f")).select(*keep, "pos", "f.key", "f.value")


def merged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Fields of all rows of a key as one multimap, in the given order; a repeated key stays."""
    item = F.struct(*order, F.struct("key", "value").alias("f"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.f).alias("fields"))


def url_ok(url: Column) -> Column:
    """http or https with a host."""
    scheme = F.try_parse_url(url, F.lit("PROTOCOL"))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.lower(scheme).isin("http", "https") & (host != ""), F.lit(False))


def shortened_url(url: Column, most: int = 30) -> Column:
    """The url with each query value of more than `most` characters cut to them and three dots."""
    base, query = F.substring_index(url, "?", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    rest = F.regexp_extract(url, r"(#.*)$", 1)
    cut = lambda p: F.when(
        F.length(F.regexp_extract(p, "^[^=]*=(.*)$", 1)) > most, F.concat(F.substring_index(p, "=", 1), F.lit("="), F.left(F.regexp_extract(p, "^[^=]*=(.*)$", 1), F.lit(most)), F.lit("..."))
    ).otherwise(p)
    return F.when(query == "", url).otherwise(F.concat(base, F.lit("?"), F.array_join(F.transform(F.split(query, "&"), cut), "&"), rest))


def shown_attribute(value: Column, most: int = 100) -> Column:
    """How an attribute value is shown: urls shortened, others cut, double quotes escaped."""
    return F.replace(F.when(url_ok(value), shortened_url(value)).otherwise(F.left(value, F.lit(most))), F.lit('"'), F.lit("&quot;"))


def escaped_xml(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def description(c: Column, most: int = 20) -> Column:
    return F.left(c, F.lit(most))
