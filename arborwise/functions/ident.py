"""Structural hashes and lineages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(text: str | Column) -> Column:
    """SHA-256 of a string, lower-case hex."""
    return F.sha2(_c(text), 256)


def finalize(items: str | Column) -> Column:
    """Hash of an array of strings joined without a separator."""
    return digest(F.array_join(_c(items), ""))


def element_text(name: str | Column, attributes: str | Column) -> Column:
    """What an element's hash is taken of: its name and its sorted attribute names, not their values."""
    return F.concat(_c(name), F.lit(":"), F.array_join(F.array_sort(_c(attributes)), ","))


def object_text(keys: str | Column) -> Column:
    return F.concat(F.lit("object:"), F.array_join(F.array_sort(_c(keys)), ","))


def element_hash(name: str | Column, attributes: str | Column) -> Column:
    return digest(element_text(name, attributes))


def object_hash(keys: str | Column) -> Column:
    return digest(object_text(keys))


def text_hash() -> Column:
    return digest(F.lit("text"))


def lineage_hashes(signatures: str | Column, origin: str | Column | None = None) -> Column:
    """Hashes from the origin down to the node; signatures are the hashed strings of the path."""
    first = digest(F.coalesce(_c(origin), F.lit("")) if origin is not None else F.lit(""))
    return F.concat(F.array(first), F.transform(_c(signatures), lambda s: F.sha2(s, 256)))


def lineage(hashes: str | Column) -> Column:
    return finalize(hashes)


def acyclic_lineage(hashes: str | Column) -> Column:
    """The lineage of the first occurrences."""
    return finalize(F.array_distinct(_c(hashes)))


def is_cyclic(hashes: str | Column) -> Column:
    """The last hash occurs earlier in the lineage, too."""
    h = _c(hashes)
    return F.array_contains(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.element_at(h, -1))


def subgraph_hash(own: str | Column, children: str | Column) -> Column:
    """The children's hashes, sorted, and then the node's own."""
    return digest(F.concat(F.array_join(F.array_sort(_c(children)), ""), _c(own)))


def indexed_lineages(path: str, hashes: str) -> Column:
    """For each distance d from the node: the lineage from the node up to the root in which
    the node d steps up also carries its place among its siblings.  `path` holds the places
    below the root, `hashes` the nodes' hashes from the root on, without the origin."""
    at = "element_at({h}, -(i + 1))"
    place = "if(i = d and i < size({p}), sha2(cast(element_at({p}, -(i + 1)) as string), 256), '')"
    one = f"concat({place}, {at})".format(h=hashes, p=path)
    return F.expr(f"transform(sequence(0, size({hashes}) - 1), d -> sha2(array_join(transform(sequence(0, size({hashes}) - 1), i -> {one}), ''), 256))")


def basis_lineage(acyclic: str | Column, lineage_: str | Column, indexed: str | Column) -> Column:
    """Identity of a group: of the keys it has, null ones left out."""
    return finalize(F.array_compact(F.array(_c(acyclic), _c(lineage_), _c(indexed))))


def prompt_hash(system: str | Column, user: str | Column) -> Column:
    return digest(F.concat(_c(system), _c(user)))
