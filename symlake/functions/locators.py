"""Locator strings: ``scheme://outer!/inner?query#type-name-descriptor``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from symlake.functions.names import _col


def parse_fragment(c) -> Column:
    """Struct ``type, name, descriptor, malformed``. A single dash is malformed; no dash is a bare type."""
    c = _col(c)
    pieces = F.split(c, "-", -1)
    n = F.size(pieces)
    member = n >= 3
    return F.struct(
        F.when(n == 2, F.lit(None)).otherwise(F.element_at(pieces, 1)).alias("type"),
        F.when(member, F.array_join(F.slice(pieces, F.lit(2), F.greatest(n - 2, F.lit(1))), "-")).alias("name"),
        F.when(member, F.element_at(pieces, -1)).alias("descriptor"),
        (n == 2).alias("malformed"),
    )


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def parse_query(c) -> Column:
    """Query string to MAP: values are url-decoded, a missing ``=`` gives ``''``, the last duplicate wins."""
    items = F.filter(F.split(F.coalesce(_col(c), F.lit("")), "&"), lambda x: x != "")
    pairs = F.transform(items, lambda x: F.struct(
        _decoded(F.substring_index(x, "=", 1)).alias("k"),
        F.when(x.contains("="), _decoded(F.substring(x, F.instr(x, "=") + 1, F.length(x))))
        .otherwise("").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def parse_locator(c) -> Column:
    """Struct ``scheme, containers, path, params, fragment``; ``containers`` lists the ``!`` chain."""
    c = _col(c)
    hash_at = F.instr(c, "#")
    fragment = F.when(hash_at > 0, F.substring(c, hash_at + 1, F.length(c)))
    bare = F.substring_index(c, "#", 1)
    mark_at = F.instr(bare, "?")
    query = F.when(mark_at > 0, F.substring(bare, mark_at + 1, F.length(bare)))
    target = F.substring_index(bare, "?", 1)
    scheme_at = F.instr(target, "://")
    body = F.when(scheme_at > 0, F.substring(target, scheme_at + 3, F.length(target))).otherwise(target)
    chain = F.split(body, "!", -1)
    return F.struct(
        F.when(scheme_at > 0, F.substring(target, F.lit(1), scheme_at - 1)).alias("scheme"),
        F.slice(chain, F.lit(1), F.size(chain) - 1).alias("containers"),
        F.element_at(chain, -1).alias("path"),
        parse_query(query).alias("params"),
        fragment.alias("fragment"),
    )


def build_locator(container, path, query=None, fragment=None) -> Column:
    """``container!/path[?query][#fragment]``; null query or fragment is left out."""
    none = F.lit(None).cast("string")
    query = none if query is None else _col(query)
    fragment = none if fragment is None else _col(fragment)
    return F.concat(_col(container), F.lit("!/"), _col(path),
                    F.coalesce(F.concat(F.lit("?"), query), F.lit("")),
                    F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))
