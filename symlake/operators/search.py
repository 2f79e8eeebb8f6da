"""Symbol search, type search, trees of matches and highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake import model as m
from symlake.functions.names import innermost_name, simple_name
from symlake.functions.patterns import camel_match, find_regex, glob_match, scope_match
from symlake.operators.text import range_hits

# Indexes behind each search flag as (flag, declarations, references, match on innermost name).
SEARCH_INDEXES = [
    (m.SEARCH_TYPE, m.TYPE_DECLARATIONS, m.TYPE_REFERENCES, True),
    (m.SEARCH_CONSTRUCTOR, m.CONSTRUCTOR_DECLARATIONS, m.CONSTRUCTOR_REFERENCES, True),
    (m.SEARCH_METHOD, m.METHOD_DECLARATIONS, m.METHOD_REFERENCES, False),
    (m.SEARCH_FIELD, m.FIELD_DECLARATIONS, m.FIELD_REFERENCES, False),
    (m.SEARCH_STRING, m.STRINGS, m.STRINGS, False),
    (m.SEARCH_MODULE, m.MODULE_DECLARATIONS, m.MODULE_REFERENCES, False),
]


def _wanted(flags: int) -> tuple[list[str], list[str]]:
    by_name: set[str] = set()
    by_key: set[str] = set()
    for flag, declared, referenced, innermost in SEARCH_INDEXES:
        if flags & flag:
            target = by_name if innermost else by_key
            if flags & m.SEARCH_DECLARATION:
                target.add(declared)
            if flags & m.SEARCH_REFERENCE:
                target.add(referenced)
    return sorted(by_name), sorted(by_key)


def symbol_matches(postings: DataFrame, pattern: str, flags: int, texts: DataFrame | None = None) -> DataFrame:
    """Posting rows whose symbol matches. ``index_name IN (...)`` prunes partitions of a stored index. With ``texts(key,
    text)`` a search for strings also finds the whole texts that match."""
    by_name, by_key = _wanted(flags)
    if pattern == "" or not (by_name or by_key):
        return postings.limit(0)
    index = F.col("index_name")
    hit: Column | None = None
    if by_name:
        name = innermost_name("key")
        # A one-character literal needs a non-empty innermost name; the wildcards take every key.
        hit = index.isin(by_name) & glob_match(name, pattern)
    if by_key:
        other = index.isin(by_key) & glob_match("key", pattern)
        hit = other if hit is None else hit | other
    found = postings.filter(index.isin(by_name + by_key)).filter(hit)
    if texts is None or not flags & m.SEARCH_STRING:
        return found
    keys = texts.filter(glob_match("text", pattern)).select("key")
    return found.unionByName(postings.filter(index == m.TEXTS).join(keys, "key", "left_semi").select(*postings.columns))


def symbol_search(postings: DataFrame, pattern: str, flags: int, texts: DataFrame | None = None) -> DataFrame:
    """Distinct entries with a matching symbol in any of the wanted indexes."""
    return symbol_matches(postings, pattern, flags, texts).select("container", "entry_path").distinct()


def open_type(postings: DataFrame, pattern: str, limit: int = 80) -> DataFrame:
    """Best ``limit`` declared types for a camel-case pattern, by short name then full name, with the number of
    locations and the first one. The limit is a top-k over the aggregated names, not over rows."""
    declared = postings.filter(F.col("index_name") == m.TYPE_DECLARATIONS)
    hits = declared.filter(camel_match(innermost_name("key"), pattern))
    merged = (
        hits.select("key", "container", "entry_path").distinct()
        .groupBy(F.col("key").alias("type_name"))
        .agg(F.count(F.lit(1)).alias("n_locations"),
             F.min(F.struct("container", "entry_path")).alias("first"))
    )
    return (
        merged.withColumn("short_name", simple_name("type_name"))
        .orderBy("short_name", "type_name").limit(limit)
        .select("short_name", "type_name", "n_locations",
                F.col("first.container").alias("first_container"),
                F.col("first.entry_path").alias("first_entry"))
    )


def find_keys(postings: DataFrame, wanted: DataFrame, index_name: str | None = None) -> DataFrame:
    """Postings of the keys in ``wanted(key)``: the bulk form of an exact lookup."""
    if index_name is not None:
        postings = postings.filter(F.col("index_name") == index_name)
    return postings.join(wanted.select("key").distinct(), "key", "left_semi")


def outer_entries(matches: DataFrame, roots: DataFrame, types_only: bool = False) -> DataFrame:
    """Replace inner-class entries by the entry of their outermost class.

    ``roots(container, entry_path, root_entry)`` has one row per class entry. Entries that are not classes stay,
    unless ``types_only``.
    """
    how = "inner" if types_only else "left"
    return (
        matches.select("container", "entry_path").distinct()
        .join(roots.select("container", "entry_path", "root_entry"), ["container", "entry_path"], how)
        .select("container", F.coalesce("root_entry", "entry_path").alias("entry_path"))
        .distinct()
    )


def ancestor_paths(path: Column) -> Column:
    """All prefixes of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def filtered_tree(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Entries that match or lie above a match."""
    keep = (
        matches.select("container", F.explode(ancestor_paths(F.col("entry_path"))).alias("entry_path")).distinct()
    )
    return entries.join(keep, ["container", "entry_path"], "left_semi")


def highlight(occurrences: DataFrame, pattern: str, flags: str, scope: str | None = None) -> DataFrame:
    """Ranges to mark in each entry.

    ``flags``: ``d`` declarations, ``r`` references, ``t`` types, ``c`` constructors, ``f`` fields, ``m``
    methods, ``M`` modules, ``s`` strings. ``occurrences`` has ``role`` (declaration, reference, string),
    ``kind`` (type, field, method, module), ``type_name``, ``name``, ``owner``, ``start``, ``end`` and, for strings, ``text``. A method
    called ``<init>`` counts as a method and as a constructor.
    """
    role, kind, name = F.col("role"), F.col("kind"), F.col("name")
    ctor = (kind == "method") & (name == "<init>")
    by_type: Column = F.lit(False)
    by_name: Column = F.lit(False)
    if "t" in flags:
        by_type = by_type | (kind == "type")
    if "c" in flags:
        by_type = by_type | ctor
    if "f" in flags:
        by_name = by_name | (kind == "field")
    if "m" in flags:
        by_name = by_name | (kind == "method")
    if "M" in flags:
        by_name = by_name | (kind == "module")
    roles = [r for f, r in (("d", "declaration"), ("r", "reference")) if f in flags]
    scoped = F.when(role == "declaration", scope_match(scope, "type_name")).otherwise(scope_match(scope, "owner"))
    hit = (by_type & _anchored(innermost_name("type_name"), pattern)) | (by_name & _anchored(name, pattern))
    cols = ["container", "entry_path", "start", "end"]
    symbols = occurrences.filter(role.isin(roles) & scoped & hit).select(*cols)
    if "s" not in flags:
        return symbols.distinct()
    texts = occurrences.filter((role == "string") & scope_match(scope, "owner"))
    inside = range_hits(texts, ["container", "entry_path", "start"], "text", find_regex(pattern))
    strings = inside.select("container", "entry_path", (F.col("start") + F.col("hit_start")).alias("start"),
                            (F.col("start") + F.col("hit_end")).alias("end"))
    return symbols.unionByName(strings).distinct()


def _anchored(c: Column, pattern: str) -> Column:
    """Marking has no one-character special case: the pattern and any continuation."""
    from symlake.functions.patterns import glob_regex

    return c.rlike(glob_regex(pattern, prefix=True))
