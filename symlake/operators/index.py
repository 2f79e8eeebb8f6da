"""The index job: entries in, postings, super types and texts out; and the search flow over what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import extract as X
from symlake.operators.postings import match_counts
from symlake.operators.search import filtered_tree, outer_entries, symbol_search
from symlake.sources.classfile import class_symbols
from symlake.sources.classify import EXTRACTOR_RULES, classify

# Which extractors read text. What each posts is decided row by row, in one pass over the content.
TEXT_EXTRACTORS = ["text", "xml", "xml-based", "web.xml", "ejb-jar.xml", "service"]
CLASS_EXTRACTORS = ["class", "module-info"]


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes U+FFFD, so a file in another encoding is still searched."""
    return F.make_valid_utf8(content.cast("string"))


def _dotted(names: Column) -> Column:
    return F.transform(names, lambda s: F.translate(F.regexp_replace(s, r"^\s+|\s+$", ""), ".", "/"))


def text_symbols(routed: DataFrame) -> DataFrame:
    """Postings of all text extractors. Web and bean descriptors post their strings like any XML, and their type
    references besides."""
    rows = routed.filter(F.col("extractor").isin(TEXT_EXTRACTORS) & F.col("content").isNotNull()).withColumn(
        "text", as_text(F.col("content")))
    text, by = F.col("text"), F.col("extractor")
    beans = X.attribute_values(text, "bean", "class")
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: (s != "") & ~s.startswith("#"))
    marked_up = by.isin("xml", "xml-based", "web.xml", "ejb-jar.xml")
    skipped = F.when(by == "xml", beans).otherwise(F.array().cast("array<string>"))
    strings = F.when(marked_up, X.markup_tokens(text, skip_values=skipped))
    types = (F.when(by == "xml", _dotted(beans)).when(by == "service", _dotted(lines))
             .when(by == "web.xml", _dotted(X.path_values(text, X.WEB_TYPE_PATHS)))
             .when(by == "ejb-jar.xml", _dotted(X.path_values(text, X.EJB_TYPE_PATHS))))
    whole = F.when(by == "text", F.array(F.sha1(text)))
    return X.posts(rows, (m.STRINGS, strings), (m.TYPE_REFERENCES, types), (m.TEXTS, whole))


def index_entries(entries: DataFrame) -> dict[str, DataFrame]:
    """``postings, supertypes, texts`` of ``entries`` (see ``model.ENTRIES``). Every entry goes to the extractor its path
    and container select; text is read once and class files are read once."""
    routed = classify(entries, EXTRACTOR_RULES, out="extractor")
    symbols = class_symbols(routed.filter(F.col("extractor").isin(CLASS_EXTRACTORS)))
    classes = symbols.filter(F.col("tag") == "post").select(
        F.col("a").alias("index_name"), F.col("b").alias("key"), "container", "entry_path")
    packages = X.package_declarations(routed.filter(F.col("container_type") == "jmod"))
    supers = symbols.filter(F.col("tag") == "super").select(
        "container", F.col("a").alias("type_name"), F.col("b").alias("super_name"), F.col("c").alias("kind"))
    plain = routed.filter((F.col("extractor") == "text") & F.col("content").isNotNull()).select(
        as_text(F.col("content")).alias("text"))
    texts = plain.groupBy(F.sha1("text").alias("key")).agg(F.first("text").alias("text"))
    return {"postings": classes.unionByName(text_symbols(routed)).unionByName(packages), "supertypes": supers, "texts": texts}


def search_tree(entries: DataFrame, postings: DataFrame, roots: DataFrame, pattern: str, flags: int,
                texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One search from pattern to tree: the entries that match (inner classes at their outermost class) or lie above a
    match, and the number of matches per container and in total. On a stored index the index names prune partitions
    and a literal head of the pattern reaches the scan."""
    found = outer_entries(symbol_search(postings, pattern, flags, texts), roots)
    return filtered_tree(entries, found), match_counts(found)
