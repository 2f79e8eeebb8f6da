"""From entry content to posting rows. Everything runs inside the scan stage, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlake import model as m
from symlake.operators.search import ancestor_paths

# Pieces of XML or HTML text.
TAG = r"""<[A-Za-z_](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
COMMENT = r"(?s)<!--(.*?)-->"
CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"
INSTRUCTION = r"(?s)<\?(?!xml[\s?])([A-Za-z_][\w:.-]*)\s*(.*?)\?>"
DECLARATION = r"(?s)<\?xml\s(.*?)\?>"
NOT_TEXT = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Za-z][^>]*>|</[^<>]*>|" + TAG

# Predefined entities, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]

# Type references of deployment descriptors.
WEB_TYPE_PATHS = ["web-app/filter/filter-class", "web-app/listener/listener-class", "web-app/servlet/servlet-class"]

# File references of web descriptors.
WEB_FILE_PATHS = [
    "web-app/jsp-config/taglib/taglib-location",
    "web-app/welcome-file-list/welcome-file",
    "web-app/login-config/form-login-config/form-login-page",
    "web-app/login-config/form-login-config/form-error-page",
    "web-app/jsp-config/jsp-property-group/include-prelude",
    "web-app/jsp-config/jsp-property-group/include-coda",
]

# Type references of bean descriptors.
EJB_TYPE_PATHS = [
    "ejb-jar/assembly-descriptor/application-exception/exception-class",
    "ejb-jar/assembly-descriptor/interceptor-binding/interceptor-class",
    "ejb-jar/enterprise-beans/entity/home",
    "ejb-jar/enterprise-beans/entity/remote",
    "ejb-jar/enterprise-beans/entity/ejb-class",
    "ejb-jar/enterprise-beans/entity/prim-key-class",
    "ejb-jar/enterprise-beans/message-driven/ejb-class",
    "ejb-jar/enterprise-beans/message-driven/messaging-type",
    "ejb-jar/enterprise-beans/message-driven/resource-ref/injection-target/injection-target-class",
    "ejb-jar/enterprise-beans/message-driven/resource-env-ref/injection-target/injection-target-class",
    "ejb-jar/enterprise-beans/session/home",
    "ejb-jar/enterprise-beans/session/local",
    "ejb-jar/enterprise-beans/session/remote",
    "ejb-jar/enterprise-beans/session/business-local",
    "ejb-jar/enterprise-beans/session/business-remote",
    "ejb-jar/enterprise-beans/session/service-endpoint",
    "ejb-jar/enterprise-beans/session/ejb-class",
    "ejb-jar/enterprise-beans/session/ejb-ref/home",
    "ejb-jar/enterprise-beans/session/ejb-ref/remote",
    "ejb-jar/interceptors/interceptor/around-invoke/class",
    "ejb-jar/interceptors/interceptor/ejb-ref/home",
    "ejb-jar/interceptors/interceptor/ejb-ref/remote",
    "ejb-jar/interceptors/interceptor/interceptor-class",
]


def posts(df: DataFrame, *indexes: tuple[str, Column]) -> DataFrame:
    """Posting rows for arrays of keys per entry, ``(index_name, keys)`` each; null and empty keys are dropped.

    Keys are made distinct inside the row. With one row per entry, as every source delivers, the result is distinct
    without a shuffle; ``postings.build_postings`` covers anything else.
    """

    def tagged(name: str, keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(name).alias("index_name"), k.alias("key")))

    pairs = [tagged(name, keys) for name, keys in indexes]
    # A null array (no text) must not swallow the others.
    none = F.array().cast("array<struct<index_name:string,key:string>>")
    every = F.concat(*[F.coalesce(p, none) for p in pairs])
    return (
        df.select(F.explode(every).alias("p"), "container", "entry_path")
        .select("p.index_name", "p.key", "container", "entry_path")
        .filter(F.col("key").isNotNull() & (F.col("key") != ""))
    )


def text_postings(entries: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Whole-text symbols, in an index of their own: the posting key is the SHA-1 of the text, which no pattern is
    compared with. The second table maps it back, once per distinct text, so equal files store their text once;
    ``search.symbol_matches`` takes it to look into texts."""
    keyed = entries.select("container", "entry_path", F.sha1(F.col(text)).alias("key"), F.col(text).alias("text"))
    rows = keyed.filter(F.col("key").isNotNull()).select(
        F.lit(m.TEXTS).alias("index_name"), "key", "container", "entry_path")
    return rows, keyed.groupBy("key").agg(F.first("text").alias("text"))


def unescape(c: Column) -> Column:
    for entity, ch in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return c


def _all(c: Column, regex: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(regex), group)


def markup_tokens(text: Column, skip_values: Column | None = None) -> Column:
    """Array of the strings of one XML or HTML text: element and attribute names, attribute values, processing
    instructions, comments and trimmed character data. ``skip_values`` are attribute values to leave out."""
    bare = F.regexp_replace(text, NOT_TEXT, "\u0001")
    tags = _all(F.regexp_replace(text, COMMENT + "|" + CDATA, ""), TAG, 0)
    local = lambda n: F.substring_index(n, ":", -1)
    element = F.transform(tags, lambda t: local(F.regexp_extract(t, r"^<([\w:.-]+)", 1)))
    attrs = F.flatten(F.transform(tags, lambda t: _all(t, ATTRIBUTE, 0)))
    names = F.transform(attrs, lambda a: local(F.regexp_extract(a, r"^([\w:.-]+)", 1)))
    values = F.transform(attrs, lambda a: unescape(F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']$""", 1)))
    if skip_values is not None:
        values = F.array_except(values, skip_values)
    texts = F.transform(F.split(bare, "\u0001"), lambda t: unescape(F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))))
    trimmed = lambda arr: F.transform(arr, lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.filter(F.array_distinct(F.concat(
        element, F.filter(names, lambda n: n != "xmlns"), values, texts,
        trimmed(_all(text, COMMENT, 1)), trimmed(_all(text, CDATA, 1)),
        _declared(text), _all(text, INSTRUCTION, 1), trimmed(_all(text, INSTRUCTION, 2)))),
        lambda t: t.isNotNull() & (t != ""))


def _declared(text: Column) -> Column:
    """Version and encoding of the XML declaration."""
    inner = F.regexp_extract(text, DECLARATION, 1)
    pairs = F.filter(_all(inner, ATTRIBUTE, 0), lambda a: a.rlike("^(?:version|encoding)"))
    return F.transform(pairs, lambda a: F.regexp_extract(a, r"""["'](.*)["']$""", 1))


def attribute_values(text: Column, element: str, attribute: str) -> Column:
    """Values of ``<element ... attribute="...">``, in either kind of quotes; a prefix of the element does not count."""
    regex = rf"""(?s)<\s*(?:[\w.-]+:)?{element}\s(?:[^<>]*?\s)?{attribute}\s*=\s*(?:"[^"]*"|'[^']*')"""
    quoted = r"""(?s)(?:"([^"]*)"|'([^']*)')$"""
    return F.transform(_all(text, regex, 0), lambda a: F.concat(F.regexp_extract(a, quoted, 1), F.regexp_extract(a, quoted, 2)))


def markup_postings(entries: DataFrame, text: str = "text") -> DataFrame:
    return posts(entries, (m.STRINGS, markup_tokens(F.col(text))))


def attribute_refs(entries: DataFrame, element: str, attribute: str, text: str = "text",
                   index_name: str = m.TYPE_REFERENCES) -> DataFrame:
    """One posting per distinct attribute value, as written."""
    return posts(entries, (index_name, attribute_values(F.col(text), element, attribute)))


def bean_postings(entries: DataFrame, text: str = "text") -> DataFrame:
    """XML with bean definitions: ``bean@class`` becomes a type reference and is not a string."""
    col = F.col(text)
    classes = attribute_values(col, "bean", "class")
    types = F.transform(classes, lambda c: F.translate(F.trim(c), ".", "/"))
    return posts(entries, (m.STRINGS, markup_tokens(col, skip_values=classes)), (m.TYPE_REFERENCES, types))


def line_refs(entries: DataFrame, text: str = "text", index_name: str = m.TYPE_REFERENCES,
              comment: str = "#", internal: bool = False) -> DataFrame:
    """One reference per line; blank lines and lines that start with the comment sign are skipped. ``internal``
    turns dotted names into internal ones."""
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith(comment))
    return posts(entries, (index_name, F.transform(kept, lambda s: F.translate(s, ".", "/")) if internal else kept))


def service_refs(entries: DataFrame, text: str = "text") -> DataFrame:
    """Provider files: dotted names become internal type names."""
    return line_refs(entries, text, internal=True)


def _schema_of(tree: dict) -> T.DataType:
    return T.StructType([
        T.StructField(name, T.ArrayType(_schema_of(sub) if sub else T.StringType())) for name, sub in tree.items()])


def _path_tree(paths: list[str]) -> dict:
    tree: dict = {}
    for p in paths:
        node = tree
        for step in p.split("/")[1:]:
            node = node.setdefault(step, {})
    return tree


def _at(node: Column, steps: list[str]) -> Column:
    none = F.array().cast("array<string>")
    items = node.getField(steps[0])
    if len(steps) == 1:
        return F.coalesce(items, none)
    return F.coalesce(F.flatten(F.transform(items, lambda x: _at(x, steps[1:]))), none)


def path_values(text: Column, paths: list[str]) -> Column:
    """Trimmed texts at fixed element paths of an XML document; all paths share the root element.

    The document is parsed once for all paths. Malformed text gives an empty array instead of an error, document
    type declarations are cut off so that nothing is looked up outside, and namespaces are ignored.
    """
    root = paths[0].split("/")[0]
    bare = F.regexp_replace(text, r"(?s)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", "")
    parsed = F.from_xml(bare, _schema_of(_path_tree(paths)),
                        {"mode": "PERMISSIVE", "ignoreNamespace": "true", "rowTag": root})
    found = F.concat(*[_at(parsed, p.split("/")[1:]) for p in paths])
    is_root = F.regexp_extract(bare, r"<([A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 2) == root
    clean = F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.when(is_root & parsed.isNotNull(), clean).otherwise(F.array().cast("array<string>"))


def spread(entries: DataFrame) -> DataFrame:
    """``entries`` in as many tasks as keep all cores busy: parsing costs far more than the few bytes that make a scan
    task, and adaptive execution keeps an explicit number."""
    return entries.repartition(4 * entries.sparkSession.sparkContext.defaultParallelism)


def path_type_refs(entries: DataFrame, paths: list[str], text: str = "text") -> DataFrame:
    return posts(spread(entries.select("container", "entry_path", text)), (m.TYPE_REFERENCES,
                           F.transform(path_values(F.col(text), paths), lambda s: F.translate(s, ".", "/"))))


def web_type_refs(entries: DataFrame, text: str = "text") -> DataFrame:
    return path_type_refs(entries, WEB_TYPE_PATHS, text)


def ejb_type_refs(entries: DataFrame, text: str = "text") -> DataFrame:
    return path_type_refs(entries, EJB_TYPE_PATHS, text)


def join_paths(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """``refs(container, entry_path, ref)`` with ``target_path``: the entry of the same container at that path,
    null when there is none. One leading slash is ignored."""
    known = entries.select("container", F.col("entry_path").alias("target_path")).distinct()
    wanted = refs.withColumn("target_path", F.regexp_replace("ref", "^/", ""))
    return wanted.join(known.withColumn("_known", F.lit(True)), ["container", "target_path"], "left").select(
        *refs.columns, F.when(F.col("_known"), F.col("target_path")).alias("target_path"))


def web_file_refs(entries: DataFrame, all_entries: DataFrame, text: str = "text") -> DataFrame:
    refs = spread(entries.select("container", "entry_path", text)).select("container", "entry_path",
                          F.explode(F.array_distinct(path_values(F.col(text), WEB_FILE_PATHS))).alias("ref"))
    return join_paths(refs.filter(F.col("ref") != ""), all_entries)


def manifest_entrypoints(entries: DataFrame, text: str = "text") -> DataFrame:
    """``(container, entry_path, attribute, type_name, fragment)`` for the main and agent classes of a manifest.
    Folded lines are joined first."""
    flat = F.regexp_replace(F.col(text), "\r?\n ", "")

    def value(name: str) -> Column:
        return F.translate(F.regexp_extract(flat, rf"(?m)^{name}:[ \t]*(\S+)[ \t]*\r?$", 1), ".", "/")

    # Method started for each attribute.
    starts = {"Main-Class": "-main-([Ljava/lang/String;)V", "Premain-Class": "-premain-(*)?"}
    found = F.array(*[F.struct(F.lit(name).alias("attribute"), value(name).alias("type_name"),
                               F.lit(suffix).alias("suffix")) for name, suffix in starts.items()])
    return (
        entries.filter(F.col(text).contains("ain-Class:"))
        .select("container", "entry_path", F.explode(F.filter(found, lambda f: f["type_name"] != "")).alias("f"))
        .select("container", "entry_path", "f.attribute", "f.type_name",
                F.concat("f.type_name", "f.suffix").alias("fragment"))
    )


def package_declarations(entries: DataFrame, root: str = "classes") -> DataFrame:
    """Every directory below ``root`` except ``root/META-INF*``, as package postings. Directories may be rows or
    only be implied by the paths of files."""
    path = F.col("entry_path")
    below = entries.filter(path.startswith(root + "/"))
    levels = ancestor_paths(path)
    folders = F.when(F.col("is_dir"), levels).otherwise(F.slice(levels, F.lit(1), F.size(levels) - 1))
    return (
        below.select("container", F.explode(folders).alias("entry_path")).distinct()
        .filter((path != root) & ~path.startswith(root + "/META-INF"))
        .select(F.lit(m.PACKAGE_DECLARATIONS).alias("index_name"),
                F.substring(path, F.lit(len(root) + 2), F.length(path)).alias("key"), "container", "entry_path")
    )


def unique_descriptor(entries: DataFrame, base: str = "META-INF/maven", file_name: str = "pom.properties") -> DataFrame:
    """The descriptor ``base/*/*/file_name`` of containers with exactly one directory at each of the two levels:
    ``(container, group_dir, artifact_dir, entry_path)``."""
    path = F.col("entry_path")
    steps = base.count("/") + 1
    parts = F.split(path, "/")
    level = lambda i: F.get(parts, F.lit(steps + i))
    below = entries.filter(path.startswith(base + "/")).select(
        "container", "entry_path", level(0).alias("g"), level(1).alias("a"), level(2).alias("f"),
        (F.size(parts) == steps + 3).alias("exact"))
    return (
        below.groupBy("container").agg(
            F.min("g").alias("group_dir"), F.max("g").alias("_g"), F.min("a").alias("artifact_dir"),
            F.max("a").alias("_a"),
            F.min(F.when(F.col("exact") & (F.col("f") == file_name), path)).alias("entry_path"))
        .filter((F.col("group_dir") == F.col("_g")) & (F.col("artifact_dir") == F.col("_a"))
                & F.col("entry_path").isNotNull())
        .select("container", "group_dir", "artifact_dir", "entry_path")
    )


def properties_value(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^[ \t]*{name}[ \t]*[=:][ \t]*(.*?)[ \t]*\r?$", 1)


def coordinates(entries: DataFrame, text: str = "text") -> DataFrame:
    """``(container, group_id, artifact_id, version)`` from the unique descriptor of each container."""
    one = unique_descriptor(entries).select("container", "entry_path")
    return entries.join(one, ["container", "entry_path"], "left_semi").select(
        "container", properties_value(F.col(text), "groupId").alias("group_id"),
        properties_value(F.col(text), "artifactId").alias("artifact_id"),
        properties_value(F.col(text), "version").alias("version"))


def artifact_identity(files: DataFrame, catalogue: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``files(container, sha1)`` against ``catalogue(sha1, artifact, has_sources)``.

    Exactly one hit with sources gives its id, no hit falls back to ``fallback(container, artifact)``, anything
    else stays unknown. ``status`` tells which.
    """
    hits = catalogue.groupBy("sha1").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("artifact").alias("_artifact"),
        F.max("has_sources").alias("_sources"))
    out = files.join(hits, "sha1", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    if fallback is not None:
        out = out.join(fallback.select("container", F.col("artifact").alias("_fallback")), "container", "left")
    else:
        out = out.withColumn("_fallback", F.lit(None).cast("string"))
    known = (F.col("n_hits") == 1) & F.col("_sources")
    none = F.col("n_hits") == 0
    return out.select(
        *files.columns, "n_hits",
        F.when(known, F.col("_artifact")).when(none, F.col("_fallback")).alias("artifact"),
        F.when(known, "catalogue").when(none & F.col("_fallback").isNotNull(), "descriptor")
        .otherwise("unknown").alias("status"))
