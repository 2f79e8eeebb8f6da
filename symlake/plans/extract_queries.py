"""Extraction of symbols from content."""

from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import extract as X
from symlake.operators import index as I
from symlake.operators.search import symbol_search
from symlake.plans.fixtures import VIEWS, sub, table, view
from symlake.plans.registry import query


def _documents(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "source AS container", "'doc' || cast(doc_id AS string) AS entry_path", "text")


def _html(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        f"{VIEWS['pages'][2]['container']} AS container", "'page' || cast(page_id AS string) AS entry_path", "html AS text")


_DOC = "source AS container, 'doc' || cast(doc_id AS string) AS entry_path"
_PAGE = f"{VIEWS['pages'][2]['container']} AS container, 'page' || cast(page_id AS string) AS entry_path"


@query("text_postings", f"""
SELECT DISTINCT 'texts' AS index_name, sha1(text) AS key, {_DOC}, length(text) AS n_chars FROM documents""")
def text_postings(spark, sf):
    rows, texts = X.text_postings(_documents(spark, sf))
    return rows.join(texts.select("key", F.length("text").alias("n_chars")), "key")


@query("text_symbol_search", f"""
SELECT DISTINCT {_DOC} FROM documents WHERE regexp_full_match(text, 'The.*ing.*')""")
def text_symbol_search(spark, sf):
    rows, texts = X.text_postings(_documents(spark, sf))
    return symbol_search(rows, "The*ing", m.SEARCH_STRING | m.SEARCH_DECLARATION, texts)


@query("bean_refs", f"""
WITH p AS (SELECT {_PAGE}, page_id, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS ref FROM pages)
SELECT DISTINCT container, entry_path, replace(trim(ref), '.', '/') AS key FROM p WHERE trim(ref) <> ''""")
def bean_refs(spark, sf):
    """Links of pages as bean definitions: with and without a prefix, in either kind of quotes."""
    quote = "CASE WHEN page_id % 2 = 0 THEN '\\'' ELSE '\"' END"
    bean = "CASE WHEN page_id % 3 = 0 THEN '<b:bean' ELSE '<bean id=\"x\"' END"
    links = "regexp_extract_all(html, '<a[^>]* href=\"([^\"]*)\"', 1)"
    xml = table(spark, sf, "pages").selectExpr(
        f"{VIEWS['pages'][2]['container']} AS container", "'page' || cast(page_id AS string) AS entry_path",
        f"concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?><beans>', array_join(transform({links}, v -> concat({bean}, ' class=', {quote}, v, {quote}, '/>')), ''), '</beans>') AS text")
    return X.bean_postings(xml).filter(F.col("index_name") == m.TYPE_REFERENCES).select("container", "entry_path", "key")


# One entry of each kind: texts of documents, and descriptors and provider files made of parts.
_KINDS = """
WITH t AS (SELECT container, replace(type_name, '/', '.') AS dotted, type_name, id FROM {types}),
e AS (SELECT source AS container, 'doc' || cast(doc_id AS string) || '.txt' AS entry_path, 'generic' AS container_type, text AS content FROM documents UNION ALL
  SELECT container || '-' || cast(id AS string), 'WEB-INF/web.xml', 'war', '<web-app><servlet><servlet-class>' || dotted || '</servlet-class></servlet></web-app>' FROM t WHERE id % 5 = 0 UNION ALL
  SELECT container, 'conf/b' || cast(id AS string) || '.xml', 'jar', '<beans><bean class="' || dotted || '"/></beans>' FROM t WHERE id % 5 = 1 UNION ALL
  SELECT container, 'META-INF/services/s' || cast(id AS string), 'jar', '# ' || dotted || chr(10) || dotted FROM t WHERE id % 5 = 2 UNION ALL
  SELECT container, 'schema/x' || cast(id AS string) || '.xsd', 'jar', '<schema><name>' || dotted || '</name></schema>' FROM t WHERE id % 5 = 3 UNION ALL
  SELECT container, 'classes/' || type_name || '.txt', 'jmod', dotted FROM t WHERE id % 5 = 4)"""


@query("index_entries", _KINDS.format(types=sub("types")) + """,
w AS (SELECT DISTINCT container, entry_path, regexp_extract(content, '<servlet-class>(.*)</servlet-class>', 1) AS v FROM e WHERE container_type = 'war'),
b AS (SELECT container, entry_path, regexp_extract(content, 'class="([^"]*)"', 1) AS v FROM e WHERE entry_path LIKE 'conf/%'),
x AS (SELECT container, entry_path, regexp_extract(content, '<name>(.*)</name>', 1) AS v FROM e WHERE entry_path LIKE 'schema/%'),
s AS (SELECT container, entry_path, string_split(content, chr(10))[2] AS v FROM e WHERE entry_path LIKE 'META-INF/%'),
j AS (SELECT container, string_split(entry_path, '/') AS p FROM e WHERE container_type = 'jmod'),
p AS (SELECT DISTINCT container, array_to_string(p[1:i], '/') AS entry_path FROM (SELECT container, p, unnest(range(2, len(p))) AS i FROM j))
SELECT 'texts' AS index_name, sha1(content) AS key, container, entry_path FROM e WHERE entry_path LIKE '%.txt'
UNION ALL SELECT 'typeReferences', replace(v, '.', '/'), container, entry_path FROM (FROM w UNION ALL FROM b UNION ALL FROM s)
UNION ALL SELECT 'strings', unnest(['web-app', 'servlet', 'servlet-class', v]), container, entry_path FROM w
UNION ALL SELECT 'strings', unnest(['beans', 'bean', 'class']), container, entry_path FROM b
UNION ALL SELECT 'strings', unnest(['schema', 'name', v]), container, entry_path FROM x
UNION ALL SELECT 'packageDeclarations', entry_path[9:], container, entry_path FROM p""")
def index_entries(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("symlake_documents")
    view(spark, sf, "types").createOrReplaceTempView("symlake_types")
    made = spark.sql(_KINDS.format(types="symlake_types").replace("FROM documents", "FROM symlake_documents") + " SELECT * FROM e")
    entries = made.select(
        "container", F.col("container").alias("root_container"), "container_type", "entry_path", F.lit("").alias("parent_path"), F.lit(False).alias("is_dir"),
        F.lit(0).cast("bigint").alias("length"), F.lit(0).alias("depth"), F.encode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))
    return I.index_entries(entries)["postings"].distinct()


_TAG_SQL = """'<[A-Za-z_](?:[^<>"'']|"[^"]*"|''[^'']*'')*>'"""
_ATTR_SQL = """'([\\w:.-]+)\\s*=\\s*(?:"[^"]*"|''[^'']*'')'"""
_NOT_TEXT_SQL = ("""'(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<![A-Za-z][^>]*>|</[^<>]*>|"""
                 """<[A-Za-z_](?:[^<>"'']|"[^"]*"|''[^'']*'')*>'""")
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_UNESC = lambda c: ("replace(replace(replace(replace(replace(" + c + ",'&lt;','<'),'&gt;','>'),'&quot;','\"'),"  # noqa: E731
                    "'&apos;',''''),'&amp;','&')")


@query("markup_postings", f"""
WITH p AS (SELECT {_PAGE}, html, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>', '', 'g'), {_TAG_SQL}) AS tags FROM pages),
tag AS (SELECT container, entry_path, unnest(tags) AS t FROM p),
attr AS (SELECT container, entry_path, unnest(regexp_extract_all(t, {_ATTR_SQL})) AS a FROM tag),
tok AS (
  SELECT container, entry_path, regexp_extract(t, '^<([\\w:.-]+)', 1) AS key FROM tag
  UNION ALL SELECT container, entry_path, regexp_extract(a, '^([\\w:.-]+)', 1) FROM attr
  UNION ALL SELECT container, entry_path, {_UNESC("regexp_extract(a, '(?s)=\\s*[\"'']([^\"'']*)[\"'']$', 1)")} FROM attr
  UNION ALL SELECT container, entry_path, {_UNESC(_TRIM('t'))} FROM (
    SELECT container, entry_path, unnest(string_split(regexp_replace(html, {_NOT_TEXT_SQL}, chr(1), 'g'), chr(1))) AS t FROM p)
  UNION ALL SELECT container, entry_path, {_TRIM('c')} FROM (
    SELECT container, entry_path, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM p))
SELECT DISTINCT 'strings' AS index_name, key, container, entry_path FROM tok WHERE key <> ''""")
def markup_postings(spark, sf):
    return X.markup_postings(_html(spark, sf))


@query("anchor_refs", f"""
SELECT DISTINCT 'typeReferences' AS index_name, key, container, entry_path FROM (
  SELECT {_PAGE}, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS key FROM pages) WHERE key <> ''""")
def anchor_refs(spark, sf):
    return X.attribute_refs(_html(spark, sf), "a", "href")


@query("line_refs", f"""
SELECT DISTINCT 'typeReferences' AS index_name, key, container, entry_path FROM (
  SELECT container, entry_path, {_TRIM('key')} AS key FROM (SELECT {_DOC}, unnest(string_split(text, chr(10))) AS key FROM documents))
WHERE key <> '' AND key NOT LIKE '#%'""")
def line_refs(spark, sf):
    return X.line_refs(_documents(spark, sf))


# Deployment descriptors built from parts; every part of size 7 or less lost its closing tag.
_XML = (
    "concat('<?xml version=\"1.0\"?>', chr(10), '<web-app xmlns=\"http://example.org/ns\"><display-name>x</display-name>', "
    "'<servlet id=\"s\"><servlet-name>n</servlet-name><servlet-class> ', replace(type_name,'/','.'), ' </servlet-class></servlet>', "
    "case when size % 2 = 0 then concat('<servlet><servlet-class>org.acme.', simple, '</servlet-class></servlet>') else '' end, "
    "case when size % 3 = 0 then concat('<filter><filter-class>com.acme.', simple, '</filter-class></filter>') else '' end, "
    "'<welcome-file-list><welcome-file>/', simple, '.jsp</welcome-file><welcome-file>index.jsp</welcome-file></welcome-file-list>', "
    "case when size > 7 then '</web-app>' else '' end)"
)


def _descriptors(spark, sf):
    return view(spark, sf, "types").selectExpr(
        "container", "type_name || '/web.xml' AS entry_path", f"{_XML} AS text", "simple", "size")


@query("xpath_refs", f"""
SELECT 'typeReferences' AS index_name, key, container, entry_path FROM (
  SELECT container, type_name || '/web.xml' AS entry_path, type_name AS key, size FROM {sub('types')}
  UNION SELECT container, type_name || '/web.xml', 'org/acme/' || simple, size FROM {sub('types')} WHERE size % 2 = 0
  UNION SELECT container, type_name || '/web.xml', 'com/acme/' || simple, size FROM {sub('types')} WHERE size % 3 = 0) WHERE size > 7""")
def xpath_refs(spark, sf):
    return X.web_type_refs(_descriptors(spark, sf))


@query("path_refs", f"""
WITH t AS (SELECT * FROM {sub('types')}),
r AS (SELECT container, type_name || '/web.xml' AS entry_path, '/' || simple || '.jsp' AS ref FROM t WHERE size > 7
  UNION SELECT container, type_name || '/web.xml', 'index.jsp' FROM t WHERE size > 7),
f AS (SELECT DISTINCT container, simple || '.jsp' AS path FROM t)
SELECT r.container, r.entry_path, r.ref, f.path AS target_path FROM r LEFT JOIN f ON f.container = r.container AND f.path = ltrim(r.ref, '/')""")
def path_refs(spark, sf):
    files = view(spark, sf, "types").selectExpr("container", "simple || '.jsp' AS entry_path")
    return X.web_file_refs(_descriptors(spark, sf), files)


_MANIFEST = (
    "concat('Manifest-Version: 1.0', chr(13), chr(10), case when s_suppkey % 3 <> 0 then concat('Main-Class: com.acme.n', "
    "cast(s_nationkey as string), chr(13), chr(10), ' .Start', cast(s_suppkey as string), chr(13), chr(10)) else '' end, "
    "case when s_suppkey % 4 = 0 then concat('Premain-Class: org.Agent', cast(s_suppkey as string), chr(10)) else "
    "concat('X-Main-Class: no.Way', chr(10)) end)"
)


@query("manifest_entrypoints", """
SELECT 'n' || cast(s_nationkey AS string) AS container, 'm' || cast(s_suppkey AS string) AS entry_path, 'Main-Class' AS attribute,
  'com/acme/n' || cast(s_nationkey AS string) || '/Start' || cast(s_suppkey AS string) AS type_name,
  'com/acme/n' || cast(s_nationkey AS string) || '/Start' || cast(s_suppkey AS string) || '-main-([Ljava/lang/String;)V' AS fragment
FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'n' || cast(s_nationkey AS string), 'm' || cast(s_suppkey AS string), 'Premain-Class',
  'org/Agent' || cast(s_suppkey AS string), 'org/Agent' || cast(s_suppkey AS string) || '-premain-(*)?' FROM supplier WHERE s_suppkey % 4 = 0""")
def manifest_entrypoints(spark, sf):
    return X.manifest_entrypoints(table(spark, sf, "supplier").selectExpr(
        "'n' || cast(s_nationkey AS string) AS container", "'m' || cast(s_suppkey AS string) AS entry_path",
        f"{_MANIFEST} AS text"))


@query("package_declarations", f"""
WITH p AS (SELECT container, string_split(entry_path, '/') AS s FROM {sub('page_tree')}),
d AS (SELECT DISTINCT container, array_to_string(s[1:i], '/') AS key FROM (SELECT container, s, unnest(generate_series(1, len(s) - 1)) AS i FROM p))
SELECT 'packageDeclarations' AS index_name, key, container, 'classes/' || key AS entry_path FROM d""")
def package_declarations(spark, sf):
    tree = view(spark, sf, "page_tree").selectExpr(
        "container", "'classes/' || entry_path AS entry_path", "false AS is_dir")
    return X.package_declarations(tree)


@query("unique_descriptor", f"""
WITH f AS (SELECT container, entry_path, string_split(entry_path,'/') AS s FROM {sub('files')} WHERE entry_path LIKE 'META-INF/maven/%')
SELECT container, min(s[3]) AS group_dir, min(s[4]) AS artifact_dir, min(entry_path) AS entry_path FROM f GROUP BY container
HAVING count(DISTINCT s[3]) = 1 AND count(DISTINCT s[4]) = 1""")
def unique_descriptor(spark, sf):
    return X.unique_descriptor(view(spark, sf, "files"))


@query("artifact_coordinates", f"""
WITH f AS (SELECT container, entry_path, order_id, string_split(entry_path,'/') AS s FROM {sub('files')} WHERE entry_path LIKE 'META-INF/maven/%'),
u AS (SELECT container FROM f GROUP BY container HAVING count(DISTINCT s[3]) = 1 AND count(DISTINCT s[4]) = 1)
SELECT container, 'g' || cast(order_id AS string) AS group_id, 'art' AS artifact_id, '1.' || cast(order_id AS string) AS version
FROM f SEMI JOIN u USING (container)""")
def artifact_coordinates(spark, sf):
    files = view(spark, sf, "files").withColumn("text", F.expr(
        "concat('#comment', chr(10), 'version = 1.', cast(order_id as string), chr(10), 'groupId=g', cast(order_id as string), "
        "chr(10), 'artifactId=art')"))
    return X.coordinates(files)


@query("artifact_identity", """
WITH f AS (SELECT 'doc' || cast(doc_id AS string) AS container, sha1(text) AS sha1, lang FROM documents),
c AS (SELECT sha1(d.text) AS sha1, 'g:doc' || cast(d.doc_id AS string) || ':1' AS artifact, l.quality = 1 AS has_sources FROM documents d JOIN labels l USING (doc_id)),
h AS (SELECT sha1, count(*) AS n, min(artifact) AS artifact, bool_or(has_sources) AS has_sources FROM c GROUP BY sha1)
SELECT f.container, f.sha1, coalesce(h.n, 0) AS n_hits,
  CASE WHEN h.n = 1 AND h.has_sources THEN h.artifact WHEN h.n IS NULL AND f.lang = 'en' THEN 'pom:' || f.container END AS artifact,
  CASE WHEN h.n = 1 AND h.has_sources THEN 'catalogue' WHEN h.n IS NULL AND f.lang = 'en' THEN 'descriptor' ELSE 'unknown' END AS status
FROM f LEFT JOIN h USING (sha1)""")
def artifact_identity(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.selectExpr("'doc' || cast(doc_id AS string) AS container", "sha1(text) AS sha1")
    known = docs.join(table(spark, sf, "labels"), "doc_id").selectExpr(
        "sha1(text) AS sha1", "'g:doc' || cast(doc_id AS string) || ':1' AS artifact", "quality = 1 AS has_sources")
    poms = docs.filter("lang = 'en'").selectExpr(
        "'doc' || cast(doc_id AS string) AS container", "'pom:doc' || cast(doc_id AS string) AS artifact")
    return X.artifact_identity(files, known, poms)


@query("custom_extractor", f"""
SELECT DISTINCT 'strings' AS index_name, 'order' || cast(order_id AS string) AS key, container, entry_path FROM {sub('files')}
  WHERE NOT is_dir AND entry_path LIKE '%.dat'
UNION SELECT DISTINCT 'typeReferences', split_part(entry_path,'/',-1), container, entry_path FROM {sub('files')}
  WHERE NOT is_dir AND entry_path LIKE 'META-INF/services/%'""")
def custom_extractor(spark, sf):
    from symlake.extensions import Extensions

    ext = Extensions()
    ext.register_extractor("dat", "*:file:*.dat", lambda e: e.selectExpr(
        "'strings' AS index_name", "'order' || cast(order_id AS string) AS key", "container", "entry_path"))
    services = {"service": lambda e: e.selectExpr(
        "'typeReferences' AS index_name", "split_part(entry_path,'/',-1) AS key", "container", "entry_path")}
    return ext.run(view(spark, sf, "files"), services)
