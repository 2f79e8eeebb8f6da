"""Resolution of references."""

from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import asof as A
from symlake.operators import resolve as R
from symlake.plans.fixtures import sub, table, view
from symlake.plans.registry import query
from symlake.session import Scratch


def _part_decls(spark, sf):
    """All types, each also declared by a second library."""
    t = view(spark, sf, "types")
    return t.selectExpr("type_name AS key", "explode(array(container, 'shade')) AS container", "entry_path")


_PART_DECLS = f"""(SELECT type_name AS key, unnest([container, 'shade']) AS container, entry_path FROM {sub('types')})"""

# A share of the references names what nothing declares.
_TYPE_KEY = "(case when ref_id % 7 = 0 then 'gone/' || type_name else type_name end)"
_NAME_KEY = "(case when ref_id % 7 = 0 then 'Gone' || key else key end)"
_PART_REFS = f"(SELECT ref_id, ref_line, {_TYPE_KEY} AS key FROM {sub('refs')})"
_NAME_REFS = f"(SELECT ref_id, ref_line, {_NAME_KEY} AS key, container FROM {sub('refs')})"


def _part_refs(spark, sf):
    return view(spark, sf, "refs").selectExpr("ref_id", "ref_line", f"{_TYPE_KEY} AS key")


def _name_refs(spark, sf):
    return view(spark, sf, "refs").selectExpr("ref_id", "ref_line", f"{_NAME_KEY} AS key", "container")


@query("resolve_refs", f"""
WITH d AS (SELECT key, count(*) AS n, min(container) AS c, min(entry_path) AS e FROM {_PART_DECLS} GROUP BY key)
SELECT r.ref_id, r.ref_line, r.key, coalesce(d.n, 0) AS n_targets, d.c AS target_container, d.e AS target_entry
FROM {_PART_REFS} r LEFT JOIN d ON d.key = r.key""")
def resolve_refs(spark, sf):
    return R.resolve(_part_refs(spark, sf), _part_decls(spark, sf))


@query("dangling_refs", f"""
SELECT r.key, r.ref_id, r.ref_line FROM {_PART_REFS} r WHERE r.key NOT IN (SELECT key FROM {_PART_DECLS})""")
def dangling(spark, sf):
    return R.dangling_refs(_part_refs(spark, sf), _part_decls(spark, sf))


@query("live_refs", f"""
SELECT r.key, r.ref_id, r.ref_line FROM {_PART_REFS} r WHERE r.key IN (SELECT key FROM {_PART_DECLS})""")
def live(spark, sf):
    return R.live_refs(_part_refs(spark, sf), _part_decls(spark, sf))


# Simple names declared in many libraries.
_DECLS = sub("decls")


@query("resolve_same_container", f"""
WITH d AS (SELECT DISTINCT key, container, entry_path FROM {_DECLS}),
l AS (SELECT key, container, count(*) AS n, min(entry_path) AS e FROM d GROUP BY key, container),
w AS (SELECT key, count(*) AS n, min(container) AS c FROM d GROUP BY key),
f AS (SELECT w.key, w.n, w.c, min(d.entry_path) AS e FROM w JOIN d ON d.key = w.key AND d.container = w.c GROUP BY ALL)
SELECT r.ref_id, r.ref_line, r.key, r.container, CASE WHEN l.n IS NOT NULL THEN 'same' WHEN f.n IS NOT NULL THEN 'any' ELSE 'none' END AS scope,
  coalesce(l.n, f.n, 0) AS n_candidates, CASE WHEN l.n IS NOT NULL THEN r.container ELSE f.c END AS first_container, coalesce(l.e, f.e) AS first_entry
FROM {_NAME_REFS} r LEFT JOIN l ON l.key = r.key AND l.container = r.container LEFT JOIN f ON f.key = r.key""")
def resolve_same_container(spark, sf):
    return R.resolve_same_container(_name_refs(spark, sf), view(spark, sf, "decls"))


@query("candidate_sets", f"""
WITH d AS (SELECT DISTINCT key, container, entry_path FROM {_DECLS})
SELECT key AS set_key, container AS set_container, container, entry_path FROM d UNION ALL SELECT key, NULL, container, entry_path FROM d""")
def candidate_sets(spark, sf):
    return R.candidate_sets(view(spark, sf, "decls"))


def _member_refs(spark, sf):
    """Calls with every kind of wildcard: exact, any parameters, unknown type, one unknown parameter."""
    r = view(spark, sf, "members").filter("kind = 'method'")
    return r.selectExpr(
        "case when line_no = 2 then '*/' || split_part(type_name,'/',-1) else type_name end AS type_name", "name",
        "case when line_no = 3 then '(*)?' when line_no = 4 then replace(descriptor, 'D)', '?)') else descriptor end AS descriptor")


@query("member_match", f"""
WITH m AS (SELECT DISTINCT type_name, name, descriptor, line_no FROM {sub('members')} WHERE kind = 'method'),
r AS (SELECT DISTINCT case when line_no = 2 then '*/' || split_part(type_name,'/',-1) else type_name end AS type_name, name,
  case when line_no = 3 then '(*)?' when line_no = 4 then replace(descriptor, 'D)', '?)') else descriptor end AS descriptor FROM m),
d AS (SELECT DISTINCT type_name AS found_type, name, descriptor AS found_descriptor, split_part(type_name,'/',-1) AS s FROM m)
SELECT r.type_name, r.name, r.descriptor, d.found_type, d.found_descriptor FROM r JOIN d ON d.name = r.name AND d.s = split_part(r.type_name,'/',-1)
WHERE (r.type_name = d.found_type OR r.type_name LIKE '*%') AND (r.descriptor = d.found_descriptor OR r.descriptor = '(*)?'
  OR (contains(r.descriptor, '?)') AND d.found_descriptor IN (replace(r.descriptor,'?)','D)'), replace(r.descriptor,'?)','I)'), replace(r.descriptor,'?)','Z)'))))""")
def member_match(spark, sf):
    return R.member_match(_member_refs(spark, sf), view(spark, sf, "members").filter("kind = 'method'"), wild_decls=False)


@query("match_fragment", f"""
WITH m AS (SELECT DISTINCT type_name, name, descriptor FROM {sub('members')}),
t AS (SELECT DISTINCT type_name FROM m),
d AS (SELECT type_name, NULL AS name, NULL AS descriptor, 0 AS start, 1 AS "end" FROM t UNION ALL SELECT type_name, name, descriptor, 10, 20 FROM m WHERE name <> '<clinit>'),
f AS (SELECT type_name AS fragment, type_name AS ft, NULL AS fn, NULL AS fd FROM t
  UNION SELECT '*/' || split_part(type_name,'/',-1) || '-' || name || '-(*)?', '*/' || split_part(type_name,'/',-1), name, '(*)?' FROM m
  UNION SELECT type_name || '-' || name || '-' || descriptor, type_name, name, descriptor FROM m
  UNION SELECT type_name || '-<clinit>-()V', type_name, '<clinit>', '()V' FROM t)
SELECT f.fragment, d.type_name, d.name, d.descriptor, d.start, d."end" FROM f JOIN d ON split_part(f.ft,'/',-1) = split_part(d.type_name,'/',-1)
  AND (f.ft = d.type_name OR f.ft LIKE '*/%') AND f.fn IS NOT DISTINCT FROM d.name
  AND (f.fn IS NULL OR f.fd = d.descriptor OR (f.fd = '(*)?' AND d.descriptor LIKE '(%'))
UNION ALL SELECT f.fragment, f.ft, NULL, NULL, 0, 1 FROM f WHERE f.fn = '<clinit>' AND f.fd = '()V'""")
def match_fragment(spark, sf):
    # Written once, the members of a type side by side.
    mem, _ = Scratch(spark, "members").save(
        view(spark, sf, "members").select("type_name", "name", "descriptor").repartition("type_name").distinct().sortWithinPartitions("type_name"),
        "distinct")
    types = mem.select("type_name").distinct()
    decls = types.selectExpr("type_name", "cast(null AS string) AS name", "cast(null AS string) AS descriptor",
                             "0 AS start", "1 AS `end`").unionByName(
        mem.filter("name <> '<clinit>'").selectExpr("type_name", "name", "descriptor", "10 AS start", "20 AS `end`"))
    frags = types.selectExpr("explode(array(type_name, type_name || '-<clinit>-()V')) AS fragment").unionByName(
        mem.selectExpr("explode(array('*/' || split_part(type_name,'/',-1) || '-' || name || '-(*)?', "
                       "type_name || '-' || name || '-' || descriptor)) AS fragment"))
    return R.match_fragment(decls, frags)


@query("line_lookup", """
WITH l AS (SELECT user_id, event_id, event_id % 4 = 0 AS ask, cast(floor(value * 3) AS int) AS line, cast(event_id % 1000 AS int) AS view_line FROM events),
m AS (SELECT user_id, line, max(view_line) AS view_line FROM l WHERE NOT ask AND line > 0 GROUP BY ALL)
SELECT l.user_id AS container, 'f' AS entry_path, l.event_id, l.line, coalesce(m.view_line, 1) AS view_line
FROM (SELECT * FROM l WHERE ask) l ASOF LEFT JOIN m ON m.user_id = l.user_id AND l.line >= m.line""")
def line_lookup(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id AS container", "'f' AS entry_path", "event_id", "event_id % 4 = 0 AS ask",
        "cast(floor(value * 3) AS int) AS line", "cast(event_id % 1000 AS int) AS view_line")
    return A.line_lookup(rows.filter("ask").drop("ask", "view_line"),
                         rows.filter("NOT ask").withColumnRenamed("line", "src_line"))


@query("enclosing_decl", """
SELECT o.user_id AS container, 'f' AS entry_path, o.event_id, o.ts AS "offset", d.type_name, d.ts AS matched_pos
FROM (SELECT * FROM events WHERE event_type IN ('view','click','purchase')) o
ASOF LEFT JOIN (SELECT user_id, ts, max('com/T' || cast(event_id AS string)) AS type_name FROM events WHERE event_type IN ('signup','error') GROUP BY ALL) d
  ON d.user_id = o.user_id AND o.ts >= d.ts""")
def enclosing_decl(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id AS container", "'f' AS entry_path", "event_id", "event_type", "ts")
    asked = e.filter("event_type IN ('view','click','purchase')").select(
        "container", "entry_path", "event_id", F.col("ts").alias("offset"))
    decls = e.filter("event_type IN ('signup','error')").selectExpr(
        "container", "entry_path", "ts AS start", "'com/T' || cast(event_id AS string) AS type_name")
    return A.enclosing_declaration(asked, decls)


@query("resolve_cascade", f"""
WITH n AS (SELECT c_custkey, 'n' || cast(c_nationkey AS string) AS container, 'e' || cast(c_custkey % 50 AS string) AS entry_path,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS package,
    CASE WHEN c_custkey % 11 = 0 THEN 'E' || cast(c_custkey % 60 AS string) || 'Exception' WHEN c_custkey % 13 = 0 THEN 'a.b.C' ELSE 'T' || cast(c_custkey % 40 AS string) END AS name FROM customer),
i AS (SELECT 'n' || cast(s_nationkey AS string) AS container, 'e' || cast(s_suppkey % 50 AS string) AS entry_path, 'T' || cast(s_suppkey % 40 AS string) AS name,
    max('imp/T' || cast(s_suppkey AS string)) AS imported FROM supplier GROUP BY ALL),
d AS (SELECT DISTINCT 'n' || cast(c_nationkey AS string) AS container, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS package,
    'T' || cast(cast(floor(c_acctbal) AS bigint) % 40 AS string) AS name FROM customer),
k AS (SELECT DISTINCT 'E' || cast(p_size AS string) || 'Exception' AS name FROM part)
SELECT n.*, CASE WHEN contains(n.name,'.') THEN replace(n.name,'.','/') WHEN i.imported IS NOT NULL THEN i.imported
    WHEN p.name IS NOT NULL THEN n.package || '/' || n.name WHEN r.name IS NOT NULL THEN n.name WHEN k.name IS NOT NULL THEN 'java/lang/' || n.name ELSE '*/' || n.name END AS type_name,
  CASE WHEN contains(n.name,'.') THEN 'qualified' WHEN i.imported IS NOT NULL THEN 'import' WHEN p.name IS NOT NULL THEN 'package'
    WHEN r.name IS NOT NULL THEN 'root' WHEN k.name IS NOT NULL THEN 'core' ELSE 'unknown' END AS resolved_by
FROM n LEFT JOIN i ON i.container = n.container AND i.entry_path = n.entry_path AND i.name = n.name
LEFT JOIN d p ON p.container = n.container AND p.package = n.package AND p.name = n.name AND n.package <> ''
LEFT JOIN d r ON r.container = n.container AND r.package = '' AND r.name = n.name
LEFT JOIN k ON k.name = n.name""")
def resolve_cascade(spark, sf):
    cust = table(spark, sf, "customer")
    names = cust.selectExpr(
        "c_custkey", "'n' || cast(c_nationkey AS string) AS container", "'e' || cast(c_custkey % 50 AS string) AS entry_path",
        "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END AS package",
        "CASE WHEN c_custkey % 11 = 0 THEN 'E' || cast(c_custkey % 60 AS string) || 'Exception' WHEN c_custkey % 13 = 0 THEN 'a.b.C' ELSE 'T' || cast(c_custkey % 40 AS string) END AS name")
    imports = table(spark, sf, "supplier").selectExpr(
        "'n' || cast(s_nationkey AS string) AS container", "'e' || cast(s_suppkey % 50 AS string) AS entry_path",
        "'T' || cast(s_suppkey % 40 AS string) AS name", "'imp/T' || cast(s_suppkey AS string) AS type_name")
    declared = cust.selectExpr(
        "'n' || cast(c_nationkey AS string) AS container",
        "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS package",
        "'T' || cast(cast(floor(c_acctbal) AS bigint) % 40 AS string) AS name")
    corpus = table(spark, sf, "part").selectExpr("explode(array('java/lang/E' || cast(p_size AS string) || 'Exception', "
                                                 "'java/lang/ref/E' || cast(p_partkey AS string), 'java/lang/E' || cast(p_size AS string) || '$In')) AS type_name")
    return R.resolve_cascade(names, imports, declared, R.core_types(corpus))


_KIND = "case cast(ref_id % 4 as int) when 0 then 'type' when 1 then 'package' when 2 then 'module' else 'other' end"


@query("resolve_by_kind", f"""
WITH d AS (SELECT * FROM {sub('decls')}),
p AS (SELECT DISTINCT 'type' AS kind, key, container, entry_path FROM d UNION SELECT 'package', key, container, entry_path FROM d
  UNION SELECT 'module', key, container, entry_path FROM d),
g AS (SELECT kind, key, count(*) AS n, min(container) AS c FROM p GROUP BY ALL),
f AS (SELECT g.kind, g.key, g.n, g.c, min(p.entry_path) AS e FROM g JOIN p ON p.kind = g.kind AND p.key = g.key AND p.container = g.c GROUP BY ALL)
SELECT r.ref_id, r.ref_line, r.kind, r.key, coalesce(f.n, 0) AS n_targets, f.c AS target_container, f.e AS target_entry
FROM (SELECT ref_id, ref_line, {_KIND} AS kind, key FROM {_NAME_REFS}) r LEFT JOIN f ON f.kind = r.kind AND f.key = r.key""")
def resolve_by_kind(spark, sf):
    d = view(spark, sf, "decls")
    post = lambda index: d.select(F.lit(index).alias("index_name"), "key", "container", "entry_path")
    postings = post(m.TYPE_DECLARATIONS).unionByName(post(m.PACKAGE_DECLARATIONS)).unionByName(
        post(m.MODULE_DECLARATIONS))
    return R.resolve_by_kind(_name_refs(spark, sf).selectExpr("ref_id", "ref_line", f"{_KIND} AS kind", "key"), postings)


@query("source_coverage", f"""
WITH c AS (SELECT order_id, container, entry_path, regexp_replace(entry_path, '([$][^/]*)?[.]class$', '.java') AS s FROM {sub('files')}
  WHERE NOT is_dir AND entry_path LIKE '%.class'),
p AS (SELECT container, s, min(k) AS k FROM (SELECT container, s, 0 AS k FROM c WHERE order_id % 3 = 0 UNION ALL SELECT container, s, 1 FROM c WHERE order_id % 2 = 0) GROUP BY ALL)
SELECT c.order_id, c.container, c.entry_path, CASE WHEN p.k IS NOT NULL THEN c.s END AS source_entry, p.k AS provider
FROM c LEFT JOIN p ON p.container = c.container AND p.s = c.s""")
def source_coverage(spark, sf):
    from symlake.extensions import Extensions

    classes = view(spark, sf, "files").filter("NOT is_dir AND entry_path LIKE '%.class'").select(
        "order_id", "container", "entry_path")
    made = classes.withColumn("entry_path", R.source_path(F.col("entry_path")))
    ext = Extensions()
    ext.register_source(made.filter("order_id % 3 = 0"))
    ext.register_source(made.filter("order_id % 2 = 0"))
    return ext.source_coverage(classes)


@query("outer_locator", f"""
WITH t AS (SELECT * FROM {sub('nested')})
SELECT t.id, t.container || '!/' || coalesce(o.entry_path, t.entry_path) || '?lineNumber=7#' || t.type_name AS locator
FROM t LEFT JOIN t o ON o.id = t.outer_id AND o.container = t.container""")
def outer_locator(spark, sf):
    t = view(spark, sf, "nested")
    entries = t.join(t.selectExpr("id AS outer_id", "type_name AS outer_name"), "outer_id", "left")
    return R.outer_locator(entries, t, "lineNumber=7").select("id", "locator")


@query("class_root", f"""
SELECT id, file_path, CASE WHEN size % 3 = 0 THEN type_name || '.class' WHEN size % 3 = 1 THEN split_part(type_name,'/',-1) || '.class' END AS inner_path,
  CASE WHEN size % 3 = 0 THEN '/data/' || container WHEN size % 3 = 1 THEN '/flat' END AS root_path
FROM (SELECT *, CASE size % 3 WHEN 0 THEN '/data/' || container || '/' || type_name || '.class' WHEN 1 THEN '/flat/' || split_part(type_name,'/',-1) || '.class'
  ELSE '/other/X' || split_part(type_name,'/',-1) || '.class' END AS file_path FROM {sub('types')})""")
def class_root(spark, sf):
    files = view(spark, sf, "types").selectExpr(
        "id", "type_name", "CASE size % 3 WHEN 0 THEN '/data/' || container || '/' || type_name || '.class' "
        "WHEN 1 THEN '/flat/' || split_part(type_name,'/',-1) || '.class' "
        "ELSE '/other/X' || split_part(type_name,'/',-1) || '.class' END AS file_path")
    return R.class_root(files).select("id", "file_path", "inner_path", "root_path")


@query("entry_of_type", f"""
WITH t AS (SELECT * FROM {sub('types')})
SELECT r.ref_id, r.ref_line, r.type_name, CASE WHEN 'lib' || cast(r.ref_id % 26 AS string) = t.container THEN t.entry_path END AS found_entry
FROM {sub('refs')} r JOIN t ON t.type_name = r.type_name""")
def entry_of_type(spark, sf):
    from symlake.functions.names import package_name

    entries = view(spark, sf, "types").selectExpr("container", "entry_path", "false AS is_dir").withColumn(
        "parent_path", package_name("entry_path"))
    asked = view(spark, sf, "refs").selectExpr(
        "ref_id", "ref_line", "'lib' || cast(ref_id % 26 AS string) AS container", "type_name").withColumn(
        "parent_path", package_name("type_name"))
    return R.entry_of_type(asked, entries).select("ref_id", "ref_line", "type_name", "found_entry")
