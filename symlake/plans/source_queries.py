"""Sources and sinks: entry scans, container types, classification, export plans."""

from pyspark.sql import functions as F

from symlake.plans.fixtures import sub, table, view
from symlake.plans.registry import query
from symlake.sources.archives import depth_limited
from symlake.sources.classify import DISPLAY_RULES, classify, kind_census, rule_rows
from symlake.sources.containers import container_traits, container_types
from symlake.sources.export import export_file_count, export_plan


@query("depth_limited_entries", f"""
SELECT page_id, entry_path FROM {sub('page_tree')} WHERE len(string_split(entry_path,'/')) <= 5""")
def depth_limited_entries(spark, sf):
    return depth_limited(view(spark, sf, "page_tree"), 5).select("page_id", "entry_path")


# Languages stand in for the marker directories of exploded containers.
_MARKED = (
    "SELECT container || case when length(container) % 4 = 0 then '.war' when length(container) % 5 = 0 then '.zip' "
    "else '' end AS container, case substr(entry_path,1,2) when 'en' then 'lib' when 'fr' then 'META-INF' when 'de' "
    "then 'WEB-INF' else 'classes' end || '/' || entry_path AS entry_path"
)


@query("container_type", f"""
SELECT container, CASE
  WHEN lower(split_part(container,'.',-1)) = 'war' THEN 'war'
  WHEN lower(split_part(container,'.',-1)) = 'zip' THEN CASE WHEN bool_or(container LIKE 'spam%') THEN 'spam' ELSE 'generic' END
  WHEN bool_or(entry_path LIKE 'classes/%') THEN 'jmod'
  WHEN bool_or(entry_path LIKE 'WEB-INF/%') THEN 'war'
  WHEN bool_or(entry_path LIKE 'META-INF/%') THEN 'jar'
  WHEN bool_or(container LIKE 'spam%') THEN 'spam'
  ELSE 'generic' END AS container_type
FROM ({_MARKED} FROM {sub('pages')}) GROUP BY container""")
def container_type(spark, sf):
    exprs = _MARKED[len("SELECT "):].split(" AS container, ")
    entries = view(spark, sf, "pages").selectExpr(exprs[0] + " AS container", exprs[1])
    own = [("spam", F.max(F.col("container").startswith("spam")))]
    return container_types(entries, own)


_USER_RULES = [("data", "*:file:*.dat", None), ("ear-xml", "ear:file:*.xml", r"com/.*"), ("page", "*:file:*.html", None)]
_RULES_SQL = ", ".join(
    "(" + ", ".join([str(seq)] + ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in row]) + ")"
    for seq, *row in rule_rows(DISPLAY_RULES + _USER_RULES))
# A rule applies through one of eight selectors; lower rank wins, then pattern before default, then the last default.
# The lookaheads of three patterns are spelled as separate conditions because the checking database has none.
_CLASSIFIED_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS rid, *, split_part(entry_path,'/',-1) AS base,
             CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS ek FROM {sub('files')}),
r(seq, kind, ct, ek, what, rx) AS (VALUES {_RULES_SQL}),
hit AS (
  SELECT e.rid, r.kind, r.seq, r.rx,
    (CASE WHEN r.ct = '*' THEN 10 ELSE 0 END) + (CASE WHEN r.what = e.entry_path THEN 0 WHEN r.what = '*/' || e.base THEN 1
      WHEN r.what = '*' THEN 3 ELSE 2 END) AS pri
  FROM e JOIN r ON r.ek = e.ek AND r.ct IN (e.container_type, '*') AND r.what IN (e.entry_path, '*/' || e.base, '*',
    CASE WHEN contains(e.base,'.') THEN '*.' || split_part(e.base,'.',-1) END)
  WHERE r.rx IS NULL
    OR (r.kind = 'class' AND NOT contains(e.entry_path,'module-info.class'))
    OR (r.kind = 'package' AND (e.entry_path LIKE 'META-INF/versions/%' OR NOT e.entry_path LIKE 'META-INF%'))
    OR (r.kind = 'jmod-package' AND e.entry_path LIKE 'classes/_%' AND NOT e.entry_path LIKE 'classes/META-INF%')
    OR (r.kind = 'war-package' AND e.entry_path LIKE 'WEB-INF/classes/_%' AND NOT e.entry_path LIKE 'WEB-INF/classes/META-INF%')
    OR (r.kind IN ('service','spi','ear-xml') AND regexp_full_match(e.entry_path, r.rx))),
best AS (SELECT rid, kind FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pri,
    CASE WHEN rx IS NULL THEN 1 ELSE 0 END, CASE WHEN rx IS NULL THEN -seq ELSE seq END) AS n FROM hit) WHERE n = 1)
"""


@query("classify_entries", _CLASSIFIED_SQL + """
SELECT e.order_id, e.container_type, e.entry_path, best.kind FROM e LEFT JOIN best USING (rid)""")
def classify_entries(spark, sf):
    return classify(view(spark, sf, "files"), DISPLAY_RULES, _USER_RULES).select(
        "order_id", "container_type", "entry_path", "kind")


@query("kind_census", _CLASSIFIED_SQL + """
SELECT best.kind, count(*) AS n_entries, cast(sum(e.length) AS bigint) AS total_length
FROM e LEFT JOIN best USING (rid) GROUP BY best.kind""")
def census(spark, sf):
    return kind_census(classify(view(spark, sf, "files"), DISPLAY_RULES, _USER_RULES))


@query("container_traits", f"""
SELECT container, bool_or(entry_path = 'META-INF/ejb-jar.xml') AS is_ejb_module FROM {sub('files')} GROUP BY container""")
def traits(spark, sf):
    return container_traits(view(spark, sf, "files"))


# Outer classes list the nested classes of the first two numbers only.
_LISTED = "regexp_extract(entry_path, '^(.*)[.]class$', 1)"
_LISTED_WHERE = "entry_path LIKE '%$In0.class' OR entry_path LIKE '%$In1.class' OR entry_path LIKE '%$In2.class'"


@query("export_plan", f"""
WITH f AS (SELECT * FROM {sub('files')} WHERE NOT is_dir),
listed AS (SELECT DISTINCT container, entry_path FROM f WHERE {_LISTED_WHERE})
SELECT f.container, f.entry_path, CASE
  WHEN regexp_matches(f.entry_path, '[.]class$') THEN regexp_replace(f.entry_path, '[.]class$', '.java')
  WHEN regexp_matches(f.entry_path, '[.](zip|jar)$') THEN regexp_replace(f.entry_path, '[.](zip|jar)$', '-sources.jar')
  ELSE f.entry_path END AS target_path
FROM f LEFT JOIN listed l ON l.container = f.container AND l.entry_path = f.entry_path
WHERE l.container IS NULL OR f.container_type NOT IN ('jar','war','ear')""")
def plan(spark, sf):
    files = view(spark, sf, "files")
    listed = files.filter(_LISTED_WHERE).selectExpr("container", f"{_LISTED} AS inner_name")
    return export_plan(files, listed)


@query("export_file_count", f"""
SELECT container, cast(sum(CASE WHEN entry_path LIKE '%$%.class' THEN 0 WHEN regexp_matches(entry_path, '[.](zip|jar)$') THEN 0
  ELSE 1 END) AS bigint) AS n_files FROM {sub('files')} WHERE NOT is_dir GROUP BY container""")
def file_count(spark, sf):
    return export_file_count(view(spark, sf, "files"))


@query("remove_inner", f"""
WITH f AS (SELECT * FROM {sub('files')} WHERE NOT is_dir),
listed AS (SELECT DISTINCT container, entry_path FROM f WHERE {_LISTED_WHERE})
SELECT container, entry_path, order_id FROM f WHERE NOT EXISTS (
  SELECT 1 FROM listed l WHERE l.container = f.container AND l.entry_path = f.entry_path)""")
def removed(spark, sf):
    from symlake.operators.resolve import remove_inner

    files = view(spark, sf, "files").filter("NOT is_dir")
    listed = files.filter(_LISTED_WHERE).selectExpr("container", f"{_LISTED} AS inner_name")
    return remove_inner(files, listed).select("container", "entry_path", "order_id")


@query("sorted_entries", f"""
SELECT container, parent_path, entry_path, is_dir, row_number() OVER (
  PARTITION BY container, parent_path ORDER BY is_dir DESC, entry_path, order_id) AS position
FROM (SELECT *, CASE WHEN contains(entry_path,'/') THEN substr(entry_path, 1, length(entry_path) - length(split_part(entry_path,'/',-1)) - 1)
  ELSE '' END AS parent_path FROM {sub('files')})""")
def sorted_files(spark, sf):
    from symlake.functions.names import package_name
    from symlake.operators.ordering import sorted_entries

    files = view(spark, sf, "files").withColumn("parent_path", package_name("entry_path"))
    return sorted_entries(files).select("container", "parent_path", "entry_path", "is_dir", "position")


@query("by_root_container", f"""
SELECT root_container, count(*) AS n_entries, cast(sum(length) AS bigint) AS total_length FROM (
  SELECT v.root_container, length(p.html) AS length FROM {sub('pages')} v JOIN pages p USING (page_id)) GROUP BY root_container""")
def roots(spark, sf):
    from symlake.operators.postings import by_root_container
    from symlake.plans.fixtures import VIEWS

    entries = table(spark, sf, "pages").selectExpr(
        f"{VIEWS['pages'][2]['root_container']} AS root_container", "length(html) AS length")
    return by_root_container(entries)
