"""Projections, scalar expressions and predicates."""

from pyspark.sql import functions as F

from symlake import functions as L
from symlake.functions.filters import DEFAULT_PREFIX_RULES, JAVA_KEYWORDS, RESERVED_FILE_NAMES
from symlake.plans.fixtures import DESCRIPTOR, sub, table, view
from symlake.plans.registry import query

_TAIL = "split_part(split_part(x,'/',-1),'$',-1)"


@query("innermost_name", f"""
SELECT id, x, {_TAIL} AS innermost FROM (SELECT id, CASE WHEN size % 3 = 0 THEN simple ELSE short_type || '$' || cast(size AS string) END AS x
FROM {sub('types')})""")
def innermost(spark, sf):
    named = view(spark, sf, "types").selectExpr(
        "id", "CASE WHEN size % 3 = 0 THEN simple ELSE short_type || '$' || cast(size AS string) END AS x")
    return named.withColumn("innermost", L.innermost_name("x"))


@query("package_rollup", f"""
SELECT replace(substr(type_name, 1, length(type_name) - length(split_part(type_name,'/',-1)) - 1), '/', '.') AS package,
  count(*) AS n_types FROM {sub('types')} GROUP BY 1""")
def package_rollup(spark, sf):
    return view(spark, sf, "types").groupBy(L.display_package("type_name").alias("package")).agg(
        F.count(F.lit(1)).alias("n_types"))


@query("glob_search", """
SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, 're.* .i.*') OR regexp_full_match(p_name, 'blue.*')
  OR regexp_full_match(p_name, '.*l.t')""")
def glob_search(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").filter(
        L.glob_match(name, "re* ?i") | L.glob_match(name, "blue") | L.glob_match(name, "*l?t", prefix=False)
    ).select("p_partkey", "p_name")


@query("glob_one_char", """
SELECT 'r' AS pattern, p_partkey FROM part WHERE substr(p_name,1,1) = 'r'
UNION ALL SELECT '*', p_partkey FROM part UNION ALL SELECT '?', p_partkey FROM part""")
def glob_one_char(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    hits = F.array(*[F.when(L.glob_match("p_name", p), p) for p in "r*?"])
    return part.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("pattern"), "p_partkey")


@query("camel_search", f"""
SELECT id, simple FROM {sub('types')} WHERE regexp_full_match(simple, '[sS][mM].*R[iI].*') OR regexp_full_match(simple, '[cC].*G[iI].*')
  OR substr(simple,1,1) IN ('h','H')""")
def camel_search(spark, sf):
    s = F.col("simple")
    return view(spark, sf, "types").filter(
        L.camel_match(s, "smRi") | L.camel_match(s, "cGi", every_capital=True) | L.camel_match(s, "h")).select("id", "simple")


_SCOPE = ("case size % 6 when 0 then null when 1 then '' when 2 then '*/' || simple when 3 then short_type "
          "when 4 then '*/' || substr(simple,2) else simple end")


@query("scope_filter", f"""
SELECT id, scope, short_type, (scope IS NULL OR scope = '' OR (scope LIKE '*%' AND (suffix(short_type, substr(scope,2)) OR short_type = substr(scope,3)))
  OR (scope NOT LIKE '*%' AND scope = short_type)) AS in_scope FROM (SELECT *, {_SCOPE} AS scope FROM {sub('types')})""")
def scope_filter(spark, sf):
    t = view(spark, sf, "types").withColumn("scope", F.expr(_SCOPE))
    return t.select("id", "scope", "short_type", L.scope_match(F.col("scope"), "short_type").alias("in_scope"))


_FRAGMENT = ("case when line_no = 2 then type_name when line_no = 3 then type_name || '-' || name else "
             "type_name || '-' || name || '-' || descriptor end")


@query("parse_fragment", f"""
SELECT order_id, line_no, fragment, line_no = 3 AS malformed, CASE WHEN line_no <> 3 THEN type_name END AS f_type,
  CASE WHEN line_no NOT IN (2,3) THEN name END AS f_name, CASE WHEN line_no NOT IN (2,3) THEN descriptor END AS f_descriptor
FROM (SELECT *, {_FRAGMENT} AS fragment FROM {sub('members')})""")
def fragments(spark, sf):
    f = view(spark, sf, "members").selectExpr("order_id", "line_no", f"{_FRAGMENT} AS fragment")
    return f.withColumn("f", L.parse_fragment("fragment")).select(
        "order_id", "line_no", "fragment", "f.malformed", F.col("f.type").alias("f_type"),
        F.col("f.name").alias("f_name"), F.col("f.descriptor").alias("f_descriptor"))


@query("parse_locator", f"""
SELECT page_id, split_part(url,'://',1) AS scheme, container, '/' || substr(split_part(split_part(split_part(url,'#',1),'?',1),'://',2), length(container)+2) AS path,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1),'') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1),'') AS ref,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1),'') AS utm_source, nullif(regexp_extract(url, '#(.*)$', 1),'') AS fragment
FROM {sub('pages')}""")
def locators(spark, sf):
    p = view(spark, sf, "pages").selectExpr(
        "page_id", "concat(split_part(url,'://',1), '://', container, '!/', "
                   "substr(url, length(split_part(url,'://',1)) + 3 + length(container) + 2)) AS locator")
    u = p.withColumn("u", L.parse_locator("locator"))
    return u.select(
        "page_id", "u.scheme", F.element_at("u.containers", 1).alias("container"), "u.path",
        F.try_element_at("u.params", F.lit("page")).alias("page"),
        F.try_element_at("u.params", F.lit("ref")).alias("ref"),
        F.try_element_at("u.params", F.lit("utm_source")).alias("utm_source"), "u.fragment")


_FLAGS = "cast(event_id * 37 % 32768 as int)"


@query("flag_rollup", f"""
SELECT visibility, is_static, is_final, is_abstract, kind, count(*) AS n FROM (SELECT
  CASE WHEN f & 1 <> 0 THEN 'public' WHEN f & 4 <> 0 THEN 'protected' WHEN f & 2 <> 0 THEN 'private' ELSE 'package' END AS visibility,
  f & 8 <> 0 AS is_static, f & 16 <> 0 AS is_final, f & 1024 <> 0 AS is_abstract,
  CASE WHEN f & 8192 <> 0 THEN 'annotation' WHEN f & 512 <> 0 THEN 'interface' WHEN f & 16384 <> 0 THEN 'enum' ELSE 'class' END AS kind
  FROM (SELECT {_FLAGS} AS f FROM events)) GROUP BY ALL""")
def flag_rollup(spark, sf):
    f = table(spark, sf, "events").selectExpr(f"{_FLAGS} AS f").select(L.decode_flags("f").alias("d")).select("d.*")
    return f.groupBy(*f.columns).agg(F.count(F.lit(1)).alias("n"))


_TOKENS_SQL = "regexp_extract_all(regexp_extract(descriptor, '^[(]([^)]*)', 1), '\\[*(?:L[^;]+;|[BCDFIJSZVXY?])')"


@query("descriptor_types", f"""
SELECT l_orderkey, l_linenumber, descriptor, array_to_string({_TOKENS_SQL}, ' ') AS params, len({_TOKENS_SQL}) AS arity,
  regexp_extract(descriptor, '[)](.*)$', 1) AS ret FROM (SELECT l_orderkey, l_linenumber, {DESCRIPTOR} AS descriptor FROM lineitem)""")
def descriptor_types(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{DESCRIPTOR} AS descriptor")
    return d.withColumn("d", L.explode_descriptor("descriptor")).select(
        "l_orderkey", "l_linenumber", "descriptor", F.array_join("d.param_types", " ").alias("params"),
        F.col("d.arity").cast("bigint").alias("arity"), F.col("d.return_type").alias("ret"))


def _type_sql(t: str) -> str:
    base = f"ltrim({t}, '[')"
    named = (f"CASE {base} WHEN 'I' THEN 'int' WHEN 'J' THEN 'long' WHEN 'Z' THEN 'boolean' WHEN 'D' THEN 'double' WHEN 'V' THEN 'void' "
             f"ELSE replace(split_part(replace(substr({base},2),';',''),'/',-1),'$','.') END")
    return f"{named} || repeat('[]', length({t}) - length({base}))"


def _spread_sql(t: str) -> str:
    base = f"ltrim({t}, '[')"
    return f"left({_type_sql(t)}, length({_type_sql(t)}) - 2) || '...'"


# First and second parameter of the generated descriptors, null when absent.
_P = "list_extract(ps, 1 + skip)"
_Q = "list_extract(ps, 2 + skip)"
_SIGNATURE_SQL = f"""
SELECT order_id, line_no, CASE
  WHEN kind = 'field' THEN name || ' : ' || {_type_sql('descriptor')}
  WHEN name = '<clinit>' THEN '{{...}}'
  ELSE CASE WHEN name = '<init>' THEN 'Ctor' ELSE name END || '(' || coalesce({_type_sql(_P)}, '') ||
    coalesce(', ' || CASE WHEN flags & 128 <> 0 AND {_Q} LIKE '[%' THEN {_spread_sql(_Q)} ELSE {_type_sql(_Q)} END, '') || ')' ||
    CASE WHEN name = '<init>' THEN '' ELSE ' : ' || {_type_sql('ret')} END END AS signature
FROM (SELECT *, {_TOKENS_SQL} AS ps, regexp_extract(descriptor, '[)](.*)$', 1) AS ret,
  CASE WHEN name = '<init>' AND order_id % 2 = 0 AND (order_id % 16) & 8 = 0 THEN 1 ELSE 0 END AS skip FROM {sub('members')})"""


@query("render_signature", _SIGNATURE_SQL)
def signatures(spark, sf):
    m = view(spark, sf, "members")
    return m.select("order_id", "line_no", L.render_signature(
        "kind", "name", "descriptor", "flags", F.lit("Ctor"), F.col("order_id") % 2 == 0,
        (F.col("order_id") % 16).cast("int")).alias("signature"))


@query("qualified_name", f"""
SELECT id, line_no, q AS qualified FROM (SELECT m.order_id AS id, m.line_no, replace(m.type_name, '/', '.') || '.' || m.name AS q FROM {sub('members')} m)""")
def qualified(spark, sf):
    m = view(spark, sf, "members")
    return m.select(F.col("order_id").alias("id"), "line_no", L.qualified_name(
        L.display_package("type_name"), L.simple_name("type_name"), "name").alias("qualified"))


@query("release_census", f"""
SELECT CASE WHEN major < 45 THEN NULL WHEN major < 49 THEN '1.' || cast(major - 44 AS string) ELSE cast(major - 44 AS string) END AS release,
  major >= 49 AS enums, major >= 51 AS invokedynamic, major >= 52 AS lambdas, major >= 53 AS indy_concat, major >= 60 AS switch_expressions,
  major >= 60 AS pattern_matching, major >= 61 OR (major = 60 AND minor = 65535) AS sealed, count(*) AS n FROM {sub('types')} GROUP BY ALL""")
def release_census(spark, sf):
    t = view(spark, sf, "types").select(L.release_label("major").alias("release"),
                                        L.release_features("major", "minor").alias("f")).select("release", "f.*")
    return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n"))


_PREFIXED = ("case size % 8 when 0 then 'org/' when 1 then 'com/google/' when 2 then 'com/sun/' when 3 then 'java/' when 4 then 'net/' "
             "when 5 then 'organic/' when 6 then 'edu/' else '' end || type_name")


@query("prefix_rules", f"""
SELECT id, path, CASE WHEN regexp_matches(path, '^(org|com/google|com/springsource|com/sun)/') THEN true WHEN path LIKE 'com/%' THEN false
  ELSE regexp_matches(path, '^(java|javax|sun|sunw|spring|springframework|springmodules|tomcat|maven|edu)/') END AS accepted
FROM (SELECT id, {_PREFIXED} AS path FROM {sub('types')})""")
def accepted(spark, sf):
    t = view(spark, sf, "types").selectExpr("id", f"{_PREFIXED} AS path")
    return t.withColumn("accepted", L.prefix_rules("path", DEFAULT_PREFIX_RULES))


@query("visible_members", f"""
SELECT order_id, line_no, kind, name, flags FROM {sub('members')}
WHERE CASE WHEN kind = 'field' THEN flags & 20480 = 0 ELSE flags & 20544 = 0 END""")
def visible(spark, sf):
    return L.visible_members(view(spark, sf, "members")).select("order_id", "line_no", "kind", "name", "flags")


_IDENT_SQL = "'[\\p{L}\\p{Nl}\\p{Sc}\\p{Pc}][\\p{L}\\p{Nl}\\p{Sc}\\p{Pc}\\p{Nd}\\p{Mn}\\p{Mc}]*'"
_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query("suspicious_names", f"""
SELECT source, count(*) AS n_names, cast(sum(CASE WHEN length(w) <= 2 OR NOT regexp_full_match(w, {_IDENT_SQL}) OR w IN ({_QUOTED(JAVA_KEYWORDS)})
  OR lower(w) IN ({_QUOTED(RESERVED_FILE_NAMES)}) OR length(w) > 249 THEN 1 ELSE 0 END) AS bigint) AS n_suspicious
FROM (SELECT DISTINCT source, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY source""")
def suspicious(spark, sf):
    words = table(spark, sf, "documents").select(
        "source", F.explode(F.array_distinct(F.split(F.translate("text", "\n", " "), " "))).alias("w"))
    names = words.filter("w <> ''").distinct()
    return names.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.sum(L.suspicious_name("w", F.lit("class")).cast("bigint")).alias("n_suspicious"))


@query("only_prefixes", """
SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'blue b%'""")
def prefixed(spark, sf):
    return L.only_prefixes(table(spark, sf, "part"), "p_name", ["red", "blue b"]).select("p_partkey", "p_name")


@query("package_of_source", f"""
SELECT id, CASE WHEN size % 5 = 0 THEN '' ELSE replace(short_type, '/', '.') END AS package FROM {sub('types')}""")
def source_package(spark, sf):
    text = F.expr("case when size % 5 = 0 then '' else concat('  package ', translate(short_type, '/', '.'), ' ;', chr(10)) end")
    src = view(spark, sf, "types").withColumn(
        "text", F.concat(F.lit("// package none\n"), text, F.lit("class A {}")))
    return src.select("id", L.package_of_source("text").alias("package"))
