"""Symbol search, trees, highlighting and text search."""

from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import search as S
from symlake.operators import text as T
from symlake.plans.fixtures import WORDS_SQL, sub, table, view, word_postings
from symlake.plans.registry import query


@query("symbol_search", f"""
SELECT DISTINCT container, entry_path FROM {WORDS_SQL}
WHERE (index_name IN ('typeDeclarations','typeReferences') AND regexp_full_match(key, 'th.re.*'))
  OR (index_name IN ('methodDeclarations','methodReferences','strings') AND regexp_full_match(key, 'th.re.*'))""")
def symbol_search(spark, sf):
    flags = m.SEARCH_TYPE | m.SEARCH_METHOD | m.SEARCH_STRING | m.SEARCH_DECLARATION | m.SEARCH_REFERENCE
    return S.symbol_search(word_postings(spark, sf), "th?re", flags)


def _type_postings(spark, sf):
    return view(spark, sf, "decls").selectExpr(
        f"'{m.TYPE_DECLARATIONS}' AS index_name", "type_name AS key", "container", "entry_path")


@query("open_type", f"""
SELECT split_part(type_name,'/',-1) AS short_name, type_name, count(*) AS n_locations, min(container) AS first_container,
  min(entry_path) FILTER (container = mc) AS first_entry FROM (SELECT *, min(container) OVER (PARTITION BY type_name) AS mc FROM
  (SELECT DISTINCT type_name, container, entry_path FROM {sub('decls')})) WHERE regexp_full_match(split_part(type_name,'/',-1), '.*[rR].*')
GROUP BY type_name ORDER BY 1, 2 LIMIT 80""")
def open_type(spark, sf):
    return S.open_type(_type_postings(spark, sf), "*r", 80)


@query("find_keys", f"""
SELECT index_name, key, container, entry_path FROM {WORDS_SQL}
WHERE key IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM benchmark) AND index_name = 'methodReferences'""")
def find_keys(spark, sf):
    wanted = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("key"))
    return S.find_keys(word_postings(spark, sf), wanted, m.METHOD_REFERENCES)


@query("outer_rollup", f"""
WITH RECURSIVE t AS (SELECT * FROM {sub('nested')}),
up(container, id, root) AS (SELECT container, id, id FROM t UNION ALL
  SELECT up.container, up.id, i.outer_id FROM up JOIN t i ON i.id = up.root AND i.container = up.container WHERE i.outer_id IS NOT NULL),
top AS (SELECT container, id, min(root) AS root FROM up GROUP BY container, id)
SELECT DISTINCT t.container, coalesce(r.entry_path, t.entry_path) AS entry_path FROM t JOIN top ON top.id = t.id
  LEFT JOIN t r ON r.id = top.root AND r.container = t.container WHERE t.label LIKE 'Red%'
UNION SELECT container, 'readme' || cast(id AS string) FROM t WHERE label LIKE 'Red%'""")
def outer_rollup(spark, sf):
    from symlake.operators.hierarchy import root_entries

    types = view(spark, sf, "nested")
    names = types.selectExpr("id AS outer_id", "type_name AS outer_name")
    roots = root_entries(types.join(names, "outer_id", "left"))
    red = types.filter(F.col("label").startswith("Red"))
    matches = red.select("container", "entry_path").unionByName(
        red.selectExpr("container", "'readme' || cast(id AS string) AS entry_path"))
    return S.outer_entries(matches, roots)


@query("filtered_tree", f"""
WITH p AS (SELECT DISTINCT container, entry_path FROM {sub('page_tree')}),
s AS (SELECT container, entry_path, string_split(entry_path,'/') AS s FROM p),
tree AS (SELECT DISTINCT container, array_to_string(s[1:i], '/') AS entry_path FROM (SELECT container, s, unnest(generate_series(1, len(s))) AS i FROM s)),
hit AS (SELECT DISTINCT container, array_to_string(s[1:i], '/') AS entry_path FROM (SELECT container, s, unnest(generate_series(1, len(s))) AS i FROM s WHERE entry_path LIKE '%/de/%'))
SELECT container, entry_path FROM tree SEMI JOIN hit USING (container, entry_path)""")
def filtered_tree(spark, sf):
    pages = view(spark, sf, "page_tree")
    tree = pages.select("container", F.explode(S.ancestor_paths(F.col("entry_path"))).alias("entry_path")).distinct()
    return S.filtered_tree(tree, pages.filter(F.col("entry_path").contains("/de/")))


def _occurrences(spark, sf):
    """Members as declarations and references, documents as strings."""
    rows = view(spark, sf, "members").selectExpr(
        "container", "'o' || cast(order_id AS string) AS entry_path",
        "case when flags % 2 = 0 then 'declaration' else 'reference' end AS role",
        "case when flags % 5 = 0 then 'type' else kind end AS kind", "type_name",
        "case when flags % 5 = 0 then null else name end AS name",
        "case when flags % 3 = 0 then 'com/Main' else type_name end AS owner",
        "line_no * 40 AS start", "line_no * 40 + length(name) AS `end`", "cast(null AS string) AS text")
    docs = table(spark, sf, "documents").selectExpr(
        "source AS container", "'doc' || cast(doc_id AS string) AS entry_path", "'string' AS role", "'string' AS kind",
        "cast(null AS string) AS type_name", "cast(null AS string) AS name", "'com/Main' AS owner", "100 AS start",
        "100 + length(text) AS `end`", "text")
    return rows.unionByName(docs)


_OCC_SQL = f"""(SELECT container, 'o' || cast(order_id AS string) AS entry_path, case when flags % 2 = 0 then 'declaration' else 'reference' end AS role,
  case when flags % 5 = 0 then 'type' else kind end AS kind, type_name, case when flags % 5 = 0 then null else name end AS name,
  case when flags % 3 = 0 then 'com/Main' else type_name end AS owner, line_no * 40 AS start, line_no * 40 + length(name) AS "end" FROM {sub('members')})"""
# Start of every hit: total length of the pieces and hits before it.
_HITS_SQL = lambda ids, needle, src: (
    f"(SELECT {ids}, g - 1 AS hit_no, cast(sum(length(piece)) OVER (PARTITION BY {ids} ORDER BY g) + (g - 1) * length('{needle}') AS bigint) AS hit_start "
    f"FROM (SELECT {ids}, unnest(pieces) AS piece, unnest(generate_series(1, len(pieces))) AS g, len(pieces) AS n FROM "
    f"(SELECT {ids}, string_split(text, '{needle}') AS pieces FROM {src})) QUALIFY g < n)")


@query("highlight_occurrences", f"""
SELECT DISTINCT container, entry_path, start, "end" FROM {_OCC_SQL} WHERE
  (kind = 'type' OR (kind = 'method' AND name = '<init>')) AND regexp_full_match(split_part(split_part(type_name,'/',-1),'$',-1), 'Re.G.*')
  AND CASE WHEN role = 'declaration' THEN type_name ELSE owner END = 'com/Main'
UNION SELECT DISTINCT container, entry_path, start, "end" FROM {_OCC_SQL} WHERE kind = 'type' AND role = 'reference' AND owner = 'com/Main'
  AND regexp_full_match(split_part(split_part(type_name,'/',-1),'$',-1), 'Re.G.*')
UNION SELECT DISTINCT container, entry_path, start, "end" FROM {_OCC_SQL} WHERE kind = 'method' AND name = '<init>' AND role = 'reference' AND owner = 'com/Main'
  AND regexp_full_match(split_part(split_part(type_name,'/',-1),'$',-1), 'Re.G.*')
UNION SELECT source, 'doc' || cast(doc_id AS string), 100 + hit_start, 100 + hit_start + 4
FROM {_HITS_SQL('source, doc_id', 'ReoG', 'documents')}""")
def highlight_occurrences(spark, sf):
    return S.highlight(_occurrences(spark, sf), "Re?G", "drtcs", "com/Main").select(
        "container", "entry_path", "start", "end")


@query("highlight_members", f"""
SELECT DISTINCT container, entry_path, start, "end" FROM {_OCC_SQL} WHERE role = 'declaration' AND kind IN ('field','method')
  AND regexp_full_match(name, 'aO.*')""")
def highlight_members(spark, sf):
    return S.highlight(_occurrences(spark, sf).filter("role <> 'string'"), "aO", "dfm")


@query("text_hits", f"""
SELECT doc_id, cast(hit_no AS bigint) AS hit_no, hit_start, hit_start + 3 AS hit_end FROM {_HITS_SQL('doc_id', 'the', 'documents')}""")
def text_hits(spark, sf):
    return T.text_hits(table(spark, sf, "documents"), ["doc_id"], "text", "the").select(
        "doc_id", F.col("hit_no").cast("bigint").alias("hit_no"), "hit_start", "hit_end")


@query("find_text_next", f"""
WITH h AS (SELECT conv_id, turn, hit_start FROM {_HITS_SQL('conv_id, turn', 'on', "(SELECT conv_id, turn, lower(text) AS text FROM conversations)")})
SELECT conv_id, turn, cast(turn * 20 AS bigint) AS caret, count(*) AS n_hits, coalesce(min(hit_start) FILTER (hit_start >= turn * 20), min(hit_start)) AS next_start,
  coalesce(min(hit_start) FILTER (hit_start >= turn * 20), min(hit_start)) + 2 AS next_end,
  coalesce(max(hit_start) FILTER (hit_start + 2 <= turn * 20), max(hit_start)) AS previous_start
FROM h GROUP BY conv_id, turn""")
def find_text_next(spark, sf):
    talks = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "cast(turn * 20 AS bigint) AS caret", "text")
    ahead = T.find_next(talks, ["conv_id", "turn"], "text", "on", "caret", case_sensitive=False)
    back = T.find_next(talks, ["conv_id", "turn"], "text", "on", "caret", case_sensitive=False, forward=False)
    return ahead.join(back.select("conv_id", "turn", F.col("next_start").alias("previous_start")), ["conv_id", "turn"])
