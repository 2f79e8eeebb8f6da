"""Type hierarchies and trees."""

from pyspark.sql import functions as F

from symlake.operators import hierarchy as H
from symlake.operators import ordering as O
from symlake.plans.fixtures import sub, table, view
from symlake.plans.registry import query


def _supers(spark, sf):
    """Types with their super type; roots extend a type outside the corpus."""
    t = view(spark, sf, "types")
    names = t.selectExpr("id AS super_id", "type_name AS super_name")
    return t.withColumn("flags", F.lit(1)).join(names, "super_id", "left").withColumn(
        "super_name", F.coalesce("super_name", F.lit("java/lang/Object")))


def _supertypes(spark, sf):
    t = view(spark, sf, "types")
    names = t.selectExpr("id AS up", "type_name AS super_name")
    edge = lambda c, kind: t.filter(F.col(c).isNotNull()).selectExpr("container", "type_name", f"{c} AS up").join(
        names, "up").select("container", "type_name", "super_name", F.lit(kind).alias("kind"))
    return edge("super_id", "class").unionByName(edge("face_id", "interface"))


@query("outermost", f"""
WITH RECURSIVE t AS (SELECT id, type_name, outer_id FROM {sub('types')}),
up(id, root, depth) AS (SELECT id, outer_id, 1 FROM t WHERE outer_id IS NOT NULL UNION ALL
  SELECT up.id, t.outer_id, up.depth + 1 FROM up JOIN t ON t.id = up.root WHERE t.outer_id IS NOT NULL),
last AS (SELECT id, max(depth) AS depth FROM up GROUP BY id)
SELECT t.type_name AS inner_name, r.type_name AS root_name, last.depth FROM last JOIN up USING (id, depth) JOIN t ON t.id = last.id JOIN t r ON r.id = up.root""")
def outermost(spark, sf):
    t = view(spark, sf, "types")
    names = t.selectExpr("id AS outer_id", "type_name AS outer_name")
    return H.outermost(t.join(names, "outer_id").selectExpr("type_name AS inner_name", "outer_name"))


@query("display_names", f"""
WITH RECURSIVE t AS (SELECT *, CASE WHEN outer_id IS NULL THEN split_part(type_name,'/',-1) ELSE label END AS own FROM {sub('nested')}),
up(container, id, pos, name) AS (SELECT container, id, outer_id, own FROM t UNION ALL
  SELECT up.container, up.id, o.outer_id, o.own || '.' || up.name FROM up JOIN t o ON o.id = up.pos AND o.container = up.container),
ends AS (SELECT up.* FROM up LEFT JOIN t o ON o.id = up.pos AND o.container = up.container WHERE o.id IS NULL),
short AS (SELECT id, split_part(type_name,'/',-1) AS s FROM t)
SELECT t.container, t.type_name, CASE WHEN ends.pos IS NULL THEN ends.name ELSE short.s || '.' || ends.name END AS display_name
FROM ends JOIN t ON t.id = ends.id LEFT JOIN short ON short.id = ends.pos""")
def display_names(spark, sf):
    t = view(spark, sf, "nested")
    names = t.selectExpr("id AS outer_id", "type_name AS outer_name")
    types = t.join(names, "outer_id", "left").withColumn(
        "inner_name", F.when(F.col("outer_name").isNotNull(), F.col("label")))
    return H.display_names(types)


_UP_SQL = f"""t AS (SELECT id, type_name, super_id FROM {sub('types')}),
up(id, a, depth) AS (SELECT id, super_id, 1 FROM t UNION ALL SELECT up.id, t.super_id, up.depth + 1 FROM up JOIN t ON t.id = up.a)"""


@query("ancestors", f"""
WITH RECURSIVE {_UP_SQL}
SELECT t.type_name, coalesce(s.type_name, 'java/lang/Object') AS ancestor, up.depth, s.id IS NOT NULL AS in_corpus
FROM up JOIN t ON t.id = up.id LEFT JOIN t s ON s.id = up.a""")
def ancestors(spark, sf):
    return H.ancestors(_supers(spark, sf))


_EDGES_SQL = f"""t AS (SELECT * FROM {sub('types')}),
e AS (SELECT t.type_name AS sub, s.type_name AS sup FROM t JOIN t s ON s.id = t.super_id UNION SELECT t.type_name, s.type_name FROM t JOIN t s ON s.id = t.face_id)"""


@query("descendants", f"""
WITH RECURSIVE {_EDGES_SQL},
seed AS (SELECT DISTINCT type_name FROM t WHERE size BETWEEN 40 AND 43),
down(a, d, depth) AS (SELECT seed.type_name, e.sub, 1 FROM seed JOIN e ON e.sup = seed.type_name UNION
  SELECT down.a, e.sub, down.depth + 1 FROM down JOIN e ON e.sup = down.d)
SELECT a AS type_name, d AS descendant, min(depth) AS depth FROM down GROUP BY a, d""")
def descendants(spark, sf):
    seeds = view(spark, sf, "types").filter("size BETWEEN 40 AND 43").select("type_name")
    return H.descendants(_supertypes(spark, sf), seeds)


@query("instance_of", f"""
WITH RECURSIVE {_EDGES_SQL},
pair AS (SELECT DISTINCT a.type_name AS a, b.type_name AS b FROM lineitem JOIN t a ON a.id = l_partkey JOIN t b ON b.id = l_linenumber),
up(a, d) AS (SELECT type_name, type_name FROM t UNION SELECT up.a, e.sup FROM up JOIN e ON e.sub = up.d)
SELECT pair.a, pair.b, up.a IS NOT NULL AS is_instance FROM pair LEFT JOIN up ON up.a = pair.a AND up.d = pair.b""")
def instance_of(spark, sf):
    t = view(spark, sf, "types")
    pairs = (
        table(spark, sf, "lineitem").select("l_partkey", F.col("l_linenumber").cast("bigint").alias("n")).distinct()
        .join(t.selectExpr("id AS l_partkey", "type_name AS a"), "l_partkey")
        .join(t.selectExpr("id AS n", "type_name AS b"), "n").select("a", "b").distinct()
    )
    return H.instance_of(pairs, _supertypes(spark, sf))


@query("common_super", f"""
WITH RECURSIVE {_UP_SQL},
line AS (SELECT id, id AS a, 0 AS depth FROM t UNION ALL SELECT id, coalesce(a, -1), depth FROM up),
pair AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem),
c AS (SELECT pair.x, pair.y, i.a, i.depth FROM pair JOIN line i ON i.id = pair.x JOIN line j ON j.id = pair.y AND j.a = i.a),
best AS (SELECT x, y, min(depth) AS depth FROM c GROUP BY x, y)
SELECT p.type_name AS a, q.type_name AS b, coalesce(s.type_name, 'java/lang/Object') AS common_super
FROM best JOIN c USING (x, y, depth) JOIN t p ON p.id = c.x JOIN t q ON q.id = c.y LEFT JOIN t s ON s.id = c.a""")
def common_super(spark, sf):
    t = view(spark, sf, "types")
    pairs = (
        table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
        .join(t.selectExpr("id AS l_partkey", "type_name AS a"), "l_partkey")
        .join(t.selectExpr("id AS l_suppkey", "type_name AS b"), "l_suppkey").select("a", "b")
    )
    return H.first_common_super(pairs, _supers(spark, sf))


@query("resolve_member", f"""
WITH RECURSIVE {_UP_SQL},
line AS (SELECT id, id AS a, 0 AS depth FROM t UNION ALL SELECT id, a, depth FROM up WHERE a IS NOT NULL),
m AS (SELECT DISTINCT l_partkey AS id, {{name}} AS name FROM lineitem),
r AS (SELECT DISTINCT l_partkey AS id, 'nOp' || cast(l_suppkey % 9 + 1 AS string) AS name FROM lineitem),
hit AS (SELECT r.id, r.name, min(line.depth) AS depth FROM r JOIN line ON line.id = r.id JOIN m ON m.id = line.a AND m.name = r.name GROUP BY ALL)
SELECT t.type_name, r.name, f.type_name AS found_type, hit.depth FROM r JOIN t ON t.id = r.id LEFT JOIN hit ON hit.id = r.id AND hit.name = r.name
LEFT JOIN line ON line.id = hit.id AND line.depth = hit.depth LEFT JOIN t f ON f.id = line.a""".replace(
    "{name}", "lower(l_returnflag) || 'Op' || cast(l_linenumber AS string)"))
def resolve_member(spark, sf):
    t = view(spark, sf, "types").selectExpr("id AS l_partkey", "type_name", "container")
    items = table(spark, sf, "lineitem")
    members = items.selectExpr(
        "l_partkey", "lower(l_returnflag) || 'Op' || cast(l_linenumber AS string) AS name").distinct().join(
        t, "l_partkey").withColumn("descriptor", F.lit("(I)V"))
    refs = items.selectExpr("l_partkey", "'nOp' || cast(l_suppkey % 9 + 1 AS string) AS name").distinct().join(
        t, "l_partkey").withColumn("descriptor", F.lit("(?)V"))
    return H.resolve_member(refs, members, _supers(spark, sf), wild_decls=False).select("type_name", "name", "found_type", "depth")


@query("compact_tree", f"""
WITH RECURSIVE p AS (SELECT DISTINCT container, entry_path, string_split(entry_path,'/') AS s FROM {sub('page_tree')}),
d AS (SELECT DISTINCT container, array_to_string(s[1:i], '/') AS entry_path FROM (SELECT container, s, unnest(generate_series(1, len(s) - 1)) AS i FROM p)),
e AS (SELECT container, entry_path, 1 AS dir FROM d UNION ALL SELECT container, entry_path, 0 FROM p),
k AS (SELECT container, regexp_extract(entry_path, '^(.*)/[^/]*$', 1) AS parent, min(entry_path) AS only FROM e GROUP BY ALL HAVING count(*) = 1 AND sum(dir) = 1),
heads AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.parent <> '' AND k.container = d.container AND k.only = d.entry_path)),
walk(container, head, pos) AS (SELECT container, entry_path, entry_path FROM heads UNION ALL
  SELECT w.container, w.head, k.only FROM walk w JOIN k ON k.container = w.container AND k.parent = w.pos)
SELECT container, head AS head_path, max(pos) AS entry_path, replace(substr(max(pos), length(regexp_extract(head, '^(.*/)[^/]*$', 1)) + 1), '/', '.') AS label
FROM walk GROUP BY container, head""")
def compact_tree(spark, sf):
    from symlake.operators.search import ancestor_paths

    pages = view(spark, sf, "page_tree").select("container", "entry_path").distinct()
    levels = ancestor_paths(F.col("entry_path"))
    folders = pages.select("container", F.explode(F.slice(levels, F.lit(1), F.size(levels) - 1)).alias("entry_path"))
    return H.compact_tree(folders, pages)


@query("outline", f"""
SELECT container, type_name, CAST((n - 1) // 3 AS INT) AS block, count(*) AS n_block, string_agg(kind || ':' || name, ' ' ORDER BY kind, name) AS members
FROM (SELECT *, row_number() OVER (PARTITION BY container, type_name ORDER BY kind, name) AS n FROM (SELECT DISTINCT container, type_name, kind, name FROM {sub('members')}))
GROUP BY container, type_name, block""")
def outline(spark, sf):
    m = view(spark, sf, "members").select("container", "type_name", "kind", "name").distinct()
    shown = F.transform("members", lambda x: F.concat(x["kind"], F.lit(":"), x["label"]))
    return O.outline(m, "name", block_size=3).select("container", "type_name", "block", "n_block", F.array_join(shown, " ").alias("members"))
