"""Posting tables: grouping and counting."""

from pyspark.sql import functions as F

from symlake.operators import postings as P
from symlake.plans.fixtures import WORDS_SQL, sub, table, view, word_postings
from symlake.plans.registry import query


@query("postings_grouped", f"""
SELECT index_name, key, CAST((n - 1) // 100 AS INT) AS block, count(*) AS n_block, string_agg(container || '!' || entry_path, ' ' ORDER BY container, entry_path) AS entries
FROM (SELECT *, row_number() OVER (PARTITION BY index_name, key ORDER BY container, entry_path) AS n FROM (SELECT DISTINCT * FROM {WORDS_SQL}))
GROUP BY index_name, key, block""")
def postings_grouped(spark, sf):
    g = P.postings_grouped(word_postings(spark, sf), block_size=100)
    names = F.transform("entries", lambda e: F.concat(e["container"], F.lit("!"), e["entry_path"]))
    return g.select("index_name", "key", "block", F.col("n_block").cast("bigint").alias("n_block"),
                    F.array_join(names, " ").alias("entries"))


@query("subtype_lists", """
WITH e AS (SELECT r_name AS super_name, n_name AS sub FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT super_name, CAST((n - 1) // 25 AS INT) AS block, count(*) AS n_block, string_agg(sub, ' ' ORDER BY sub) AS sub_types
FROM (SELECT *, row_number() OVER (PARTITION BY super_name ORDER BY sub) AS n FROM e) GROUP BY super_name, block""")
def subtype_lists(spark, sf):
    n, r, c = (table(spark, sf, x) for x in ("nation", "region", "customer"))
    edges = n.join(r, F.expr("n_regionkey = r_regionkey")).selectExpr("r_name AS super_name", "n_name AS type_name").unionByName(
        c.join(n, F.expr("c_nationkey = n_nationkey")).selectExpr("n_name AS super_name", "c_name AS type_name"))
    return P.subtype_lists(edges, block_size=25).select("super_name", "block", F.col("n_block").cast("bigint").alias("n_block"),
                                         F.array_join("sub_types", " ").alias("sub_types"))


@query("match_counts", f"""
WITH m AS (SELECT DISTINCT container, entry_path FROM {WORDS_SQL} WHERE key LIKE 'Th%')
SELECT container, count(*) AS n_matches FROM m GROUP BY container UNION ALL SELECT NULL, count(*) FROM m""")
def match_counts(spark, sf):
    hits = word_postings(spark, sf).filter(F.col("key").startswith("Th"))
    return P.match_counts(hits)


@query("merge_locations", f"""
SELECT type_name, CAST((n - 1) // 2 AS INT) AS block, count(*) AS n_block, string_agg(container || '!' || entry_path, ' ' ORDER BY container, entry_path) AS locations
FROM (SELECT *, row_number() OVER (PARTITION BY type_name ORDER BY container, entry_path) AS n FROM (SELECT DISTINCT type_name, container, entry_path FROM {sub('decls')}))
GROUP BY type_name, block""")
def merge_locations(spark, sf):
    g = P.merge_locations(view(spark, sf, "decls"), block_size=2)
    names = F.transform("locations", lambda e: F.concat(e["container"], F.lit("!"), e["entry_path"]))
    return g.select("type_name", "block", F.col("n_block").cast("bigint").alias("n_block"),
                    F.array_join(names, " ").alias("locations"))


@query("ambiguous_declarations", f"""
SELECT type_name, count(*) AS n_entries, min(container) AS first_container, min(entry_path) FILTER (container = mc) AS first_entry
FROM (SELECT *, min(container) OVER (PARTITION BY type_name) AS mc FROM (SELECT DISTINCT type_name, container, entry_path FROM {sub('decls')}))
GROUP BY type_name HAVING count(*) > 1""")
def ambiguous(spark, sf):
    return P.ambiguous_declarations(view(spark, sf, "decls"))


@query("usage_rank", f"""
SELECT index_name, key, count(DISTINCT container || '!' || entry_path) AS n_entries FROM {WORDS_SQL} GROUP BY index_name, key""")
def usage_rank(spark, sf):
    return P.usage_rank(word_postings(spark, sf), distinct=True)


@query("union_containers", f"""
SELECT key, container, entry_path FROM {sub('decls')} UNION ALL
SELECT key, container, entry_path FROM {WORDS_SQL} WHERE index_name = 'typeDeclarations'""")
def union_containers(spark, sf):
    words = word_postings(spark, sf).filter("index_name = 'typeDeclarations'").select("key", "container", "entry_path")
    return P.union_containers(view(spark, sf, "decls").select("key", "container", "entry_path"), words)
