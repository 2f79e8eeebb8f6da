"""Code-corpus shaped views of the supplied tables.

Each view is a list of expressions in SQL that Spark and the checking database both accept, so ``view`` (a
DataFrame) and ``sub`` (a sub-select) describe the same rows. Views cover whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_W1, _W2 = "split_part(p_name,' ',1)", "split_part(p_name,' ',2)"
CAMEL = f"(upper(substr({_W1},1,1)) || substr({_W1},2) || upper(substr({_W2},1,1)) || substr({_W2},2))"
_SHORT = f"('com/' || lower(p_type) || '/' || {CAMEL})"
_HOST = "split_part(split_part(url,'://',2),'/',1)"
_PATH = ("trim(both '/' from substr(split_part(split_part(split_part(url,'#',1),'?',1),'://',2), "
         f"length({_HOST})+2))")
_REVERSED = "||".join(
    f"(case when split_part({_HOST},'.',-{i})<>'' then split_part({_HOST},'.',-{i})||'/' else '' end)"
    for i in range(1, 5))

DESCRIPTOR = (
    "('(' || repeat('[', cast(l_linenumber % 3 as int)) || "
    "case cast(l_quantity as int) % 4 when 0 then 'I' when 1 then 'J' when 2 then 'Lorg/acme/Node$Leaf;' else 'Z' end "
    "|| case when l_linenumber > 4 then '[Ljava/lang/String;' when l_linenumber > 2 then 'D' else '' end || ')' || "
    "case l_returnflag when 'A' then 'V' when 'N' then '[I' else 'Ljava/util/List;' end)"
)
MEMBER = (
    "(case when l_linenumber = 7 then '<init>' when l_linenumber = 6 and l_returnflag = 'A' then '<clinit>' "
    "else lower(l_returnflag) || 'Op' || cast(l_linenumber as string) end)"
)

# name -> (tables, join condition, {column: expression})
VIEWS: dict[str, tuple[list[str], str | None, dict[str, str]]] = {
    # Types: one per part, in the library of its brand, nested and inheriting along the part keys.
    "types": (["part"], None, {
        "id": "p_partkey",
        "container": "('lib' || substr(p_brand,7))",
        "simple": CAMEL,
        "short_type": _SHORT,
        "type_name": f"({_SHORT} || cast(p_partkey as string))",
        "entry_path": f"({_SHORT} || cast(p_partkey as string) || '.class')",
        "size": "p_size",
        "flags": "cast((p_partkey*31 + p_size*7) % 32768 as int)",
        "major": "cast(44 + p_size % 24 as int)",
        "minor": "cast(case when p_size % 7 = 0 then 65535 else 0 end as int)",
        "outer_id": "(case when p_size >= 10 and p_partkey > 0 then cast(floor(p_partkey/4) as bigint) end)",
        "super_id": "(case when p_size > 5 and p_partkey > 0 then cast(floor(p_partkey/3) as bigint) end)",
        "face_id": "(case when p_size % 2 = 0 and p_partkey > 0 then cast(floor(p_partkey/5) as bigint) end)",
    }),
    # Nested types of one container: runs of consecutive parts enclose each other.
    "nested": (["part"], None, {
        "id": "p_partkey",
        "container": "('app' || cast(cast(floor(p_partkey/200) as bigint) as string))",
        "type_name": f"('com/' || lower(p_type) || '/T' || cast(p_partkey as string))",
        "entry_path": f"('com/' || lower(p_type) || '/T' || cast(p_partkey as string) || '.class')",
        "outer_id": "(case when p_size > 12 and p_partkey > 0 then p_partkey - 1 end)",
        "label": CAMEL,
    }),
    "members": (["lineitem", "part"], "l_partkey = p_partkey", {
        "container": "('lib' || substr(p_brand,7))",
        "type_name": f"({_SHORT} || cast(p_partkey as string))",
        "kind": "(case when l_linenumber = 1 then 'field' else 'method' end)",
        "name": MEMBER,
        "descriptor": f"(case when l_linenumber = 1 then case l_returnflag when 'A' then '[I' when 'N' then 'Z' else "
                      f"'Ljava/lang/String;' end else {DESCRIPTOR} end)",
        "flags": "cast((l_orderkey*13 + l_linenumber*128) % 32768 as int)",
        "order_id": "l_orderkey",
        "line_no": "l_linenumber",
    }),
    # References from order lines to part names; the library of the reference comes from the supplier key.
    "refs": (["lineitem", "part"], "l_partkey = p_partkey", {
        "ref_id": "l_orderkey",
        "ref_line": "l_linenumber",
        "container": "('lib' || cast(l_suppkey % 40 as string))",
        "key": CAMEL,
        "type_name": f"({_SHORT} || cast(p_partkey as string))",
        "size": "p_size",
    }),
    # Declarations: simple names repeated over the libraries.
    "decls": (["part"], None, {
        "key": CAMEL,
        "type_name": _SHORT,
        "container": "('lib' || substr(p_brand,7))",
        "entry_path": f"({_SHORT} || '$' || cast(p_partkey as string) || '.class')",
        "size": "p_size",
    }),
    # Files of all kinds: one per order, in the container of the customer.
    "files": (["orders"], None, {
        "container": "('c' || cast(o_custkey as string))",
        "container_type": "(case substr(o_orderpriority,1,1) when '1' then 'jar' when '2' then 'war' when '3' then 'ear' "
                          "when '4' then 'jmod' else 'generic' end)",
        "entry_path": (
            "(case cast(o_orderkey % 24 as int) when 0 then 'META-INF/MANIFEST.MF' "
            "when 1 then 'META-INF/services/com.acme.S' || cast(o_orderkey as string) "
            "when 2 then 'WEB-INF/web.xml' when 3 then 'META-INF/ejb-jar.xml' "
            "when 4 then 'META-INF/maven/g' || cast(o_orderkey % 5 as string) || '/a' || o_orderstatus || '/pom.properties' "
            "when 5 then 'classes/module-info.class' when 6 then 'WEB-INF/lib/x' || cast(o_orderkey as string) || '.jar' "
            "when 7 then 'com/acme/LICENSE' when 8 then 'META-INF/versions' when 9 then 'WEB-INF/classes/com' "
            "when 10 then 'classes/com/acme' when 11 then 'README' "
            "when 12 then 'com/acme/O' || cast(o_orderkey as string) || '$In' || cast(o_custkey % 5 as string) || '.class' "
            "else 'com/acme/F' || cast(o_orderkey as string) || '.' || case cast(o_custkey % 11 as int) when 0 then 'class' "
            "when 1 then 'html' when 2 then 'xml' when 3 then 'xsd' when 4 then 'png' when 5 then 'yml' when 6 then 'java' "
            "when 7 then 'zip' when 8 then 'css' when 9 then 'dat' else 'class' end end)"),
        "is_dir": "(o_orderkey % 24 in (8,9,10))",
        "length": "cast(floor(o_totalprice) as bigint)",
        "order_id": "o_orderkey",
    }),
    # Web pages as entries of their host.
    "pages": (["pages"], None, {
        "page_id": "page_id",
        "container": _HOST,
        "root_container": f"(split_part({_HOST},'.',-2) || '.' || split_part({_HOST},'.',-1))",
        "entry_path": _PATH,
        "url": "url",
    }),
    # The same pages as one deep tree: reversed host, then path.
    "page_tree": (["pages"], None, {
        "page_id": "page_id",
        "container": f"split_part({_HOST},'.',-1)",
        "entry_path": f"({_REVERSED} || {_PATH})",
    }),
    # Log lines: one per event.
    "log_lines": (["events"], None, {
        "event_id": "event_id",
        "source": "('u' || cast(user_id as string) || '.log')",
        "text": (
            "(case when value < 3 then 'Caused by: com.acme.Failure' when value < 5 then chr(9) || 'at nowhere' else "
            "chr(9) || 'at ' || case when event_type = 'purchase' then 'app//java.base@17/' else '' end || 'com.' || "
            "event_type || '.Svc' || cast(user_id % 120 as string) || case when event_type = 'view' then '$Row' else '' end "
            "|| case when event_type = 'signup' then '.<init>(Native Method)' else '.run(Svc' || "
            "cast(user_id % 120 as string) || '.java:' || cast(cast(floor(value/10) as bigint) as string) || ')' end end)"),
    }),
    "log_decls": (["supplier"], None, {
        "type_name": "('com/' || case s_suppkey % 4 when 0 then 'click' when 1 then 'view' when 2 then 'signup' "
                     "else 'purchase' end || '/Svc' || cast(s_suppkey % 120 as string) || "
                     "case when s_suppkey % 4 = 1 then '$Row' else '' end)",
        "container": "('lib' || cast(s_nationkey as string))",
        "entry_path": "('com/s' || cast(s_suppkey as string) || '.class')",
    }),
}


# Columns that are never null. Saying so keeps the optimizer from repeating their expressions in null checks.
_FILLED = {"container", "simple", "short_type", "type_name", "entry_path", "label", "kind", "name", "descriptor", "key",
           "container_type", "root_container", "source", "text"}
VIEWS = {
    name: (tables, condition, {c: f"coalesce({e},'')" if c in _FILLED else e for c, e in columns.items()})
    for name, (tables, condition, columns) in VIEWS.items()
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables, condition, columns = VIEWS[name]
    df = table(spark, sf, tables[0])
    for other in tables[1:]:
        df = df.join(table(spark, sf, other), F.expr(condition))
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sub(name: str) -> str:
    tables, condition, columns = VIEWS[name]
    source = " JOIN ".join(tables) + (f" ON {condition}" if condition else "")
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


# Words of the documents as symbol postings.
WORD = "[A-Za-z]+"
WORD_INDEX = (
    "case when substr(key,1,1) between 'A' and 'Z' then case when length(key) > 6 then 'typeReferences' else "
    "'typeDeclarations' end when length(key) > 6 then 'methodReferences' when length(key) > 4 then 'fieldReferences' "
    "when length(key) > 3 then 'methodDeclarations' else 'strings' end"
)


def word_postings(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), 0))
    return (
        table(spark, sf, "documents")
        .select("source", "doc_id", F.explode(words).alias("key"))
        .selectExpr(f"{WORD_INDEX} AS index_name", "key", "source AS container",
                    "'doc' || cast(doc_id as string) AS entry_path")
    )


WORDS_SQL = (
    f"(SELECT {WORD_INDEX} AS index_name, key, container, entry_path FROM (SELECT source AS container, 'doc' || "
    f"cast(doc_id as string) AS entry_path, unnest(list_distinct(regexp_extract_all(text, '{WORD}'))) AS key "
    "FROM documents))"
)


def ids_to_names(types: DataFrame, id_col: str, out: str) -> DataFrame:
    """Adds the type name behind a part key."""
    names = types.select(F.col("id").alias(id_col), F.col("type_name").alias(out))
    return types.join(names, id_col, "left")
