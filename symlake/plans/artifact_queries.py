"""Archives and class files. The tables hold none, so Spark first packs pages into archives and parts into class
files (inside tasks, one per row) and the readers then work on those."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from symlake import model as m
from symlake.plans.class_builder import ClassBuilder
from symlake.plans.fixtures import sub, table, view
from symlake.plans.registry import query
from symlake.session import ship_package
from symlake.sources.archives import expand_archives
from symlake.sources.classfile import ingest_classes

_FILE_SCHEMA = "container string, root_container string, depth int, content binary"


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


#: Pages packed at a time.
PACKED = 256


def _pack_pages(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, PACKED):
            rows = []
            for page in whole.slice(at, PACKED).to_pylist():
                page_id, html = page["page_id"], page["html"]
                inner = _zip({f"doc/p{page_id}.txt": str(page_id).encode()})
                name = f"file:/pages/{page_id}.war"
                rows.append({"container": name, "root_container": name, "depth": 0, "content": _zip({
                    "WEB-INF/web.xml": b"<web-app/>", "index.html": html.encode("utf-8"), "WEB-INF/lib/in.jar": inner})})
            kinds = [("container", pa.string()), ("root_container", pa.string()), ("depth", pa.int32()), ("content", pa.binary())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _page_archives(spark, sf):
    ship_package(spark)
    return expand_archives(table(spark, sf, "pages").select("page_id", "html").mapInArrow(_pack_pages, _FILE_SCHEMA))


@query("src_archive", """
WITH p AS (SELECT page_id, 'file:/pages/' || cast(page_id AS string) || '.war' AS c, strlen(html) AS n FROM pages)
SELECT c AS container, c AS root_container, 'war' AS container_type, 'WEB-INF' AS entry_path, '' AS parent_path, true AS is_dir, 0 AS depth, 0 AS n_bytes FROM p
UNION ALL SELECT c, c, 'war', 'WEB-INF/lib', 'WEB-INF', true, 0, 0 FROM p
UNION ALL SELECT c, c, 'war', 'WEB-INF/web.xml', 'WEB-INF', false, 0, 10 FROM p
UNION ALL SELECT c, c, 'war', 'index.html', '', false, 0, n FROM p
UNION ALL SELECT c || '!/WEB-INF/lib/in.jar', c, 'jar', 'doc', '', true, 1, 0 FROM p
UNION ALL SELECT c || '!/WEB-INF/lib/in.jar', c, 'jar', 'doc/p' || cast(page_id AS string) || '.txt', 'doc', false, 1, length(cast(page_id AS string)) FROM p""")
def src_archive(spark, sf):
    entries = _page_archives(spark, sf).filter("entry_path <> 'WEB-INF/lib/in.jar'")
    return entries.select("container", "root_container", "container_type", "entry_path", "parent_path", "is_dir",
                          "depth", F.coalesce(F.length("content"), F.lit(0)).alias("n_bytes"))


def _pack_types(batches):
    for b in batches:
        rows = []
        for t in b.itertuples(index=False):
            c = ClassBuilder(t.type_name, t.super_name, [t.face_name] if t.face_name else [], int(t.flags),
                             int(t.major), int(t.minor))
            c.member("field", 2, "f" + t.simple, "[L" + t.short_type + ";")
            c.member("method", 1, "<init>", "()V")
            c.member("method", 1, "run" + str(t.size), "(ILcom/acme/Arg;)V", exceptions=["com/acme/Oops"])
            c.string("text " + t.simple)
            c.long(7)
            c.ref(10, t.super_name, "<init>", "()V")
            c.ref(11, "com/acme/Face", "call" + str(t.size), "()V")
            c.ref(9, "com/acme/Box", "slot", "I")
            if t.outer_name:
                c.inner([(t.type_name, t.outer_name, t.simple, 8)])
            rows.append((t.container, t.entry_path, False, c.build()))
        yield pd.DataFrame(rows, columns=["container", "entry_path", "is_dir", "content"])


def _classes(spark, sf):
    ship_package(spark)
    t = view(spark, sf, "types")
    name = lambda c, out: t.select(F.col("id").alias(c), F.col("type_name").alias(out))
    full = (
        t.join(name("super_id", "super_name"), "super_id", "left").join(name("face_id", "face_name"), "face_id", "left")
        .join(name("outer_id", "outer_name"), "outer_id", "left")
        .withColumn("super_name", F.coalesce("super_name", F.lit("java/lang/Object")))
    )
    cols = ["container", "entry_path", "type_name", "super_name", "face_name", "outer_name", "simple", "short_type",
            "size", "flags", "major", "minor"]
    return ingest_classes(full.select(*cols).mapInPandas(
        _pack_types, "container string, entry_path string, is_dir boolean, content binary"))


_T = f"""t AS (SELECT a.*, coalesce(s.type_name, 'java/lang/Object') AS super_name, f.type_name AS face_name, o.type_name AS outer_name
  FROM {sub('types')} a LEFT JOIN {sub('types')} s ON s.id = a.super_id LEFT JOIN {sub('types')} f ON f.id = a.face_id LEFT JOIN {sub('types')} o ON o.id = a.outer_id)"""


@query("class_types", f"""
WITH {_T} SELECT container, entry_path, type_name, super_name, outer_name, CASE WHEN outer_name IS NOT NULL THEN simple END AS inner_name,
  CASE WHEN outer_name IS NOT NULL THEN 8 ELSE flags END AS flags, major, minor FROM t""")
def class_types(spark, sf):
    return _classes(spark, sf)["types"]


@query("class_postings", f"""
WITH {_T}, k AS (
  SELECT *, unnest([('typeDeclarations', type_name), ('fieldDeclarations', 'f' || simple), ('constructorDeclarations', type_name),
    ('methodDeclarations', 'run' || cast(size AS string)), ('typeReferences', short_type), ('typeReferences', 'com/acme/Arg'), ('typeReferences', 'com/acme/Oops'),
    ('strings', 'text ' || simple), ('constructorReferences', super_name), ('methodReferences', 'call' || cast(size AS string)), ('fieldReferences', 'slot'),
    ('typeReferences', 'com/acme/Face'), ('typeReferences', 'com/acme/Box'), ('typeReferences', super_name), ('typeReferences', type_name),
    ('typeReferences', face_name), ('typeReferences', outer_name)]) AS p FROM t)
SELECT DISTINCT p[1] AS index_name, p[2] AS key, container, entry_path FROM k WHERE p[2] IS NOT NULL""")
def class_postings(spark, sf):
    return _classes(spark, sf)["postings"]


@query("class_members", f"""
WITH t AS (SELECT * FROM {sub('types')})
SELECT container, type_name, 'field' AS kind, 'f' || simple AS name, '[L' || short_type || ';' AS descriptor, 2 AS flags FROM t
UNION ALL SELECT container, type_name, 'method', '<init>', '()V', 1 FROM t
UNION ALL SELECT container, type_name, 'method', 'run' || cast(size AS string), '(ILcom/acme/Arg;)V', 1 FROM t""")
def class_members(spark, sf):
    return _classes(spark, sf)["members"].drop("entry_path")


@query("class_supertypes", f"""
WITH {_T} SELECT container, type_name, super_name, 'class' AS kind FROM t
UNION ALL SELECT container, type_name, face_name, 'interface' FROM t WHERE face_name IS NOT NULL""")
def class_supertypes(spark, sf):
    return _classes(spark, sf)["supertypes"]


@query("index_round_trip", f"""
WITH {_T} SELECT 'typeReferences' AS index_name, super_name AS key, count(*) AS n_entries FROM t WHERE super_name <> type_name GROUP BY super_name""".replace(
    "WHERE super_name <> type_name ", "WHERE super_name LIKE 'com/promo/%' "))
def index_round_trip(spark, sf):
    """Postings through the stored index: one partition, one key prefix."""
    from symlake.operators.postings import usage_rank
    from symlake.session import Scratch
    from symlake.sources.index_store import read_index, write_index

    t = view(spark, sf, "types")
    supers = t.join(t.select(F.col("id").alias("super_id"), F.col("type_name").alias("key")), "super_id")
    rows = supers.select(F.lit(m.TYPE_REFERENCES).alias("index_name"), "key", "container", "entry_path").unionByName(
        t.select(F.lit(m.TYPE_DECLARATIONS).alias("index_name"), F.col("type_name").alias("key"), "container", "entry_path"))
    path = Scratch(spark, "index").path("store")
    write_index(rows, path, partitions=4)
    stored = read_index(spark, path).filter(
        (F.col("index_name") == m.TYPE_REFERENCES) & F.col("key").startswith("com/promo/"))
    return usage_rank(stored, distinct=True)
