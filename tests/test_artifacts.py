"""Archives, directories, class files, stored indexes, exports and the incremental index on generated files."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import extract as X
from symlake.operators.hierarchy import root_entries
from symlake.operators.resolve import remove_inner
from symlake.plans.class_builder import ClassBuilder
from symlake.sources import archives as A
from symlake.sources.classfile import ingest_classes, signature_types
from symlake.sources.classify import EXTRACTOR_RULES, classify, rule_table
from symlake.sources.export import export_entries, export_plan
from symlake.sources.index_store import read_index, write_index
from symlake.streaming.index import read_stream_index, stream_index


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def outer_class():
    c = ClassBuilder("a/Outer", "a/Base", ["a/Face"], major=55)
    c.member("field", 1, "list", "Ljava/util/List;", signature="Ljava/util/List<La/Item;>;")
    c.member("method", 1, "<init>", "()V")
    c.member("method", 8, "<clinit>", "()V")
    c.member("method", 1, "go", "([Ljava/lang/String;)V", exceptions=["a/Oops"], annotations=["Lann/Test;"])
    c.string("hello")
    c.string("nul\x00 and é")
    c.long(1 << 40)
    c.ref(10, "a/Tool", "<init>", "()V")
    c.ref(10, "a/Tool", "work", "()V")
    c.ref(9, "a/Tool", "size", "I")
    c.klass("[[La/Arr;")
    c.inner([("a/Outer$In", "a/Outer", "In", 8)])
    return c.build()


def inner_class():
    c = ClassBuilder("a/Outer$In", "a/Outer")
    c.inner([("a/Outer$In", "a/Outer", "In", 8)])
    return c.build()


def module_info():
    c = ClassBuilder("module-info", None, flags=0x8000, major=53)
    c.module("my.mod", requires=["java.base"], exports=[("a", ["friend.mod"])], opens=[("b", ["other.mod"])], uses=["a/Service"],
             provides=[("a/Spi", ["a/Impl"])], main="a/Main")
    return c.build()


JAR = {
    "META-INF/MANIFEST.MF": b"Manifest-Version: 1.0\r\nMain-Class: a.Ou\r\n ter\r\n",
    "META-INF/services/a.B": b"# comment\na.Impl\n\n  b.Other  \n",
    "META-INF/maven/g/x/pom.properties": b"groupId=g\nartifactId=x\nversion=1.0\n",
    "a/Outer.class": outer_class(),
    "a/Outer$In.class": inner_class(),
    "a/Loose$X.class": ClassBuilder("a/Loose$X").build(),
    "a/Broken.class": b"\xca\xfe\xba\xbe\x00",
    "notes.txt": "näh".encode(),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "sub").mkdir()
    jar = zipped(JAR)
    (d / "lib.jar").write_bytes(jar)
    (d / "sub" / "app.war").write_bytes(zipped({
        "WEB-INF/web.xml": b"<web-app><servlet><servlet-class>a.Outer</servlet-class></servlet></web-app>",
        "WEB-INF/lib/inner.jar": jar, "WEB-INF/lib/bad.zip": b"PK broken"}))
    (d / "m.jmod").write_bytes(b"JM\x01\x00" + zipped({"classes/module-info.class": module_info(), "classes/a/Main.class": ClassBuilder("a/Main").build()}))
    (d / "cut.zip").write_bytes(jar[: len(jar) // 2])
    (d / "plain.txt").write_text("not an archive")
    (d / "sub" / "deep").mkdir()
    (d / "sub" / "deep" / "x.log").write_text("line 1\n\tat a.Outer.go(Outer.java:3)\n")
    return str(d)


@pytest.fixture(scope="module")
def entries(spark, folder):
    return A.read_archives(spark, folder).cache()


@pytest.fixture(scope="module")
def symbols(entries):
    return ingest_classes(entries)


def by_path(df, container_end, *cols):
    return {r[0]: tuple(r)[1:] for r in df.filter(F.col("container").endswith(container_end)).select("entry_path", *cols).collect()}


def test_members_and_directories(entries):
    got = by_path(entries, "/lib.jar", "is_dir", "parent_path", "container_type", "depth", "length")
    assert {p for p, v in got.items() if not v[0]} == set(JAR)
    assert got["META-INF/services"] == (True, "META-INF", "jar", 0, 0)
    assert got["notes.txt"] == (False, "", "jar", 0, len(JAR["notes.txt"]))
    assert got["a/Outer.class"][1] == "a"


def test_nested_archives_keep_their_root(entries):
    inner = entries.filter(F.col("container").endswith("app.war!/WEB-INF/lib/inner.jar"))
    assert inner.filter("not is_dir").count() == len(JAR)
    row = inner.select("depth", "root_container", "container_type").distinct().collect()
    assert len(row) == 1 and row[0][0] == 1 and row[0][1].endswith("app.war") and row[0][2] == "jar"


def test_broken_archives_are_reported(entries):
    bad = {r["container"].rsplit("/", 1)[-1]: r["error"] for r in entries.filter("error is not null").collect()}
    assert set(bad) == {"cut.zip", "bad.zip"}
    assert all("BadZipFile" in e for e in bad.values())


def test_size_limit_keeps_the_row(spark, folder):
    got = by_path(A.read_archives(spark, folder, max_member_bytes=50), "/lib.jar", "content", "error", "length")
    assert set(got) >= set(JAR)
    assert got["a/Outer.class"][0] is None and "above the limit" in got["a/Outer.class"][1]
    assert got["notes.txt"][1] is None


def test_nested_expansion_in_two_steps(spark, folder, entries):
    flat = A.read_archives(spark, folder, max_depth=0)
    assert flat.filter("depth > 0").count() == 0
    both = flat.unionByName(A.expand_nested(flat))
    cols = ["container", "entry_path", "is_dir", "length", "depth"]
    assert both.select(*cols).exceptAll(entries.select(*cols)).count() == 0
    assert both.count() == entries.count()


def test_directory_scan(spark, folder):
    d = A.read_directory(spark, folder, with_content=False)
    assert {r[0] for r in d.select("entry_path").collect()} == {
        "lib.jar", "sub/app.war", "m.jmod", "cut.zip", "plain.txt", "sub/deep/x.log"}
    assert {r[0] for r in A.read_directory(spark, folder, max_depth=2).select("entry_path").collect()} == {
        "lib.jar", "sub/app.war", "m.jmod", "cut.zip", "plain.txt"}


def keys(symbols, entry, index):
    return {r[0] for r in symbols["postings"].filter(
        (F.col("entry_path") == entry) & F.col("container").endswith("/lib.jar") & (F.col("index_name") == index)).select("key").collect()}


def test_class_postings(symbols):
    k = lambda i: keys(symbols, "a/Outer.class", i)
    assert k(m.TYPE_DECLARATIONS) == {"a/Outer"}
    assert k(m.CONSTRUCTOR_DECLARATIONS) == {"a/Outer"}
    assert k(m.METHOD_DECLARATIONS) == {"go"}
    assert k(m.FIELD_DECLARATIONS) == {"list"}
    assert k(m.STRINGS) == {"hello", "nul\x00 and é"}
    assert k(m.CONSTRUCTOR_REFERENCES) == {"a/Tool"}
    assert k(m.METHOD_REFERENCES) == {"work"}
    assert k(m.FIELD_REFERENCES) == {"size"}
    assert k(m.TYPE_REFERENCES) == {
        "a/Outer", "a/Base", "a/Face", "a/Oops", "a/Tool", "a/Outer$In", "a/Arr", "a/Item", "java/util/List",
        "java/lang/String", "ann/Test", "ann/Level"}


def test_class_tables(symbols):
    types = {r["type_name"]: r for r in symbols["types"].filter(F.col("container").endswith("/lib.jar")).collect()}
    assert set(types) == {"a/Outer", "a/Outer$In", "a/Loose$X"}
    assert (types["a/Outer$In"]["outer_name"], types["a/Outer$In"]["inner_name"], types["a/Outer$In"]["flags"]) == ("a/Outer", "In", 8)
    assert types["a/Outer"]["major"] == 55 and types["a/Outer"]["super_name"] == "a/Base"
    sup = {(r["super_name"], r["kind"]) for r in symbols["supertypes"].filter("type_name = 'a/Outer'").collect()}
    assert sup == {("a/Base", "class"), ("a/Face", "interface")}
    members = symbols["members"].filter("type_name = 'a/Outer'").select("kind", "name", "descriptor").distinct()
    assert members.count() == 4
    errors = symbols["errors"].select("entry_path").distinct().collect()
    assert [r[0] for r in errors] == ["a/Broken.class"]


def test_module_description(symbols):
    rows = {(r["index_name"], r["key"]) for r in symbols["postings"].filter(F.col("entry_path") == "classes/module-info.class").collect()}
    assert rows == {(m.MODULE_DECLARATIONS, "my.mod")} | {
        (m.MODULE_REFERENCES, x) for x in ("java.base", "friend.mod", "other.mod")} | {
        (m.TYPE_REFERENCES, x) for x in ("a/Service", "a/Spi", "a/Impl", "a/Main")}


def test_signature_types():
    assert signature_types("<T:Ljava/lang/Object;>(TT;[La/B<TLIST;La/C;>.Inner;I)V") == {"java/lang/Object", "a/B", "a/C"}
    assert signature_types("(TLIST;)TLIST;") == set()


def test_inner_classes_and_roots(entries, symbols):
    files = entries.filter("not is_dir").filter(F.col("container").endswith("/lib.jar"))
    kept = {r[0] for r in remove_inner(files, symbols["inner_classes"]).select("entry_path").collect()}
    assert kept == set(JAR) - {"a/Outer$In.class"}
    roots = {r["entry_path"]: r["root_entry"] for r in root_entries(symbols["types"]).filter(F.col("container").endswith("/lib.jar")).collect()}
    assert roots == {"a/Outer.class": "a/Outer.class", "a/Outer$In.class": "a/Outer.class", "a/Loose$X.class": "a/Loose$X.class"}


def test_export(spark, entries, symbols, tmp_path):
    plan = export_plan(entries, symbols["inner_classes"])
    got = by_path(plan, "/lib.jar", "target_path")
    assert got["a/Outer.class"] == ("a/Outer.java",) and "a/Outer$In.class" not in got
    assert by_path(plan, "app.war", "target_path")["WEB-INF/lib/inner.jar"] == ("WEB-INF/lib/inner-sources.jar",)
    export_entries(plan, entries, str(tmp_path / "out"))
    back = {(r["container"], r["target_path"]): bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r["container"], r["entry_path"]): bytes(r["content"]) for r in entries.filter("content IS NOT NULL").collect()}
    planned = plan.join(entries.filter("content IS NOT NULL").select("container", "entry_path"), ["container", "entry_path"]).collect()
    assert back == {(r["container"], r["target_path"]): whole[r["container"], r["entry_path"]] for r in planned}
    assert any(k[1].endswith(".java") for k in back) and sum(v.decode("utf-8", "replace") == "näh" for v in back.values()) == 2


def test_text_extractors(entries):
    text = entries.filter("content is not null and not is_dir").withColumn("text", F.decode("content", "UTF-8"))
    lib = text.filter(F.col("container").endswith("/lib.jar"))
    refs = X.service_refs(lib.filter("entry_path like 'META-INF/services/%'"))
    assert {r["key"] for r in refs.collect()} == {"a/Impl", "b/Other"}
    points = X.manifest_entrypoints(lib.filter("entry_path like '%MANIFEST.MF'")).collect()
    assert [r["fragment"] for r in points] == ["a/Outer-main-([Ljava/lang/String;)V"]
    assert [tuple(r)[1:] for r in X.coordinates(lib).collect()] == [("g", "x", "1.0")]
    web = X.web_type_refs(text.filter("entry_path = 'WEB-INF/web.xml'"))
    assert [r["key"] for r in web.collect()] == ["a/Outer"]
    packages = X.package_declarations(entries.filter(F.col("container").endswith("m.jmod")))
    assert [r["key"] for r in packages.collect()] == ["a"]


def test_classify_archive_entries(spark, entries):
    kinds = by_path(classify(entries), "/lib.jar", "kind")
    assert kinds["META-INF"] == ("metainf-dir",) and kinds["a"] == ("package",)
    assert kinds["META-INF/services/a.B"] == ("service",) and kinds["META-INF/MANIFEST.MF"] == ("manifest",)
    assert kinds["a/Outer.class"] == ("class",) and kinds["notes.txt"] == ("text",)
    war = by_path(classify(entries), "app.war", "kind")
    assert war["WEB-INF/web.xml"] == ("web.xml",) and war["WEB-INF/lib"] == ("webinf-lib-dir",)
    assert by_path(classify(entries), "m.jmod", "kind")["classes/a"] == ("jmod-package",)
    assert by_path(classify(entries, EXTRACTOR_RULES), "m.jmod", "kind")["classes/module-info.class"] == ("module-info",)
    assert rule_table(spark).count() > 34


def test_index_store(spark, symbols, tmp_path):
    path = str(tmp_path / "index")
    write_index(symbols["postings"], path, partitions=3)
    back = read_index(spark, path)
    assert back.exceptAll(symbols["postings"]).count() == 0 and back.count() == symbols["postings"].count()
    pruned = back.filter("index_name = 'strings' and key >= 'h'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(index_name" in plan and "GreaterThanOrEqual(key,h)" in plan
    assert os.path.isdir(os.path.join(path, "index_name=strings"))


def test_incremental_index(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    os.makedirs(src)

    def put(name, **classes):
        with open(f"{src}/{name}", "wb") as f:
            f.write(zipped({f"{k}.class": ClassBuilder(v).build() for k, v in classes.items()}))

    def declared():
        return {(r["container"].rsplit("/", 1)[-1], r["key"]) for r in read_stream_index(spark, out).filter(
            "index_name = 'typeDeclarations'").collect()}

    put("one.jar", A="a/A")
    put("two.jar", B="b/B")
    stream_index(spark, src, out, ck).awaitTermination()
    assert declared() == {("one.jar", "a/A"), ("two.jar", "b/B")}
    stream_index(spark, src, out, ck).awaitTermination()
    assert declared() == {("one.jar", "a/A"), ("two.jar", "b/B")}
    put("three.jar", C="c/C")
    stream_index(spark, src, out, ck).awaitTermination()
    assert declared() == {("one.jar", "a/A"), ("two.jar", "b/B"), ("three.jar", "c/C")}
    # The same archive in a later batch replaces its older symbols.
    from symlake.streaming.index import append_batch

    put("one.jar", A="a/New")
    again = spark.read.format("binaryFile").load(f"{src}/one.jar")
    append_batch(again, 7, out)
    append_batch(again, 7, out)
    assert declared() == {("one.jar", "a/New"), ("two.jar", "b/B"), ("three.jar", "c/C")}


def test_log_source(spark, folder):
    from symlake.operators.logs import stack_frames
    from symlake.sources.logs import read_logs

    frames = stack_frames(read_logs(spark, folder)).collect()
    assert [(r["type_name"], r["method"], r["line"]) for r in frames] == [("a/Outer", "go", 3)]


def test_suffixes_in_upper_case_long_files_and_unopened_archives(spark, tmp_path):
    import io
    import zipfile

    def jar(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    inner = jar(**{"deep.txt": b"x"})
    (tmp_path / "LIB.JAR").write_bytes(jar(**{"a.txt": b"hello", "in.Jar": inner}))
    (tmp_path / "big.zip").write_bytes(jar(**{"z.txt": bytes(range(256)) * 50}))
    all_rows = A.read_archives(spark, str(tmp_path))
    assert {r["entry_path"] for r in all_rows.filter("NOT is_dir").collect()} == {"a.txt", "in.Jar", "deep.txt", "z.txt"}
    assert all_rows.filter("error IS NOT NULL").count() == 0
    flat = {r["entry_path"]: r["error"] for r in A.read_archives(spark, str(tmp_path), max_depth=0).filter("NOT is_dir").collect()}
    assert "not opened" in flat["in.Jar"] and flat["a.txt"] is None and "deep.txt" not in flat
    old = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = A.read_archives(spark, str(tmp_path)).collect()
        assert [(r["container"].rsplit("/", 1)[-1], r["content"]) for r in rows if r["error"]] == [("big.zip", None)]
        assert {r["entry_path"] for r in rows if not r["is_dir"]} == {"a.txt", "in.Jar", "deep.txt"}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", old)


@pytest.mark.parametrize("signature, names", [
    ("Lp/Outer<TT;>.Listener;", {"p/Outer"}), ("Lp/Outer<Ljava/lang/String;>.MyLong;", {"p/Outer", "java/lang/String"}),
    ("<LABEL::Ljava/lang/Comparable<TLABEL;>;>(TLABEL;)V", {"java/lang/Comparable"}), ("(ILa/B;[La/C;)Ld/E;", {"a/B", "a/C", "d/E"}),
    ("<K:Ljava/lang/Object;V::Ljava/util/List<TK;>;>Lbase/L;", {"java/lang/Object", "java/util/List", "base/L"}),
])
def test_type_names_of_signatures(signature, names):
    from symlake.sources.classfile import _SIGNATURE_TYPE

    assert {t for t in _SIGNATURE_TYPE.findall(signature) if t} == names


def test_index_job_and_search_flow(entries, symbols, spark):
    from symlake import model as m
    from symlake.operators.hierarchy import root_entries
    from symlake.operators.index import index_entries, search_tree

    found = index_entries(entries)
    posts = found["postings"].cache()
    kinds = {r[0] for r in posts.select("index_name").distinct().collect()}
    assert {m.TYPE_DECLARATIONS, m.TEXTS} <= kinds
    assert {tuple(r) for r in found["supertypes"].collect()} == {tuple(r) for r in symbols["supertypes"].select("container", "type_name", "super_name", "kind").collect()}
    tree, counts = search_tree(entries, posts, root_entries(symbols["types"]), "Out*", m.SEARCH_TYPE | m.SEARCH_DECLARATION, found["texts"])
    shown = {r["entry_path"] for r in tree.filter("NOT is_dir").collect()}
    assert shown and all(p.startswith("a/Outer") for p in shown if p.endswith(".class"))
    assert counts.filter("container IS NULL").first()["n_matches"] >= 1


def test_symbols_are_stored_without_sorting_them_and_parsed_in_tasks_cut_by_bytes(spark, tmp_path):
    from symlake.sources.classfile import class_symbols, ingest_classes

    data = ClassBuilder("a/B").build()
    entries = spark.createDataFrame([("c", "a/B.class", False, bytearray(data))], "container string, entry_path string, is_dir boolean, content binary")
    assert "RebalancePartitions" in class_symbols(entries)._jdf.queryExecution().optimizedPlan().toString()
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    assert ingest_classes(entries, str(tmp_path / "s"))["types"].first()["type_name"] == "a/B"
    assert spark.conf.get(key) == before


def test_archives_are_packed_and_opened_a_few_at_a_time():
    import pyarrow as pa

    from symlake.plans import artifact_queries as A

    pages = pa.RecordBatch.from_pydict({"page_id": list(range(600)), "html": ["<p>"] * 600})
    packed = list(A._pack_pages([pages]))
    assert [b.num_rows for b in packed] == [256, 256, 88]


def test_descriptors_are_parsed_by_all_cores(spark):
    from symlake.operators.extract import web_type_refs

    rows = spark.createDataFrame([("c", "web.xml", "<web-app/>")], "container string, entry_path string, text string").coalesce(1)
    assert web_type_refs(rows).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
