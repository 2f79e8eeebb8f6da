"""Operators against brute force on small inputs: skew paths, cycles, empty input, text search, logs, streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators import asof, extract, hierarchy, logs, ordering, postings, resolve, search, text
from symlake.streaming import frames as sframes


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# --- grouping and ranks under skew ---

@pytest.fixture(scope="module")
def skewed(spark):
    data = [("i", "hot" if i % 3 else f"k{i % 7}", "c", f"e{i:03d}") for i in range(300)]
    return spark.createDataFrame(data + data[:50], "index_name string, key string, container string, entry_path string")


def test_blocks_hold_every_entry_once(skewed):
    got = postings.postings_grouped(skewed, block_size=20)
    hot = got.filter("key = 'hot'").collect()
    assert len(hot) == 10 and {r["n_block"] for r in hot} == {20}
    flat = sorted(e["entry_path"] for r in hot for e in r["entries"])
    assert flat == sorted({r["entry_path"] for r in skewed.filter("key = 'hot'").collect()})
    cold = got.filter("key <> 'hot'")
    assert cold.filter("block <> 0").count() == 0 and cold.count() == 7


def test_positions_follow_the_order_in_every_group(spark):
    data = [("c", None if i % 7 == 0 else "hot" if i % 4 else "d", i % 5 == 0, f"p{(i * 37) % 400:03d}") for i in range(400)]
    df = spark.createDataFrame(data, "container string, parent_path string, is_dir boolean, entry_path string").repartition(7)
    want = {}
    for row in sorted(data, key=lambda r: (str(r[1]), not r[2], r[3])):
        want[row] = sum(1 for o in want if o[1] == row[1]) + 1
    assert {tuple(r)[:4]: r["position"] for r in ordering.sorted_entries(df).collect()} == want


def test_positions_with_equal_keys(spark):
    df = spark.createDataFrame([("c", "d", False, "same")] * 200, "container string, parent_path string, is_dir boolean, entry_path string")
    got = ordering.sorted_entries(df)
    assert sorted(r["position"] for r in got.collect()) == list(range(1, 201))


def test_counts(skewed):
    total = {r["container"]: r["n_matches"] for r in postings.match_counts(skewed).collect()}
    assert total == {"c": 300, None: 300}
    exact = {r["key"]: r["n_entries"] for r in postings.usage_rank(skewed).collect()}
    close = {r["key"]: r["n_entries"] for r in postings.usage_rank(skewed, approximate=True).collect()}
    assert exact["hot"] == 200 and abs(close["hot"] - 200) < 20


# --- as-of ---

def brute_asof(left, right):
    out = []
    for k, pos in left:
        below = [] if k is None or pos is None else [(p, v) for rk, p, v in right if rk == k and p <= pos]
        out.append((k, pos, max(below)[1] if below else None))
    return sorted(out, key=str)


def test_asof_over_many_partitions(spark):
    rnd = random.Random(3)
    left = [(None, 5), ("hot", None)] + [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", rnd.randrange(500)) for _ in range(300)]
    right = [("hot" if rnd.random() < 0.3 else f"k{rnd.randrange(7)}", rnd.randrange(500), rnd.randrange(1000)) for _ in range(80)]
    got = asof.asof_floor(spark.createDataFrame(left, "k string, pos int"), spark.createDataFrame(right, "k string, p int, v int"),
                          ["k"], "pos", "p", "v")
    assert sorted((tuple(r) for r in got.select("k", "pos", "v").collect()), key=str) == brute_asof(left, right)


def test_line_lookup_defaults_to_the_first_line(spark):
    req = spark.createDataFrame([("c", "e", 5), ("c", "e", 1), ("c", "x", 9), ("c", "e", 12)], "container string, entry_path string, line int")
    lm = spark.createDataFrame([("c", "e", 3, 0), ("c", "e", 4, 4), ("c", "e", 7, 4), ("c", "e", 9, 10)],
                               "container string, entry_path string, view_line int, src_line int")
    assert rows(asof.line_lookup(req, lm), "entry_path", "line", "view_line") == [
        ("e", 1, 1), ("e", 5, 7), ("e", 12, 9), ("x", 9, 1)]


# --- closures ---

def brute_closure(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        frontier, seen, d = {a}, set(), 0
        while frontier:
            d += 1
            frontier = {y for x in frontier for y in up.get(x, ())} - seen - {a}
            out |= {(a, y, d) for y in frontier}
            seen |= frontier
    return sorted(out)


@pytest.mark.parametrize("edges", [
    [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "c")],
    [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s")],
    [("a", "b"), ("b", "c"), ("c", "b")],
    [(f"n{i}", f"n{i + 1}") for i in range(20)],
    [],
])
def test_chain_closure(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string")
    assert rows(hierarchy.chain_closure(df), "src", "dst", "depth") == brute_closure([e for e in edges if e[0] != e[1]])


def deep(spark, n=500):
    """A chain n -> ... -> 0, and names that lead into a cycle of three."""
    edges = [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, n + 1)] + [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")]
    return edges, spark.createDataFrame(edges, "src string, dst string")


def test_closures_have_no_depth_limit_and_end_on_cycles(spark):
    edges, df = deep(spark)
    ends = {r["src"]: (r["top"], r["depth"], r["cyclic"]) for r in hierarchy.tops(df).collect()}
    assert all(ends[f"n{i:03d}"] == ("n000", i, False) for i in range(1, 501))
    assert all(ends[x] == (None, None, True) for x in "xabc") and len(ends) == 504
    got = hierarchy.chain_closure(df)
    assert got.count() == 500 * 501 // 2 + 3 + 6
    assert {tuple(r) for r in got.filter("src = 'x'").collect()} == {("x", "a", 1), ("x", "b", 2), ("x", "c", 3)}
    named = df.toDF("inner_name", "outer_name")
    roots = {r["inner_name"]: r["root_name"] for r in hierarchy.outermost(named).collect()}
    assert roots["n500"] == "n000" and roots["n065"] == "n000" and roots["x"] is None
    types = df.selectExpr("'c' AS container", "src AS type_name", "dst AS outer_name", "src AS inner_name", "src || '.class' AS entry_path",
                          "dst AS super_name", "1 AS flags")
    shown = {r["type_name"]: r["display_name"] for r in hierarchy.display_names(types).collect()}
    assert shown["n500"].count(".") == 500 and shown["n500"].startswith("n000.n001.")
    up = hierarchy.ancestors(types)
    assert up.filter("type_name = 'n500'").count() == 500


def test_walks_over_80_levels_and_cycles(spark):
    edges, df = deep(spark, 80)
    types = df.selectExpr("'c' AS container", "src AS type_name", "dst AS super_name", "1 AS flags").unionByName(
        spark.createDataFrame([("c", "n000", None, 1)], "container string, type_name string, super_name string, flags int"))
    members = spark.createDataFrame([("c", "n000", "m", "()V"), ("c", "zzz", "other", "()V")], "container string, type_name string, name string, descriptor string")
    refs = spark.createDataFrame([("c", t, n, "()V") for t in ("n080", "x") for n in ("m", "other", "none")], "container string, type_name string, name string, descriptor string")
    got = {(r["type_name"], r["name"]): (r["found_type"], r["depth"]) for r in hierarchy.resolve_member(refs, members, types).collect()}
    assert got == {("n080", "m"): ("n000", 80), ("n080", "other"): (None, None), ("n080", "none"): (None, None),
                   ("x", "m"): (None, None), ("x", "other"): (None, None), ("x", "none"): (None, None)}
    pairs = spark.createDataFrame([("n080", "n000"), ("n080", "n081"), ("x", "c"), ("n001", "n002")], "a string, b string")
    above = types.filter("super_name IS NOT NULL").select("type_name", "super_name")
    assert {tuple(r) for r in hierarchy.instance_of(pairs, above).collect()} == {
        ("n080", "n000", True), ("n080", "n081", False), ("x", "c", True), ("n001", "n002", False)}
    common = spark.createDataFrame([("n080", "n040"), ("n003", "x"), ("x", "b")], "a string, b string")
    assert {tuple(r) for r in hierarchy.first_common_super(common, types).collect()} == {("n080", "n040", "n040"), ("n003", "x", None), ("x", "b", "a")}


def test_graph_closure_with_diamonds_and_cycles(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(15)}", f"n{rnd.randrange(15)}") for _ in range(30)]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = df.select(F.col("src").alias("node"))
    assert rows(hierarchy.graph_closure(df, seeds), "src", "dst", "depth") == brute_closure([e for e in edges if e[0] != e[1]])
    assert hierarchy.graph_closure(df, seeds.limit(0)).count() == 0


def test_interfaces_have_no_root_class(spark):
    t = spark.createDataFrame([("c", "a/I", "java/lang/Object", 512), ("c", "a/C", "a/B", 1), ("c", "a/B", "java/lang/Object", 1)],
                              "container string, type_name string, super_name string, flags int")
    assert rows(hierarchy.ancestors(t), "type_name", "ancestor", "depth", "in_corpus") == [
        ("a/B", "java/lang/Object", 1, False), ("a/C", "a/B", 1, True), ("a/C", "java/lang/Object", 2, False)]


def test_member_resolution_prefers_the_own_container(spark):
    types = spark.createDataFrame(
        [("one", "p/Base", "java/lang/Object", 1), ("two", "p/Base", "p/Root", 1), ("two", "p/Sub", "p/Base", 1), ("two", "p/Root", None, 1)],
        "container string, type_name string, super_name string, flags int")
    members = spark.createDataFrame(
        [("one", "p/Base", "run", "(I)V"), ("two", "p/Root", "run", "(I)V"), ("two", "p/Root", "deep", "()V")],
        "container string, type_name string, name string, descriptor string")
    refs = spark.createDataFrame(
        [("two", "p/Sub", "run", "(I)V"), ("three", "p/Sub", "run", "(?)V"), ("two", "p/Sub", "deep", "(*)?"), ("two", "p/Sub", "none", "()V"),
         ("two", "p/Unknown", "run", "(I)V")], "container string, type_name string, name string, descriptor string")
    got = {(r["container"], r["type_name"], r["name"]): (r["found_type"], r["depth"]) for r in
           hierarchy.resolve_member(refs, members, types).collect()}
    assert got == {
        ("two", "p/Sub", "run"): ("p/Root", 2),   # its own Base declares nothing
        ("three", "p/Sub", "run"): ("p/Base", 1),  # a stranger sees the first copy of Base
        ("two", "p/Sub", "deep"): ("p/Root", 2), ("two", "p/Sub", "none"): (None, None), ("two", "p/Unknown", "run"): (None, None)}


def test_copies_of_a_type_in_one_container_do_not_multiply(spark):
    """A multi-release archive holds a type more than once."""
    types = spark.createDataFrame(
        [("c", "a/O.class", "a/O", None, None, "x", 1), ("c", "v9/a/O.class", "a/O", None, None, "x", 1),
         ("c", "a/O$I.class", "a/O$I", "a/O", "I", "a/O", 1), ("c", "v9/a/O$I.class", "a/O$I", "a/O", "I", "a/P", 1)],
        "container string, entry_path string, type_name string, outer_name string, inner_name string, super_name string, flags int")
    assert rows(hierarchy.root_entries(types)) == [
        ("c", "a/O$I.class", "a/O.class"), ("c", "a/O.class", "a/O.class"), ("c", "v9/a/O$I.class", "v9/a/O.class"),
        ("c", "v9/a/O.class", "v9/a/O.class")]
    assert rows(hierarchy.display_names(types)) == [("c", "a/O", "O"), ("c", "a/O$I", "O.I")]
    members = spark.createDataFrame([("c", "a/O", "m", "()V")], "container string, type_name string, name string, descriptor string")
    refs = spark.createDataFrame([("c", "a/O$I", "m", "()V")], "container string, type_name string, name string, descriptor string")
    assert rows(hierarchy.resolve_member(refs, members, types), "found_type", "depth") == [("a/O", 1)]


# --- resolution ---

def test_same_container_preference(spark):
    decls = spark.createDataFrame([("k", "a", "e1"), ("k", "a", "e2"), ("k", "b", "e3"), ("m", "b", "e4")], "key string, container string, entry_path string")
    refs = spark.createDataFrame([(1, "k", "a"), (2, "k", "z"), (3, "m", "a"), (4, "q", "a")], "id int, key string, container string")
    got = rows(resolve.resolve_same_container(refs, decls), "id", "scope", "n_candidates", "first_entry")
    assert got == [(1, "same", 2, "e1"), (2, "any", 3, "e1"), (3, "any", 1, "e4"), (4, "none", 0, None)]
    sets = resolve.candidate_sets(decls)
    assert rows(sets.filter("set_key = 'k' and set_container = 'a'"), "entry_path") == [("e1",), ("e2",)]
    assert sets.filter("set_key = 'k' and set_container is null").count() == 3


def test_entries_of_descendants(spark):
    sup = spark.createDataFrame([("x", "p/B", "p/A", "class"), ("y", "p/C", "p/B", "class"), ("y", "p/D", "p/A", "interface")],
                                "container string, type_name string, super_name string, kind string")
    decls = spark.createDataFrame([("p/B", "x", "b1"), ("p/B", "y", "b2"), ("p/C", "y", "c"), ("p/A", "x", "a")],
                                  "type_name string, container string, entry_path string")
    below = hierarchy.descendants(sup, spark.createDataFrame([("p/A",)], "type_name string")).selectExpr("descendant AS type_name", "depth")
    got = rows(resolve.preferred_entries(below, decls, "y"), "type_name", "depth", "entry_path")
    assert got == [("p/B", 1, "b2"), ("p/C", 2, "c"), ("p/D", 1, None)]


def test_class_root_takes_the_longest_suffix(spark):
    df = spark.createDataFrame([("/r/a/b/C.class", "a/b/C"), ("/r/b/C.class", "a/b/C"), ("/r/XC.class", "a/b/C")], "file_path string, type_name string")
    assert [(r["inner_path"], r["root_path"]) for r in resolve.class_root(df).orderBy("file_path").collect()] == [
        (None, None), ("a/b/C.class", "/r"), ("b/C.class", "/r")]


# --- text ---

def test_ranges_against_plain_search(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abé \n") for _ in range(rnd.randrange(0, 200))) for _ in range(60)] + ["", "aaaa", "ab" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for pattern, rx in [("ab", "ab"), ("a", "a"), ("a?b", "a.b"), ("b*a", "b.*a"), ("aa", "aa"), ("*", ".+")]:
        want = sorted((i, h.start(), h.end()) for i, t in enumerate(texts) for h in re.finditer(rx, t) if h.end() > h.start())
        assert rows(text.text_hits(df, ["id"], "t", pattern), "id", "hit_start", "hit_end") == want, pattern


def test_find_next_wraps(spark):
    df = spark.createDataFrame([(1, "Ab ab AB", 3), (2, "Ab ab AB", 7), (3, "xx", 0)], "id int, t string, caret int")
    got = rows(text.find_next(df, ["id"], "t", "ab", "caret", case_sensitive=False), "id", "n_hits", "next_start")
    assert got == [(1, 3, 3), (2, 3, 0)]
    back = rows(text.find_next(df, ["id"], "t", "ab", "caret", case_sensitive=False, forward=False), "id", "next_start")
    assert back == [(1, 0), (2, 3)]
    assert text.find_text(df, ["id"], "t", "A").count() == 0
    assert rows(text.find_text(df, ["id"], "t", "ab"), "id", "hit_start") == [(1, 3), (2, 3)]


# --- extraction ---

def page(spark, *texts):
    return spark.createDataFrame([("c", f"e{i}", t) for i, t in enumerate(texts)], "container string, entry_path string, text string")


def test_markup_tokens(spark):
    xml = """<?xml version="1.0"?><!-- note --><b:beans xmlns:b="urn:b"><b:bean id='x' class="a.b.C">t &amp; u</b:bean>
      <e><![CDATA[ raw <x> ]]></e><?go now ?></b:beans>"""
    keys = {r["key"] for r in extract.markup_postings(page(spark, xml)).collect()}
    assert {"beans", "bean", "id", "x", "class", "a.b.C", "t & u", "e", "raw <x>", "go", "now", "note", "b", "urn:b"} <= keys
    assert "" not in keys


def test_bean_classes_are_types_not_strings(spark):
    xml = '<beans><bean id="i" class="a.b.C" scope="s"/><bean class="d.E"></bean></beans>'
    got = {(r["index_name"], r["key"]) for r in extract.bean_postings(page(spark, xml)).collect()}
    assert ("typeReferences", "a/b/C") in got and ("typeReferences", "d/E") in got
    assert ("strings", "a.b.C") not in got and ("strings", "s") in got


def test_descriptor_paths(spark):
    ejb = """<?xml version="1.0"?><!DOCTYPE ejb-jar PUBLIC "-//X" "http://nowhere.invalid/x.dtd">
    <ejb-jar xmlns="urn:x"><enterprise-beans><session><home>a.Home</home><ejb-ref><home> b.Home </home></ejb-ref>
    <ejb-class>a.Bean</ejb-class></session><session><home>c.Home</home></session>
    <message-driven><resource-ref><injection-target><injection-target-class>i.T</injection-target-class></injection-target></resource-ref></message-driven>
    </enterprise-beans><other><home>no.No</home></other></ejb-jar>"""
    got = extract.ejb_type_refs(page(spark, ejb, ejb[:-9], "<web-app/>", "junk", ""))
    assert rows(got, "entry_path", "key") == sorted(("e0", k) for k in ("a/Home", "b/Home", "a/Bean", "c/Home", "i/T"))


def test_empty_inputs(spark):
    none = page(spark).limit(0)
    assert extract.markup_postings(none).count() == 0
    assert postings.postings_grouped(none.selectExpr("'i' AS index_name", "text AS key", "container", "entry_path")).count() == 0
    assert search.symbol_search(none.selectExpr("'strings' AS index_name", "text AS key", "container", "entry_path"), "", 255).count() == 0
    nulls = spark.createDataFrame([("c", "e", None)], "container string, entry_path string, text string")
    assert extract.markup_postings(nulls).count() == 0 and extract.line_refs(nulls).count() == 0
    assert text.text_hits(nulls, ["entry_path"], "text", "ab").count() == 0


# --- logs ---

LINES = [
    ("\tat a.b.C$D.run(C.java:12)", ("a/b/C$D", "run", "C.java", 12, False)),
    ("  at java.base/java.lang.Thread.run(Thread.java:833)", ("java/lang/Thread", "run", "Thread.java", 833, False)),
    ("at app//x.Y.<init>(Y.java)", ("x/Y", "<init>", None, None, False)),
    ("\tat java.security.AccessController.doPrivileged(Native Method)", ("java/security/AccessController", "doPrivileged", None, None, True)),
    ("look at a.b(c)", None), ("\tat nodots(X.java:1)", None), ("Caused by: x", None), ("", None),
    ("\tat a.C.m(Unknown Source)", ("a/C", "m", None, None, False)),
]


def test_frames(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "id int, text string")
    got = {r["id"]: tuple(r)[1:] for r in logs.stack_frames(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LINES) if want}


def test_streams_equal_batch_and_late_rows_drop(spark, tmp_path):
    src = str(tmp_path / "src")
    mk = lambda mins, name: [(f"2024-01-01 {10 + x // 60:02d}:{x % 60:02d}:00", f"\tat a.B.{name}(B.java:1)") for x in mins]
    schema = "at timestamp, text string"
    for i, data in enumerate([mk([0, 5, 70], "m"), mk([400], "m"), mk([410], "m"), mk([10], "late")]):
        spark.createDataFrame(data, "at string, text string").selectExpr("cast(at AS timestamp) AS at", "text").coalesce(1).write.parquet(f"{src}/f={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    counts = sframes.stream_counts(logs.stack_frames(stream), "at", "1 hour", "30 minutes")
    out = str(tmp_path / "out")
    sframes.run_counts_to_table(counts, out, str(tmp_path / "ck")).awaitTermination()
    got = rows(sframes.read_counts(spark, out), "method", "n_frames")
    assert got == [("m", 1), ("m", 2), ("m", 2)]  # the row behind the watermark is gone
    decls = spark.createDataFrame([("a/B", "lib", "a/B.class")], "type_name string, container string, entry_path string")
    linked = sframes.stream_frames(spark.readStream.schema(schema).parquet(f"{src}/*"), decls)
    sframes.run_to_table(linked, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    batch = logs.link_frames(logs.stack_frames(spark.read.schema(schema).parquet(f"{src}/*")), decls)
    assert rows(spark.read.parquet(str(tmp_path / "o2"))) == rows(batch)


def test_linked_stream_sees_a_grown_index(spark, tmp_path):
    """Two runs of one stream: what was added to the index between them is found by the second."""
    src, index = str(tmp_path / "src"), str(tmp_path / "index")
    put = lambda name, n: spark.createDataFrame([(f"\tat a.{name}.m({name}.java:1)",)], "text string").coalesce(1).write.parquet(f"{src}/f={n}")
    add = lambda t: spark.createDataFrame([("typeDeclarations", t, t, "lib", f"{t}.class")], "index_name string, key string, type_name string, container string, entry_path string").write.mode("append").parquet(index)
    run = lambda: sframes.run_linked(spark.readStream.schema("text string").parquet(f"{src}/*"), lambda s: s.read.parquet(index), str(tmp_path / "out"),
                                     str(tmp_path / "ck")).awaitTermination()
    add("a/Other")
    put("B", 1)
    run()
    add("a/B")
    put("B", 2)
    run()
    got = spark.read.parquet(f"{tmp_path}/out/source=*/batch=*")
    assert got.count() == 2 and got.filter("n_targets = 1").count() == 1


def test_text_is_not_searched_by_its_hash(spark):
    entries = spark.createDataFrame([("c", f"e{i}", f"text {i}") for i in range(40)], "container string, entry_path string, text string")
    posts, texts = extract.text_postings(entries)
    flags = m.SEARCH_STRING | m.SEARCH_DECLARATION | m.SEARCH_REFERENCE
    assert search.symbol_search(posts, "a", flags, texts).count() == 0
    assert search.symbol_search(posts, "text", flags, texts).count() == 40
    assert search.symbol_search(posts, "text 7", flags, texts).count() == 1


def test_beans_and_declarations(spark):
    text = """<?xml version="1.0" encoding="UTF-8"?><beans><b:bean class="a.B"/><bean id='x' class='a.C'/></beans>"""
    got = extract.bean_postings(spark.createDataFrame([("c", "e", text)], "container string, entry_path string, text string")).collect()
    assert {r["key"] for r in got if r["index_name"] == m.TYPE_REFERENCES} == {"a/B", "a/C"}
    assert {r["key"] for r in got if r["index_name"] == m.STRINGS} == {"1.0", "UTF-8", "beans", "bean", "id", "x", "class"}


def test_core_names_come_from_the_corpus(spark):
    types = spark.createDataFrame([("java/lang/NullPointerException",), ("java/lang/ref/Reference",), ("java/lang/Thread$State",), ("a/B",)], "type_name string")
    assert [r[0] for r in resolve.core_types(types).collect()] == ["NullPointerException"]


def test_same_simple_name_does_not_pair_all_full_names(spark):
    n = 20_000
    decls = spark.range(n).selectExpr("concat('p', id, '/Main') AS type_name", "cast(null AS string) AS name", "cast(null AS string) AS descriptor", "0 AS start", "1 AS `end`")
    got = resolve.match_fragment(decls, decls.selectExpr("type_name AS fragment"))
    joined = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert got.count() == n and len(joined) <= 6


def test_scratch_folders_can_be_dropped(spark, tmp_path, monkeypatch):
    from symlake import session

    monkeypatch.setattr(session, "_scratch", [])
    monkeypatch.setattr(session, "scratch_root", lambda s: str(tmp_path))
    session.Scratch(spark, "x").save(spark.range(3).toDF("n"), "a")
    session.Scratch(spark, "never-used")
    assert len(list((tmp_path / "symlake").iterdir())) == 1
    assert session.drop_scratch(spark) == 1 and list((tmp_path / "symlake").iterdir()) == []


def test_only_marks_that_the_other_side_answers_are_joined(spark):
    decls = spark.createDataFrame([("p/A", "run", "(I)V"), ("p/A", "go", "(J)V"), ("q/A", "run", "(I)V")], "type_name string, name string, descriptor string")
    refs = decls.limit(0).unionByName(spark.createDataFrame(
        [("p/A", "run", "(I)V"), ("*/A", "run", "(*)?"), ("p/A", "go", "(?)V"), ("p/A", "go", "(I)V")], "type_name string, name string, descriptor string"))
    got = {tuple(r) for r in resolve.member_match(refs, decls, wild_decls=False).collect()}
    assert got == {("p/A", "run", "(I)V", "p/A", "(I)V"), ("*/A", "run", "(*)?", "p/A", "(I)V"), ("*/A", "run", "(*)?", "q/A", "(I)V"),
                   ("p/A", "go", "(?)V", "p/A", "(J)V")}
    # Exact on both sides: one pair of marks, so one row of each side is joined.
    assert resolve._meeting({"known plain"}, {"known plain"}, True) == [("=", "=")]
    both = decls.selectExpr("type_name", "name", "descriptor", "0 AS start", "1 AS `end`")
    exact = resolve.match_fragment(both, decls.selectExpr("concat(type_name, '-', name, '-', descriptor) AS fragment"))
    assert exact.count() == 3


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "AdaptiveSparkPlan" not in x]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


CROWD = [(f"p{i}/{t}", n, d) for i in range(30) for t, n, d in (
    ("Main", None, None), ("Main", "run", "(I)V"), ("Main", "run", "(J)V"), (f"T{i}", None, None), (f"T{i}", "run", "(I)V"))] + [("p0/T0", "<clinit>", "()V")]
ASKED = [("p1/Main", 1), ("*/Main", 30), ("p1/Main-run-(I)V", 1), ("*/Main-run-(*)?", 60), ("p1/Main-run-(?)V", 2), ("p2/T2", 1), ("*/T2-run-(*)?", 1),
         ("p2/T2-run-(J)V", 0), ("p1/Main-<clinit>-()V", 1), ("p0/T0-<clinit>-()V", 1), ("p2/T2-<clinit>-()V", 1)]


def crowd(spark):
    decls = spark.createDataFrame([(*row, 0, i) for i, row in enumerate(CROWD)], "type_name string, name string, descriptor string, start int, end int")
    # Asked twice, found once.
    return decls, spark.createDataFrame([(f,) for f, _ in ASKED] * 2, "fragment string")


def test_fragments_and_declarations_are_dealt_by_simple_name_only(spark, no_broadcast):
    decls, frags = crowd(spark)
    got = resolve.match_fragment(decls, frags)
    assert exchanges(got) and all("direct_shuffle_partition_id(_task" in x for x in exchanges(got))
    found = [r["fragment"] for r in got.collect()]
    assert {f: found.count(f) for f, _ in ASKED} == dict(ASKED)


def test_members_are_read_from_the_tables_once(spark, sf, monkeypatch):
    from symlake.plans.registry import load
    from symlake.session import Scratch

    scans, save = [], Scratch.save_noting
    monkeypatch.setattr(Scratch, "save_noting", lambda self, df, step, notes: (
        scans.append("lineitem.parquet" in df._jdf.queryExecution().executedPlan().toString()), save(self, df, step, notes))[1])
    load()[0]["match_fragment"](spark, sf)
    assert scans.count(True) == 1


def test_crowded_simple_names_are_spread(spark, monkeypatch, no_broadcast):
    decls, frags = crowd(spark)
    together = rows(resolve.match_fragment(decls, frags), "fragment", "type_name", "descriptor", "end")
    monkeypatch.setattr(resolve, "TASK_ROWS", 60)
    assert len(resolve.crowded_groups("n", 122, spark.range(61).selectExpr("7L AS n"), spark.range(61).selectExpr("id AS n"))) == 1
    spread = resolve.match_fragment(decls, frags)
    assert any("hashpartitioning(_key" in x for x in exchanges(spread)) and any("direct_shuffle_partition_id(_task" in x for x in exchanges(spread))
    assert rows(spread, "fragment", "type_name", "descriptor", "end") == together


def saved_rows(monkeypatch, run):
    """What ``run`` writes to scratch folders, as ``step -> rows``, and how often several steps are read back."""
    from symlake.session import Scratch

    sizes, reads, save, read = {}, [], Scratch.save, Scratch.read
    monkeypatch.setattr(Scratch, "save", lambda self, df, step: (out := save(self, df, step), sizes.__setitem__(step, out[1]))[0])
    monkeypatch.setattr(Scratch, "read", lambda self, *steps: (reads.append(steps), read(self, *steps))[1])
    return run(), sizes, reads


def test_members_nobody_asks_for_are_not_walked(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FEW", 1, raising=False)
    types = spark.createDataFrame([("c", f"t{i}", f"t{i // 3}" if i else None, 1) for i in range(81)],
                                  "container string, type_name string, super_name string, flags int")
    members = spark.createDataFrame([("c", f"t{i}", n, "(I)V") for i in range(81) for n in ("other", "m")] + [("c", "t0", "top", "(I)V")],
                                    "container string, type_name string, name string, descriptor string").filter("name != 'm' OR type_name != 't80'")
    refs = spark.createDataFrame([("c", t, n, "(?)V") for t in ("t80", "t7") for n in ("m", "top", "none")],
                                 "container string, type_name string, name string, descriptor string")
    got, sizes, _ = saved_rows(monkeypatch, lambda: hierarchy.resolve_member(refs, members, types, wild_decls=False))
    assert rows(got, "type_name", "name", "found_type", "depth") == [
        ("t7", "m", "t7", 0), ("t7", "none", None, None), ("t7", "top", "t0", 2),
        ("t80", "m", "t26", 1), ("t80", "none", None, None), ("t80", "top", "t0", 4)]
    assert sizes["declared"] == 81  # 80 of m, one of top, under the one mark that is asked for
    assert sizes["declared-1"] == 28 and sizes["declared-2"] == 10  # types with others below them, and below those


def test_closures_read_what_they_found_a_few_times(spark, monkeypatch):
    edges, df = deep(spark, 40)
    seeds = spark.createDataFrame([("n040",), ("x",)], "node string")
    got, _, reads = saved_rows(monkeypatch, lambda: hierarchy.graph_closure(df, seeds))
    assert rows(got, "dst", "depth") == sorted([(f"n{40 - d:03d}", d) for d in range(1, 41)] + [("a", 1), ("b", 2), ("c", 3)])
    assert len(reads) <= 7


def test_instances_are_walked_from_the_few(spark, monkeypatch):
    above = spark.createDataFrame([(f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 255)], "type_name string, super_name string")
    pairs = spark.createDataFrame([(f"t{i}", b) for i in range(255) for b in ("t1", "t0")] + [("t9", None), (None, "t1"), ("new", "new"), ("new", "t1")], "a string, b string")
    below = {1}
    for i in range(2, 255):
        if (i - 1) // 2 in below:
            below.add(i)
    got, sizes, _ = saved_rows(monkeypatch, lambda: hierarchy.instance_of(pairs, above))
    assert {(r["a"], r["b"]): r["is_instance"] for r in got.collect()} == {
        **{(f"t{i}", "t0"): True for i in range(255)}, **{(f"t{i}", "t1"): i in below for i in range(255)},
        ("t9", None): None, (None, "t1"): None, ("new", "new"): True, ("new", "t1"): False}
    assert sum(n for step, n in sizes.items() if step.startswith("level-")) == 254 + 126
    # Many on either side: up.
    got, _, _ = saved_rows(monkeypatch, lambda: hierarchy.instance_of(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a IS NOT NULL"), above))
    assert {(r["a"], r["b"]): r["is_instance"] for r in got.filter("b = 't0'").collect()} == {("t0", "t0"): True, ("t1", "t0"): True}


def test_positions_move_rows_once(spark):
    """Numbers come from the sorted partitions; no window goes over the rows."""
    data = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", f"v{i % 400:03d}") for i in range(1200)]
    df = spark.createDataFrame(data, "key string, value string")
    got = postings.positions(df, ["key"], [F.col("value")])
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key, value in data:
        want.setdefault(key, []).append(value)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        ((k, v, i) for k, vs in want.items() for i, v in enumerate(sorted(vs), 1)), key=str)
    once = postings.positions(df, ["key"], [F.col("value")], distinct=True)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(
        ((k, v, i) for k, vs in want.items() for i, v in enumerate(sorted(set(vs)), 1)), key=str)
