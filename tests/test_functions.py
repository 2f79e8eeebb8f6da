"""Column functions against plain Python."""

import re

from pyspark.sql import functions as F

from symlake import functions as L
from symlake.functions.descriptors import render_type
from symlake.functions.filters import suspicious_name


def col(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_names(spark):
    names = ["a/b/C$D", "C", "a/C", "a/b/C$D$1", "$", ""]
    assert col(spark, names, L.innermost_name) == ["D", "C", "C", "1", "", ""]
    assert col(spark, names, L.package_name) == ["a/b", "", "a", "a/b", "", ""]
    assert col(spark, names, L.display_package)[0] == "a.b"
    assert col(spark, ["package a.b ;", "// x\n  package c;\nclass X{}", "class Y{}"], L.package_of_source) == ["a.b", "c", ""]


def test_glob_follows_its_rules(spark):
    keys = ["abc", "ab", "a", "", "a.c", "abXcd", "ab\ncd", "a$b", "a(b", "b"]

    def plain(pattern, key):
        if pattern == "":
            return False
        if len(pattern) == 1:
            return True if pattern in "*?" else key[:1] == pattern
        rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        return re.fullmatch(rx + ".*", key) is not None

    for p in ["", "*", "?", "a", "ab", "a?c", "a*c", "a.c", "a$b", "a(b", "??", "*c", "a.*"]:
        assert col(spark, keys, lambda c, p=p: L.glob_match(c, p)) == [plain(p, k) for k in keys], p


def test_camel(spark):
    names = ["NullPointerException", "nullPointer", "Npe", "NPE", "SmallRing"]
    assert col(spark, names, lambda c: L.camel_match(c, "nuPo")) == [True, True, False, False, False]
    # The second capital must follow at once unless every capital may skip.
    assert col(spark, names, lambda c: L.camel_match(c, "NPE")) == [False, False, False, True, False]
    assert col(spark, names, lambda c: L.camel_match(c, "NPE", every_capital=True)) == [True, False, False, True, False]
    assert col(spark, names, lambda c: L.camel_match(c, "n")) == [True, True, True, True, False]
    assert col(spark, names, lambda c: L.camel_match(c, "S")) == [False, False, False, False, True]


def test_locator(spark):
    df = spark.createDataFrame([("file:///a/b.war!/lib/x.jar!/p/C.class?lineNumber=7&flag&q=a%20b&q=2&bad=%zz#p/C-m-()V",)], "v string")
    u = df.select(L.parse_locator("v").alias("u")).select("u.*").first()
    assert (u["scheme"], u["containers"], u["path"]) == ("file", ["/a/b.war", "/lib/x.jar"], "/p/C.class")
    assert u["params"] == {"lineNumber": "7", "flag": "", "q": "2", "bad": "%zz"}
    assert u["fragment"] == "p/C-m-()V"


def test_fragment(spark):
    df = spark.createDataFrame([("a/T",), ("a/T-x",), ("a/T-x-I",), ("a/T-x-y-I",)], "v string")
    got = [tuple(r) for r in df.select(L.parse_fragment("v").alias("f")).select("f.*").collect()]
    assert got == [("a/T", None, None, False), (None, None, None, True), ("a/T", "x", "I", False), ("a/T", "x-y", "I", False)]


def test_signatures(spark):
    rows = [
        ("field", "f", "[[Ljava/util/Map$Entry;", 0, False, 0, "f : Map.Entry[][]"),
        ("method", "m", "(I[Ljava/lang/String;)V", 128, False, 0, "m(int, String...) : void"),
        ("method", "m", "([Ljava/lang/String;)V", 128, False, 0, "m(String[]) : void"),
        ("method", "m", "(J[[I)[J", 128, False, 0, "m(long, int[]...) : long[]"),
        ("method", "<clinit>", "()V", 8, False, 0, "{...}"),
        ("method", "<init>", "(La/Outer;I)V", 0, True, 0, "T(int)"),
        ("method", "<init>", "(La/Outer;I)V", 0, True, 8, "T(Outer, int)"),
        ("method", "<init>", "()V", 0, False, 0, "T()"),
    ]
    df = spark.createDataFrame(rows, "kind string, name string, d string, flags int, inner boolean, tf int, want string")
    got = df.select("want", L.render_signature("kind", "name", "d", "flags", F.lit("T"), "inner", "tf").alias("s")).collect()
    assert [r["s"] for r in got] == [r["want"] for r in got]
    assert col(spark, ["B", "S", "F", "C", "X"], render_type) == ["byte", "short", "float", "char", "int"]


def test_prefix_rules(spark):
    paths = ["org/a", "organic/a", "com/google/x", "com/acme", "java/lang/String", "net/x"]
    assert col(spark, paths, L.prefix_rules) == [True, False, True, False, True, False]
    assert col(spark, paths, lambda c: L.prefix_rules(c, "-org +com")) == [False, False, True, True, False, False]
    assert col(spark, paths, lambda c: L.prefix_rules(c, "")) == [False] * 6


def test_suspicious(spark):
    names = ["ab", "Good", "class", "a-b", "COM1", "<init>", "x" * 250, None, "été", "zero​width"]
    assert col(spark, names, lambda c: suspicious_name(c, F.lit("class"))) == [
        True, False, True, True, True, True, True, True, False, True]
    assert col(spark, ["<init>", "<clinit>", "COM1"], lambda c: suspicious_name(c, F.lit("method"))) == [False] * 3


def test_releases(spark):
    assert col(spark, [44, 45, 48, 49, 61], L.release_label, "v int") == [None, "1.1", "1.4", "5", "17"]
    df = spark.createDataFrame([(60, 0), (60, 65535), (61, 0)], "major int, minor int")
    assert [r[0] for r in df.select(L.release_features("major", "minor").getField("sealed")).collect()] == [False, True, True]
