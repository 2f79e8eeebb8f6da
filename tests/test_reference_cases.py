"""The published unit cases of the operators, as tables."""

import pytest
from pyspark.sql import functions as F

from symlake.functions.descriptors import descriptors_match
from symlake.functions.patterns import scope_match
from symlake.operators.resolve import match_fragment
from symlake.operators.search import highlight

# Own names; the descriptors and what matches what are fixed values.
MEMBERS = [
    ("count", "I"), ("ready", "Z"), ("grid", "[[Z"),
    ("label", "Ljava/lang/String;"), ("size", "()I"), ("title", "()Ljava/lang/String;"),
    ("plus", "(JJ)J"), ("room", "(I)[C"),
]
DECLS = "type_name string, name string, descriptor string, start int, end int"


def declarations(spark, types=("Test", "test/Test")):
    rows = []
    for t in types:
        rows.append((t, None, None, 0, 1))
        rows += [(t, n, d, 10, 11) for n, d in MEMBERS]
    return spark.createDataFrame(rows, DECLS)


FRAGMENTS = {
    "Test-ready-Z": 1, "test/Test-ready-Z": 1, "*/Test-ready-Z": 2,
    "Test-room-(I)[C": 1, "test/Test-room-(I)[C": 1, "*/Test-title-(*)?": 2,
    "test/Test-plus-(?J)?": 1,
    # A missing static initializer falls back to its type; an unknown member finds nothing.
    "Test-<clinit>-()V": 1, "Test-nothing-()V": 0, "*/Test": 2, "test/Test": 1, "Test-oops": 0,
    "test/Test-plus-(JI)?": 0,
}


@pytest.mark.parametrize("wild", [True, False])
def test_fragments(spark, wild):
    frags = spark.createDataFrame([(f,) for f in FRAGMENTS], "fragment string")
    got = {r["fragment"]: r["count"] for r in match_fragment(declarations(spark), frags, wild).groupBy("fragment").count().collect()}
    assert {f: got.get(f, 0) for f in FRAGMENTS} == FRAGMENTS


def test_fragments_with_wildcards_on_the_declaration(spark):
    rows = [("*/Test", "size", "()I", 0, 1), ("*/Test", "plus", "(*)?", 0, 1), ("test/Test", "ready", "?", 0, 1),
            ("*/Test", "set", "(?I)V", 0, 1)]
    frags = {"test/Test-size-()I": 1, "test/Test-plus-(JJ)J": 1, "test/Test-ready-Z": 1, "a/Test-set-(JI)V": 1,
             "a/Test-set-(JJ)V": 0, "a/Best-size-()I": 0, "*/Test-plus-(?J)?": 1, "*/Test-ready-?": 1}
    df = spark.createDataFrame([(f,) for f in frags], "fragment string")
    got = {r["fragment"]: r["count"] for r in match_fragment(
        spark.createDataFrame(rows, DECLS), df).groupBy("fragment").count().collect()}
    assert {f: got.get(f, 0) for f in frags} == frags


# Descriptors and whether they match.
PAIRS = [
    ("?", "?", True), ("I", "?", True), ("L*/Test;", "Ltest/Test;", True), ("[[[L*/Test;", "?", True),
    ("()I", "(*)?", True), ("(IJ)I", "(*)?", True),
    ("([[Ltest/Test;[[Ltest/Test;)Ltest/Test;", "([[L*/Test;[[L*/Test;)L*/Test;", True),
    ("[Z", "[I", False), ("()[I", "()[J", False), ("L*/Test;", "Lest;", False), ("L*/Test;", "LTest;", True),
    ("(I)V", "I", False), ("(II)V", "(I)V", False), ("(?)V", "(Ljava/lang/String;)V", True),
]


def test_descriptor_pairs_both_ways(spark):
    df = spark.createDataFrame(PAIRS + [(b, a, x) for a, b, x in PAIRS], "a string, b string, expected boolean")
    bad = df.filter(descriptors_match("a", "b") != F.col("expected")).collect()
    assert bad == []


# Scopes and whether they hold a type.
SCOPES = [
    (None, "java/lang/String", True), ("", "java/lang/String", True), ("java/lang/String", "java/lang/String", True),
    ("*/lang/String", "java/lang/String", True), ("*/String", "java/lang/String", True), (None, "Test", True),
    ("", "Test", True), ("Test", "Test", True), ("*/Test", "Test", True), ("*/tring", "java/lang/String", False),
    ("Test", "test/Test", False),
]


def test_scopes(spark):
    df = spark.createDataFrame(SCOPES, "scope string, type string, expected boolean")
    assert df.filter(scope_match(F.col("scope"), "type") != F.col("expected")).count() == 0
    for scope, name, expected in SCOPES:
        one = spark.createDataFrame([(name,)], "t string").select(scope_match(scope, "t")).first()[0]
        assert one == expected


@pytest.mark.parametrize("scope", [None, "", "Test"])
def test_string_highlight(spark, scope):
    rows = [("c", "e", "string", "string", None, None, None, "Test", 0, 3, "abc"),
            ("c", "e", "reference", "field", "java/lang/Integer", "MAX_VALUE", "I", "Test", 0, 5, None),
            ("c", "e", "reference", "method", "java/lang/Integer", "toString", "()Ljava/lang/String;", "Test", 7, 9, None)]
    occ = spark.createDataFrame(
        rows, "container string, entry_path string, role string, kind string, type_name string, name string, "
              "descriptor string, owner string, start int, end int, text string")
    assert [tuple(r)[2:] for r in highlight(occ, "ab", "s", scope).collect()] == [(0, 2)]
    assert highlight(occ, "MAX", "rf", scope).count() == 1
    assert highlight(occ, "*S", "rm", scope).count() == 1
    assert highlight(occ, "MAX", "df", scope).count() == 0
