"""Physical plans: what reaches the scan, and what must never appear."""

import re

import pytest
from pyspark.sql import functions as F

from symlake.functions.filters import only_prefixes
from symlake.functions.patterns import glob_match
from symlake.operators.resolve import member_match, resolve_same_container
from symlake.plans.fixtures import table
from symlake.plans.registry import load
from symlake.sources.classify import classify


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_query_needs_a_nested_loop_or_a_single_task(spark, sf, no_broadcast):
    for name, fn in load()[0].items():
        plan = plan_of(fn(spark, sf))
        assert not re.search("BroadcastNestedLoop|CartesianProduct", plan), name
        assert "SinglePartition" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_prefix_patterns_reach_the_scan(spark, sf):
    part = table(spark, sf, "part")
    plan = plan_of(part.filter(glob_match("p_name", "red")).select("p_partkey"))
    assert "StringStartsWith(p_name,red)" in plan and "p_brand" not in plan
    assert "StringStartsWith(p_name,re)" in plan_of(part.filter(glob_match("p_name", "re*g")))
    assert "Or(StringStartsWith(p_name,a),StringStartsWith(p_name,b))" in plan_of(only_prefixes(part, "p_name", ["a", "b"]))


def test_classification_stays_in_the_scan_stage(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "'jar' AS container_type", "o_orderpriority AS entry_path", "false AS is_dir")
    plan = plan_of(classify(files))
    assert "Exchange" not in plan and "Join" not in plan and "*(1) Project" in plan


def test_exact_member_references_shuffle_once_per_side(spark, sf, no_broadcast):
    m = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS type_name", "l_linestatus AS name", "cast(l_partkey AS string) AS descriptor")
    plan = plan_of(member_match(m, m, wild_refs=False, wild_decls=False))
    assert plan.count("Exchange hashpartitioning") == 2


def test_resolution_grows_with_the_input_not_with_the_pairs(spark):
    """One name with 3,000 references and 3,000 declarations: 9 million pairs must not appear anywhere."""
    refs = spark.range(3000).selectExpr("id", "'hot' AS key", "concat('c', id % 7) AS container")
    decls = spark.range(3000).selectExpr("'hot' AS key", "concat('c', id % 5) AS container", "concat('e', id) AS entry_path")
    out = resolve_same_container(refs, decls)
    rows = out.groupBy("scope", "n_candidates").count().collect()
    assert {(r["scope"], r["n_candidates"]): r["count"] for r in rows} == {("same", 600): 2144, ("any", 3000): 856}
    assert out.count() == 3000


def test_filters_prune_the_columns_of_pages(spark, sf):
    urls = table(spark, sf, "pages").select("url").filter(F.col("url").startswith("https"))
    assert "ReadSchema: struct<url:string>" in plan_of(urls)
