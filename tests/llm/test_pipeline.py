"""Registered queries against their SQL, and the pipeline against plain versions of its stages."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from symlake.llm import queries as Q
from tests.llm.cases import edge_docs, edge_rows, empty_docs, prose
from tests.llm.test_operators import plain_components, plain_hits, plain_spans, reference
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(name, spark, sf):
    ok, message = compare(Q.QUERIES[name](spark, sf), connect(sf), Q.ORACLES[name])
    assert ok, message


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_queries_are_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(Q.QUERIES) | {"pipeline"} <= set(names) and set(Q.ORACLES) <= set(e.oracle_sql())


def test_query_digests_match_plain_ones(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = reference(Q.byte_vocabulary())
    for r in Q.op8_byte_bpe(spark, sf).collect():
        ids = np.array(enc.encode_ordinary(texts[r["doc_id"]] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
    for r in Q.op2_secret_scans(spark, sf).collect():
        spans = plain_spans(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    edge_docs(spark).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, prose(2, 15)), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_on_edge_rows(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    first = [(i, t) for i, t, *_ in edge_rows() if any(c.isalpha() for c in t or "")]
    assert Counter((r["doc_id"], r["text"]) for r in kept["language_id"]) == Counter(first)
    gone = {k[0] for k in plain_components(first, 5, 80) if not k[3]}
    second = [(i, t) for i, t in first if i not in gone]
    assert Counter((r["doc_id"], r["text"]) for r in kept["near_dedup"]) == Counter(second)
    items = {1: prose(2, 15)}
    third = {r["doc_id"]: r["text"] for r in kept["decontamination"]}
    for i, t in second:
        if plain_hits(t, items)[1]:
            assert plain_hits(third[i], items)[1] == 0 and len(third[i]) < len(t)
        elif i is not None:
            assert third[i] == t
    fourth = {r["doc_id"]: r["text"] for r in kept["secret_scan"]}
    assert all(not plain_spans(t) for t in fourth.values()) and set(fourth) == set(third)
    enc = reference(Q.byte_vocabulary())
    for r in kept["byte_bpe"]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(fourth[r["doc_id"]])
        assert r["n_bytes"] == len(fourth[r["doc_id"]].encode()) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()


def test_pipeline_runs_whole_and_on_nothing(spark, sf, tables, tmp_path):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_bytes", "n_tokens", "ids", "ids_sha256"]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.7 * n < out.count() <= n
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
