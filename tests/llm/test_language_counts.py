"""A unit kept for one language has its counts in all of them."""

import inspect

import numpy as np

from symlake.llm import language


def test_kept_units_have_their_counts_in_every_language(spark):
    ids = [r["doc_id"] for r in spark.range(100).toDF("doc_id").filter(language.learned_from()).orderBy("doc_id").limit(3).collect()]
    rows = [(ids[0], "common common common shared shared", "aa"), (ids[1], "other other other shared", "bb"), (ids[2], "common shared", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, max_words=2)
    # Two words a language: `shared` is second in both.
    assert set(model.words) == {"common", "shared", "other"}
    rows = [(ids[0], "x x x y y", "aa"), (ids[1], "y y y x x", "bb")]
    model = language.fit(spark.createDataFrame(rows, docs.schema), max_words=1)
    at = model.words
    assert set(at) == {"x", "y"} and model.languages == ["aa", "bb"]
    expected = np.log(np.array([[3.1, 2.1], [2.1, 3.1]])) - np.log(6)
    assert np.allclose(model.logs[[at["x"], at["y"]]], expected, atol=1e-5)


def test_default_sizes():
    given = inspect.signature(language.fit).parameters
    assert (given["max_words"].default, given["max_grams"].default) == (50_000, 20_000)
