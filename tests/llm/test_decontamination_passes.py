"""Several automata decide as one does."""

import pytest

from symlake.llm import decontaminate

SCHEMA = "doc_id long, text string, n_chars long, key string"


def span(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


A, B, OWN = span("a", 30), span("b", 30), span("own", 40)
TEXTS = [
    f"{A} {B} {OWN}",                                                     # 60 of 100 words, 30 by each item
    f"{OWN} {span('a', 12)} tail",                                        # a cut alone
    f"{OWN} {span('a', 5)} {B} {' '.join(f'a{k}' for k in range(5, 12))} end of it",  # cutting b joins a window of a
    OWN, "", None,
]


@pytest.mark.parametrize("items, max_words", [
    ([(1, A), (2, B)], 30), ([(1, A), (1, B)], 2_000_000), ([(1, A), (1, A), (1, B), (None, B), (None, A)], 2_000_000)])
def test_passes_decide_as_one_automaton(spark, items, max_words):
    docs = spark.createDataFrame([(k, t, None if t is None else len(t), "x") for k, t in enumerate([*TEXTS, TEXTS[1]])], SCHEMA)
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    one = decontaminate.remove_hits(docs, bench([(1, A), (2, B)]))
    many = decontaminate.remove_hits(docs, bench(items), max_words=max_words)
    assert many.schema == docs.schema
    assert len(list(decontaminate.automata(bench(items), 10, max_words))) > 1
    key = lambda rows: sorted(map(repr, rows))
    assert key(many.collect()) == key(one.collect())
    kept = {r["doc_id"]: r["text"] for r in many.collect()}
    assert 0 not in kept and kept[2] == f"{OWN} end of it" and kept[3] == OWN and kept[5] is None
