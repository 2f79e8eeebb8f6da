"""Token shards hold the ids that the token query and the pipeline make."""

import inspect
from collections import Counter

import numpy as np

from symlake.llm import bpe, queries, shards
from tests.llm.cases import prose


def test_shards_hold_the_ids_of_the_token_query(spark, tmp_path):
    texts = [prose(k, 400) + " naïve Übergröße señal" for k in range(5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    write = shards.write
    queries.shards.write = lambda docs, words, **more: seen.append((out := write(docs, words, **more))) or out
    try:
        result = queries.op3_token_shards(spark, str(tmp_path)).collect()
    finally:
        queries.shards.write = write
    assert {r["n_ids"] for r in result} == {1024}
    vocabulary = queries.byte_vocabulary()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter(i for r in bpe.encode(docs, vocabulary).collect() for i in np.frombuffer(r["ids"], "<u4").tolist())
    got = Counter(i for r in shards.read(seen[0][0]).collect() for i in np.frombuffer(r["ids"], "<u2").tolist())
    end = max(vocabulary.ranks.values()) + 1
    del got[end]
    assert got == expected


def test_default_sizes():
    given = inspect.signature(shards.write).parameters
    assert (given["length"].default, given["per_shard"].default) == (1024, 16_384)


def test_sequences_take_less_room_with_known_ids(spark):
    vocabulary = queries.byte_vocabulary()
    docs = spark.createDataFrame([(k, prose(k, 900)) for k in range(40)], "doc_id long, text string").coalesce(1)
    known = shards.familiar(docs.limit(10), vocabulary)
    assert 0 < len(known) <= shards.FAMILIAR_BYTES
    room = lambda given: sum(len(r["ids"]) for r in shards.pack(docs, vocabulary, 1024, given).collect())
    assert room(known) < 0.9 * room(b"")


def test_shards_of_texts_too_short_to_be_familiar(spark):
    vocabulary = queries.byte_vocabulary()
    for texts in ([None], [""], ["a"], [None, "a b", "c"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        manifest, index = shards.write(docs, vocabulary, key=3, length=8)
        end = max(vocabulary.ranks.values()) + 1
        ids = [i for t in texts for i in [*np.frombuffer(vocabulary.encode(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0], "<u4"), end]]
        got = [i for r in shards.read(manifest).orderBy("slot").collect() for i in np.frombuffer(r["ids"], "<u2").tolist()]
        assert got == ids + [end] * (8 - len(ids)) and index.count() == 1


def test_merges_ask_only_for_pairs_that_changed(monkeypatch):
    vocabulary = queries.byte_vocabulary()
    pieces = list({w.encode() * 2 for w in prose(1, 300).split()})
    vocabulary.merge(pieces)  # the tables are made once
    asked = []
    ranks = bpe.Vocabulary._pair_ranks
    monkeypatch.setattr(bpe.Vocabulary, "_pair_ranks", lambda self, key: asked.append(len(key)) or ranks(self, key))
    merged = vocabulary.merge(pieces)
    n_bytes, n_ids = sum(map(len, pieces)), sum(map(len, merged)) // 4
    assert merged == [vocabulary.merge_long(p) for p in pieces]
    assert sum(asked) <= 2 * (n_bytes - n_ids)


def test_a_piece_is_looked_up_once_a_slice():
    class Counted(dict):
        n = 0

        def get(self, key, default=None):
            Counted.n += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    vocabulary = queries.byte_vocabulary()
    vocabulary._cache = Counted({t: int(r).to_bytes(4, "little") for t, r in vocabulary.ranks.items()})
    text = b"the end of the end of the end " * 50
    vocabulary.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert Counted.n <= 8
