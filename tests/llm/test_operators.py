"""The operators on rows with nulls, ties, repeats, empty and long texts, empty tables and clashing columns, against plain
versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symlake.llm import arrays, bpe, components, decontaminate, language, licenses, merkle, minhash, secret_scan, shards, substrings, warc
from symlake.llm import queries as Q
from symlake.llm.session import Scratch, ids_and_texts
from tests.llm.cases import edge_docs, edge_rows, empty_docs, lower_ascii, plain_words, prose, space_words


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty_docs(spark)


@pytest.fixture(scope="module")
def words():
    return Q.byte_vocabulary()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- arrays


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=12), max_size=6))
def test_word_spans_and_hashes_follow_the_words(texts):
    import pyarrow as pa

    data, offsets = arrays.utf8(pa.array(texts, pa.string()))
    starts, ends, first = arrays.word_spans(data, offsets, arrays.NON_SPACE)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in t.encode().split()]
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]
    hashes = arrays.Roller(1).words(data, starts, ends)
    assert len({w for w in found}) == len(set(hashes.tolist()))


def test_long_input_is_hashed_in_pieces(monkeypatch):
    data = np.frombuffer(prose(8, 400).encode(), np.uint8)
    starts, ends, _ = arrays.word_spans(data, np.array([0, len(data)]), arrays.NON_SPACE)
    whole = arrays.Roller(1).words(data, starts, ends)
    monkeypatch.setattr(arrays, "PIECE_BYTES", 50)
    assert (arrays.Roller(1).words(data, starts, ends) == whole).all()


# --- 1 language


def test_language_of_edge_rows(docs, none):
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert len(got) == len(edge_rows())
    for r, (_, text, *_) in ((r, next(x for x in edge_rows() if x[0] == r["doc_id"])) for r in got if r["doc_id"] not in (None, 7)):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")), r
        assert 0 <= r["score"] <= 1
    assert language.predict(none, language.fit(none)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(none)).collect()} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3, 18, 20})


def test_language_backs_off_to_shorter_grams():
    m = language.LanguageModel(["a", "b"], {"known": 0}, {2: {"xy": 1}, 1: {"z": 0}}, np.array([[-1.0, -9.0], [-9.0, -1.0]], np.float32))
    assert m.score("known")[0] == "a" and m.score("wxyw")[0] == "b" and m.score("qzq")[0] == "a"
    assert m.score("qqq") == ("a", 0.5) and m.score("12 !") == ("und", 0.0) and m.score(None) == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97 and got.count() == 1000


# --- 2 secrets


def plain_spans(text):
    text = text or ""
    flags = re.I | re.A
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, flags) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secret_rules_stay_and_others_are_added(docs, none):
    model = secret_scan.train(docs)
    by_text = {}
    for r in secret_scan.scan(docs, model).collect():
        by_text.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["spans"]])
    for i, text, *_ in edge_rows():
        if i is not None:
            for spans in by_text[i]:
                assert [s for s in spans if s[0] != "model"] == plain_spans(text)
                assert spans == sorted(spans, key=lambda s: (s[1], secret_scan.KINDS[s[0]]))
    assert secret_scan.scan(none, model).count() == 0
    unseen = ["see ghp_Ab3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5 now", "call 1234567890123456 today", "at mail5.example.company.com please"]
    kinds = [[s[0] for s in spans] for spans in model.find(unseen)]
    assert kinds == [["model"], [], []]
    clean = secret_scan.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.filter("text IS NOT NULL").collect():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])


def test_secret_network_learns_and_keeps_the_recall(none):
    model = secret_scan.train(none)
    x, y = secret_scan.generated_findings(600, np.random.default_rng(77))
    p = model.probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.97
    assert secret_scan.threshold(np.array([0.9, 0.8, 0.7, 0.2]), np.array([1, 1, 1, 0]), 0.98) <= 0.7
    assert min(model.thresholds) >= 0.5


def test_secret_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = secret_scan.CharacterNetwork.fresh(3, 4, rng)
    x, y = rng.integers(0, 256, (6, 12)), np.array([0.0, 1, 0, 1, 1, 0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.forward(x)[0]))))
    before = loss()
    net.train(x, y, rng, epochs=30, batch=6)
    assert loss() < before / 2


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="tokenTOKEN=:\"' apiKey_AKI0123456789abcdefSECRETſK", max_size=80))
def test_secret_rules_equal_the_plain_ones(text):
    runs = list(secret_scan.RUN.finditer(text))
    assert secret_scan.rule_spans(text, runs) == plain_spans(text)


# --- 4 decontamination


def plain_hits(text, items, window=10):
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items.items():
        iw = plain_words(t)
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1) if iw else ():
            for i in range(len(w) - n + 1):
                if w[i:i + n] == iw[k:k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), found


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_suffix_automaton_equals_brute_force(items, text, window):
    named = {k: " ".join(t) for k, t in enumerate(items)}
    automaton = decontaminate.SuffixAutomaton({k: decontaminate.words_of(t.encode()) for k, t in named.items()}, window)
    hits, found = automaton.scan(decontaminate._word_ids(" ".join(text).encode(), automaton.vocabulary))
    assert (sum(b - a for a, b in hits), found) == plain_hits(" ".join(text), named, window)[1:]
    assert all(a[1] < b[0] for a, b in zip(hits, hits[1:]))


def bench(spark):
    return spark.createDataFrame([(1, prose(1, 60)), (2, "Two words"), (3, None), (4, ""), (5, prose(2, 15)), (2, "two WORDS"), (6, "é" * 40)], "item_id long, text string")


@pytest.mark.parametrize("limit", [2_000_000, 20])
def test_decontamination_of_edge_rows(spark, docs, none, limit):
    items = {r["item_id"]: r["text"] for r in bench(spark).collect() if r["text"]}
    got = decontaminate.find_hits(docs, bench(spark), max_words=limit)
    have = Counter((r["doc_id"], r["n_words"], sum(h["end"] - h["first"] for h in r["hits"]), tuple(sorted(r["items"]))) for r in got.collect())
    want = Counter((i, *plain_hits(t, items)[:2], tuple(sorted(plain_hits(t, items)[2]))) for i, t, *_ in edge_rows())
    assert have == want
    assert decontaminate.find_hits(none, bench(spark)).count() == 0
    assert decontaminate.find_hits(docs, bench(spark).filter("false")).filter("size(hits) > 0").count() == 0
    clean = decontaminate.remove_hits(docs, bench(spark), max_words=limit)
    assert clean.columns == docs.columns
    left = clean.collect()
    assert {r["doc_id"] for r in left}.isdisjoint({6, 7, 8}) and {1, 2, 9, 13, 14, 20} <= {r["doc_id"] for r in left}
    for r in left:
        assert plain_hits(r["text"], items)[1] == 0 and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


# --- 5 substrings


def plain_kept(all_rows, n):
    owner = {}
    for i, t in all_rows:
        w = space_words(t)
        for k in range(len(w) - n + 1):
            if i is not None:
                s = tuple(w[k:k + n])
                owner[s] = min(owner.get(s, i), i)
    out = Counter()
    for i, t in all_rows:
        w = space_words(t)
        gone = {p for k in range(len(w) - n + 1) if i is not None and owner[tuple(w[k:k + n])] < i for p in range(k, k + n)}
        out[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


@pytest.mark.parametrize("n", [5, 13, 20, 30])
def test_substring_dedup_of_edge_rows(docs, none, n):
    want = plain_kept([r[:2] for r in edge_rows()], n)
    assert rows(substrings.remove_repeats(docs, n)) == want
    assert rows(substrings.remove_repeats(docs, n, sample_docs=2)) == want
    assert substrings.remove_repeats(none, n).count() == 0


def test_substring_dedup_with_frequent_windows(spark):
    """A passage in every document is frequent in the sample and never shuffled row by row; the result is the same."""
    data = [(i, prose(100 + i % 40, 30) + " " + prose(7, 40) + " " + prose(200 + i, 20)) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert rows(substrings.remove_repeats(df, 13)) == plain_kept(data, 13)
    assert rows(substrings.remove_repeats(df, 13, share=2.0)) == plain_kept(data, 13)


def test_longest_repeats_doubles_until_nothing_survives(spark):
    a, b = prose(1, 200), prose(2, 50)
    df = spark.createDataFrame([(1, a), (2, "x " + a + " y"), (3, b), (4, b + " z"), (5, prose(3, 90))], "doc_id long, text string")
    assert rows(substrings.longest_repeats(df)) == Counter({(1, 104): 1, (2, 104): 1, (3, 26): 1, (4, 26): 1})


# --- 6 WARC


def test_warc_round_trip_with_lookup(spark):
    page = "<html>" + "x" * 200
    data = [(1, "http://a.example.com/x?q=1#f", page), (2, "https://b.example.com:8080/", page), (3, None, None), (4, "not a url", "short"), (5, "http://a.example.com/x?q=1", "short"),
            (6, "http://u:p@A.Example.COM/é\n", page), (1, "http://a.example.com/x?q=1#f", page), (None, "http://n.example.com/", page), (7, "", "é" * 50)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    where = warc.write(pages, block=2)
    got = warc.read(where, with_payload=True).collect()
    want = Counter()
    for i, url, html in data:
        html = html or ""
        same = [j for j, _, h in data if h == html and j is not None]
        first = min(same) if len(html.encode()) >= 100 else i
        again = i is not None and i > first
        want[i, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first if again else None, None if again else html.encode()] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None) for r in got) == want
    key = "com,example,a)/x?q=1"
    assert sorted(f["page_id"] for f in warc.lookup(where, [key])) == [1, 1, 5]
    assert warc.lookup(where, ["com,example,zzz)/"]) == []
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


# --- 7 Merkle


def test_fingerprints_of_edge_rows(spark, docs, none):
    shown = merkle.with_next(docs).withColumn("edited", merkle.edited())
    got = merkle.fingerprint(shown.select("doc_id", F.col("text").alias("kept_text"), F.col("next_text").alias("kept_next"), F.col("edited").alias("kept_edit"), "text", "edited", "next_text"),
                             {"text": "f", "edited": "g", "next_text": "h"}, {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")}).collect()
    assert len(got) == len(edge_rows())
    fingerprints = {}
    for r in got:
        k = len(r["kept_text"]) // 3
        assert r["kept_edit"] == r["kept_text"][:len(r["kept_text"]) - k] + r["kept_next"][:k]
        assert abs(r["near_edited"] - merkle.likeness(r["f"], r["g"])) < 1e-12 and abs(r["near_next"] - merkle.likeness(r["f"], r["h"])) < 1e-12
        assert fingerprints.setdefault(r["kept_text"], r["f"]) == r["f"]
    assert len(set(fingerprints.values())) == len(fingerprints)
    order = sorted(((i, t or "") for i, t, *_ in edge_rows() if i not in (None, 7)), reverse=True)
    following = {r["doc_id"]: r["kept_next"] for r in got}
    named = [i for i, _ in order]
    for (i, _), (j, text) in zip(order, order[1:]):
        if not (i == 8 and j == 6):
            assert following[i] == text, (i, j)
    assert following[named[0]] == order[1][1]
    assert merkle.with_next(none).count() == 0


def test_fingerprints_locate_edits_across_many_ranges(spark):
    texts = [(i, "\n".join(prose(i * 50 + k, 12) for k in range(20))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, rows_per_range=7).collect()}
    assert got == {i: texts[i - 1][1] for i in range(60)}
    a = texts[0][1]
    lines = a.split("\n")
    b = "\n".join([*lines[:7], "new line", *lines[8:]])
    f, g = (merkle.Trees(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])).strings()[0] for x in (a, b))
    assert merkle.differences(f, g) == [7] and merkle.differences(f, f) == [] and merkle.likeness(f, f) == 1.0
    assert 0.85 < merkle.likeness(f, g) < 1


# --- 8 BPE


def reference(words):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def test_bpe_of_edge_rows(docs, none, words):
    enc = reference(words)
    got = bpe.decode(bpe.encode(docs, words, with_offsets=True, keep=["key"]), words).collect()
    want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in edge_rows())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["bytes"])) for r in got) == want
    for r in got:
        at = np.append(np.frombuffer(r["offsets"], "<u4"), r["n_bytes"]).tolist()
        assert [bytes(r["bytes"])[a:b] for a, b in zip(at, at[1:])] == [words.tokens[k] for k in np.frombuffer(r["ids"], "<u4")]
        assert r["key"] == "junk"
    assert bpe.encode(none, words).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'strevlmdSTL19é 　!-.")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_bpe_equals_the_library(texts):
    import pyarrow as pa

    words = Q.byte_vocabulary()
    data, offsets = arrays.utf8(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(data, offsets)] == reference(words).encode_ordinary_batch(texts)


def test_bpe_long_pieces_and_full_cache(words):
    enc = reference(words)
    small = bpe.Vocabulary(words.ranks, remembered=10)
    for text in ["a" * 4000, "abab" * 700 + "c", "é" * 999, prose(3, 500), "'" * 300 + "ll"]:
        data = np.frombuffer(text.encode(), np.uint8)
        for v in (words, small):
            assert np.frombuffer(v.encode(data, np.array([0, len(data)]))[0], "<u4").tolist() == enc.encode_ordinary(text)
    pieces = [b"hello", b" wor", b"zzzzzzzz", b"x" * 70]
    assert [words.merge_long(p) for p in pieces] == words.merge(pieces)


# --- 9 near duplicates


def plain_components(all_rows, width, percent):
    sets = []
    for _, t in all_rows:
        w = lower_ascii(t)
        w = space_words(w)
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    ids = [i for i, _ in all_rows]
    label = {i: i for i in ids if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (ids[a], ids[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                label[y] = x
    return Counter((i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets) if i is not None)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_edge_rows(docs, none, width):
    got = rows(minhash.near_duplicates(docs, width))
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == plain_components([r[:2] for r in edge_rows()], width, 80)
    assert sorted((r for r in got.elements() if r[0] is None), key=str) == sorted([(None, 60 - width + 1, 6, False), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in edge_rows()} - {7, 8, 15}


def test_near_duplicates_across_stragglers(spark):
    """Copies around one text, so different that many are similar to few others only: links must not get lost."""
    import random

    rng = random.Random(4)
    base = prose(11, 120).split()
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 11, 13, 16])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(30)}"
        data.append((i, " ".join(w)))
    data += [(200 + i, prose(500 + i, 60)) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = plain_components(data, 2, 80)
    assert len({k[2] for k in want}) > 25
    assert rows(minhash.near_duplicates(df)) == want


def test_small_blocks_give_the_same_links(spark):
    data = [(0, list(range(10)))]
    rng = np.random.default_rng(3)
    compared, sets = [], {0: set(range(100))}
    for i in range(1, 60):
        s = (set(range(100)) - set(rng.integers(0, 100, rng.integers(2, 14)).tolist())) | {1000 + int(x) for x in rng.integers(0, 40, rng.integers(0, 10))}
        sets[i] = s
        apart = s ^ sets[0]
        compared.append((i, 0, 180 * len(apart) <= 20 * (len(s) + 100), len(s), 100, [int(x) for x in apart]))
    assert data
    df = spark.createDataFrame(compared, "a long, b long, linked boolean, size_a long, size_b long, apart array<long>")
    nothing = spark.createDataFrame([], "node long, component long")
    want = {frozenset((x, y)) for x in sets for y in sets if x and y and x != y and 180 * len(sets[x] ^ sets[y]) <= 20 * (len(sets[x]) + len(sets[y]))
            and not (180 * len(sets[x] ^ sets[0]) <= 20 * (len(sets[x]) + 100) and 180 * len(sets[y] ^ sets[0]) <= 20 * (len(sets[y]) + 100))}
    for sizes in ({}, {"x_tokens": 40, "y_tokens": 60}):
        got = {frozenset(r) for r in minhash._links_across(df, nothing, 80, **sizes).collect()}
        assert want <= got


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = chain + [(1, k) for k in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 1 for k in range(1, 30)) and got[52] == 50 and len(got) == 41 + 29 + 3
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0


# --- 10 licenses


def test_license_base_of_edge_rows(docs, none):
    got = licenses.scan(docs).select("doc_id", "n_words", licenses.all_places().alias("p"), F.array_sort(licenses.base_labels()).alias("l"), "found").collect()
    have = Counter((r["doc_id"], r["n_words"], tuple(sorted(r["p"])), tuple(r["l"])) for r in got)
    want = Counter()
    for i, t, *_ in edge_rows():
        w = plain_words(t)
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want[i, len(w), tuple(sorted(k for k, _ in at)), tuple(sorted({x for _, x in at}))] += 1
    assert have == want
    assert licenses.scan(none).count() == 0


def test_license_rules(spark):
    known = licenses.rules()
    assert len(known) > 200 and len({r["priority"] for r in known}) == len(known)
    stems = licenses.stems(known)
    cases = {
        "SPDX-License-Identifier: MIT": {"mit"}, "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3"},
        "under the GNU General Public License, version 2 or later": {"gpl-2-or-later"}, "GNU General Public License v3.0": {"gpl-3"},
        "the GNU Lesser General Public License, version 2.1": {"lgpl-2.1"}, "Apache License, Version 2.0": {"apache-2"}, "Apache License": {"apache"},
        "Creative Commons Attribution-NonCommercial 4.0 International License": {"cc-by-nc"}, "licensed CC BY-SA 4.0": {"cc-by-sa"}, "CC BY 4.0": {"cc-by"},
        "https://creativecommons.org/licenses/by-nc-nd/4.0/": {"cc-by-nc-nd"}, "a 3-clause BSD license": {"bsd-3-clause"}, "the BSD License": {"bsd"},
        "Mozilla Public License 2.0": {"mpl-2.0"}, "Permission is hereby granted, free of charge, to any person obtaining a copy": {"mit"},
        "in the public domain": {"public-domain"}, "accept the success": set(), "a permit": set(), "WTFPL": {"wtfpl"}, "All rights reserved. MIT licensed": {"all-rights-reserved", "mit"},
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        text, want = list(cases.items())[r["doc_id"]]
        assert {h["label"] for h in r["found"]} == want, text
        kept = [(h["start"], h["end"]) for h in r["found"]]
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:])) and all(text.lower()[a:b] for a, b in kept)
        for k in known:
            if re.search(k["pattern"].replace("\\W", "[^a-z0-9_]"), text.lower()):
                assert any(s in text.lower() for s in stems)


def test_license_suppression_prefers_longer_then_better(spark):
    hits = [(0, 10, 5), (2, 8, 1), (0, 10, 7), (12, 20, 9), (18, 30, 3), (40, 44, 2), (44, 50, 8), (25, 35, 6)]
    df = spark.createDataFrame([([(a, b, p, 1.0, str(p)) for a, b, p in sorted(hits, key=lambda h: (h[0], -h[1], h[2]))],)],
                               "h array<struct<start:int,end:int,priority:int,confidence:double,label:string>>")
    assert [h["label"] for h in df.select(licenses.suppress(F.col("h")).alias("k")).first()["k"]] == ["5", "3", "2", "8"]


# --- 3 shards


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_feistel_is_a_bijection(n, key):
    p = shards.Permutation(n, key)
    slots = p.slots(np.arange(n))
    assert np.array_equal(np.sort(slots), np.arange(n)) and np.array_equal(p.numbers(slots), np.arange(n))


def test_shards_of_edge_rows(spark, docs, none, words):
    manifest, index = shards.write(docs, words, key=9, length=64, per_shard=50)
    got = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in shards.read(manifest, chunk=7).collect()}
    assert sorted(got) == list(range(len(got))) and all(len(v) == 64 for v in got.values())
    enc = reference(words)
    have = []
    sizes = [r["n"] for r in shards.pack(docs, words, 64).groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()]
    order = shards.Permutation(len(got), 9).slots(np.arange(len(got)))
    at = 0
    for n in sizes:
        stream = np.concatenate([got[s] for s in order[at:at + n]])
        at += n
        ends = np.flatnonzero(stream == 50256)
        have += [tuple(x[:-1].tolist()) for x in np.split(stream, ends + 1) if len(x)]
    want = Counter(tuple(enc.encode_ordinary(t or "")) for _, t, *_ in edge_rows())
    have = Counter(have)
    # Padding shows as more empty texts.
    assert have.pop(()) >= want.pop(()) and have == want
    owners = {r["slot"]: r["doc_ids"] for r in index.collect()}
    assert sorted(owners) == sorted(got) and {i for o in owners.values() for i in o} == {r[0] for r in edge_rows()}
    assert all((a == got[5 + k]).all() for k, a in enumerate(shards.resume(manifest, 5, 60)))
    assert {r["n_rows"] for r in manifest.filter(f"shard < {(len(got) - 1) // 50}").collect()} <= {50}
    empty, nothing = shards.write(none, words, key=1)
    assert shards.read(empty).count() == 0 and nothing.count() == 0


def test_ids_and_texts_shows_nothing_else(docs):
    assert ids_and_texts(docs).columns == ["doc_id", "text"]
