"""Spelling variants, URL rules and hard negatives against plain versions, on rows with nulls, ties and repeats."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from symlake.llm import hard_negatives, spelling, url_filter
from symlake.llm import queries as Q
from symlake.llm.session import Scratch, ids_and_texts
from tests.llm.cases import edge_docs, edge_rows, empty_docs, lower_ascii


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- 11 spelling variants


def plain_words_of(texts, alter):
    import re

    total = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if alter and i is not None and h % alter == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(found):
    near = {w: [o for o in found if is_near(w, o)] for w in found}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-found[o], o), default=None)
        form[w] = best if best is not None and found[best] >= 10 * found[w] else None
    out = Counter()
    for w in found:
        root = w
        while form[root] is not None:
            root = form[root]
        out[(w, found[w], form[w], found.get(form[w]), len(near[w]), root)] += 1
    return out


def variant_texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(6, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    texts = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = rng.choice(base[:10] if rng.random() < 0.7 else base)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abxé") + w[at:], w[:at] + rng.choice("abxé") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return texts + [(None, texts[0][1]), (100, None), (101, ""), (3, texts[3][1]), (3, texts[3][1])]


@pytest.mark.parametrize("limits", [{}, {"most_pairs": 6, "most_rows": 10}])
def test_variants_equal_all_pairs_whatever_the_key_sizes(spark, limits):
    texts = variant_texts()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    found = spelling.words(docs, alter=31)
    want = plain_words_of(texts, 31)
    assert {(r["word"].decode("latin-1"), r["n"]) for r in found.collect()} == set(want.items())
    got = rows(spelling.variants(found, **limits).select("word", "n", "form", "form_n", "n_near", "root"))
    assert got == plain_variants(want)
    assert any(k[2] is not None for k in got)


def test_near_words_are_found_once_for_edits_at_every_place(spark):
    base = "kabilodes"
    edits = {base[:i] + base[i + 1:] for i in range(9)} | {base[:i] + "x" + base[i:] for i in range(10)} | {base[:i] + "y" + base[i + 1:] for i in range(9)}
    words = [w for w in {base, *edits} if len(w) >= 7]
    found = spark.createDataFrame([(w.encode("latin-1"), 2) for w in words], "word binary, n bigint")
    pairs = spelling.near_words(found, Scratch(spark, "t")).collect()
    got = Counter(frozenset((r["a"].decode("latin-1"), r["b"].decode("latin-1"))) for r in pairs)
    assert set(got.values()) == {1}
    assert set(got) == {frozenset((a, b)) for a in words for b in words if is_near(a, b)}


def test_variants_of_edge_rows_and_of_nothing(spark):
    texts = [(r[0], r[1]) for r in edge_rows()]
    found = spelling.words(ids_and_texts(edge_docs(spark)), alter=31)
    assert rows(spelling.variants(found).select("word", "n", "form", "form_n", "n_near", "root")) == plain_variants(plain_words_of(texts, 31))
    assert spelling.variants(spelling.words(ids_and_texts(empty_docs(spark)))).count() == 0


# --- 12 url rules


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = lower_ascii(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[0].split("/", 1)[0])), default=(None, "allow"))
    return host, path, *best


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.net/en/x", "http://example.net/EN/x", "ftp://a.b.example.com/de/?q=/x", "http://example.com/de",
        "http://net/", "http://xnet/", "http://a.net?x=/", "http://a.net#/", "http://.net/", "http://x.org/fr/é?", "http://é.org/fr/", "http://a..net/a://b",
        "http://example.net./en/", "http://example.net:80/en/", "x://y://z.net/", "http://" + "a." * 3000 + "net/" + "p" * 9000]


@pytest.mark.parametrize("segment_rows", [1, 1_000_000])
def test_verdicts_equal_a_scan_of_all_rules(spark, segment_rows):
    rng = random.Random(2)
    hosts = ["net", "example.net", "example.com", "org", "a.example.net", "é.org"]
    more = [(f"{rng.choice(hosts)}/{'/'.join(rng.choice(['en', 'de', 'é', '']) for _ in range(rng.randint(0, 3)))}", rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list(dict((r, v) for r, v in Q.URL_RULES + more).items())
    urls = URLS + [f"http://{rng.choice(['', 'www.', 'A.'])}{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'fr/', 'é/', ''])}{rng.choice(['en/', 'x', ''])}" for _ in range(300)]
    pages = spark.createDataFrame([(k if k % 9 else None, u, "junk") for k, u in enumerate(urls)], "page_id bigint, url string, rule string").repartition(3)
    written = url_filter.build(spark.createDataFrame(rules + [(None, "block"), ("net/", None), ("", "block")], "rule string, verdict string"), segment_rows=segment_rows)
    assert (len(written.rules) > 5) == (segment_rows == 1)
    want = Counter((k if k % 9 else None, *plain_verdict(u, rules)) for k, u in enumerate(urls))
    assert rows(url_filter.judge(pages, written)) == want


def test_no_rules_and_no_pages(spark):
    none = url_filter.build(spark.createDataFrame([], "rule string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_filter.judge(pages, none).first()["verdict"] == "allow"
    rules = url_filter.build(spark.createDataFrame([("net/", "allow"), ("net/", "block")], "rule string, verdict string"))
    assert url_filter.judge(pages, rules).first()["verdict"] == "block"
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_equal_digests_of_other_strings_change_nothing(spark):
    rules = url_filter.build(spark.createDataFrame(Q.URL_RULES, "rule string, verdict string"))
    one = url_filter.DigestArray(rules.folder, rules.rules, lambda s: url_filter.digest(b"net/"))
    assert one.find([b"net/", b"other/"]) == [b"block", None]


# --- 13 hard negatives


def plain_negatives(vectors, anchor, n_positives=5, n_negatives=3):
    held = {}
    for i, label, v in vectors:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(x))) for x in v]
        held[i] = min(held.get(i, (label, whole)), (label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(held[a][1], held[b][1]))
    out = Counter()
    for a in filter(anchor, held):
        order = sorted((b for b in held if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in order if held[b][0] == held[a][0]][:n_positives]:
            s = score(a, p)
            fits = [b for b in order if held[b][0] != held[a][0] and 50 * s <= 100 * score(a, b) <= 95 * s][:n_negatives]
            out.update((a, p, k + 1, b, s, score(a, b)) for k, b in enumerate(fits))
    return out


@pytest.mark.parametrize("seed, width, sizes", [(1, 16, {}), (2, 21, {"stripe_rows": 37, "block_rows": 3}), (3, 3, {"stripe_rows": 50})])
def test_negatives_equal_all_scores(spark, seed, width, sizes):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, width))
    vectors = [(int(i), int(rng.integers(0, 4)), (centers[i % 4] + 0.6 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(240)]
    vectors += [(1000 + i, i % 4, vectors[5][2]) for i in range(30)]  # ties
    vectors += [(None, 1, [1.0] * width), (2000, None, [1.0] * width), (2001, 1, None), (2002, 1, [float("nan")] * width), (2003, 1, [float("inf")] * width),
                (2004, 1, [None] * width), (2005, 1, []), (2010, 2, [0.0] * width), vectors[10], (11, 9, vectors[11][2])]
    df = spark.createDataFrame([(*v, "junk") for v in vectors], "vec_id bigint, label int, embedding array<float>, score string").repartition(3)
    got = hard_negatives.mine(hard_negatives.integers(df), "id % 10 = 0", **sizes)
    assert rows(got) == plain_negatives(vectors, lambda i: i % 10 == 0)
    assert got.count() > 20


def test_no_vectors_no_anchors_and_large_components(spark):
    none = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.integers(none)).count() == 0
    rng = np.random.default_rng(4)
    vectors = [(int(i), int(i % 2), (rng.integers(1, 50, 4) * 4096.0).tolist()) for i in range(1, 60)]
    df = spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<double>")
    assert hard_negatives.mine(hard_negatives.integers(df), "id > 5000").count() == 0
    assert rows(hard_negatives.mine(hard_negatives.integers(df), "id % 7 = 0")) == plain_negatives(vectors, lambda i: i % 7 == 0)


def test_queries_are_registered_with_sql():
    for name in ("op11_spelling_variants", "op12_url_filter", "op13_hard_negatives"):
        assert name in Q.QUERIES and name in Q.ORACLES
