"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm import bpe, decontaminate, hard_negatives, language, licenses, merkle, minhash, secret_scan, shards, spelling, substrings, url_filter, warc
from symlake.llm.session import ids_and_texts, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", F.coalesce(~language.learned_from(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(ids_and_texts(table(spark, sf_dir, "documents")))


ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2
        THEN [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] WHEN len(words) = 1 THEN words ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * both_have >= 80 * (p.n_shingles + q.n_shingles - both_have)),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, l.other FROM reach r JOIN (SELECT x AS one, y AS other FROM link UNION SELECT y, x FROM link) l ON l.one = r.other)
SELECT d.doc_id, coalesce(n.n_shingles, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(ids_and_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS words FROM documents),
b AS (SELECT item_id, {_FOLDED} AS words FROM benchmark),
item_window AS (SELECT DISTINCT item_id, least(len(words), 10) AS size,
                  unnest([array_to_string(words[i:i + least(len(words), 10) - 1], ' ') for i in range(1, len(words) - least(len(words), 10) + 2)]) AS w
                FROM b WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS i,
                 unnest([array_to_string(words[i:i + size - 1], ' ') for i in range(1, len(words) - size + 2)]) AS w
               FROM d, sizes WHERE len(words) >= size),
hit AS (SELECT doc_id, i, item_id, size FROM doc_window JOIN item_window USING (size, w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def byte_vocabulary(path: str | None = None) -> bpe.Vocabulary:
    """Ranks from ``path``; by default the public 50k byte-level vocabulary installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.Vocabulary.read(path)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = byte_vocabulary()
    tokens = bpe.encode(ids_and_texts(table(spark, sf_dir, "documents")), words)
    both = bpe.decode(tokens, words)
    return both.select("doc_id", bpe.count_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ids_and_texts(table(spark, sf_dir, "documents"))
    found = secret_scan.scan(docs, secret_scan.train(docs))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(ids_and_texts(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, unnest([array_to_string(words[i:i + 12], ' ') for i in range(1, len(words) - 11)]) AS seq
      FROM d WHERE len(words) >= 13),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS owner FROM w) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = merkle.with_next(ids_and_texts(table(spark, sf_dir, "documents"))).withColumn("edited", merkle.edited())
    shown = texts.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         "text", "edited", "next_text")
    return merkle.fingerprint(shown, {"text": "fingerprint", "edited": "edited_fingerprint"},
                              {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")})


@query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(ids_and_texts(table(spark, sf_dir, "documents")))
    base, places = licenses.base_labels(), licenses.all_places()
    both = F.array_sort(F.array_distinct(F.concat(base, F.transform("found", lambda h: h["label"]))))
    confidence = F.array_max(F.concat(F.transform("found", lambda h: h["confidence"]), F.when(F.size(base) > 0, F.array(F.lit(0.9))).otherwise(F.array().cast("array<double>"))))
    return found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.coalesce(confidence, F.lit(0.0)).alias("score"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read(warc.write(pages)).drop("url")


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f"""


@query
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, index = shards.write(ids_and_texts(table(spark, sf_dir, "documents")), byte_vocabulary(), key=20_260_101)
    found = shards.read(manifest).select("slot", F.shiftright(F.octet_length("ids"), 1).cast("bigint").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"))
    # The manifest is tiny, what is read through it is not: never broadcast it by the manifest's size.
    return found.hint("merge").join(index, "slot").select("slot", F.floor(F.col("slot") / 16_384).alias("shard"), "n_ids", "ids_sha256", "doc_ids")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.words(ids_and_texts(table(spark, sf_dir, "documents")), alter=31)
    return spelling.variants(found).select("word", "form", "root", "n", "n_near", "form_n")


# Counts grow tenfold along the forms, so 32 steps reach every root of 64-bit counts.
ORACLES["op11_spelling_variants"] = r"""
WITH run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, doc_id, hex(encode(doc_id || ':' || run)) AS h FROM own),
marked AS (SELECT run, n, doc_id, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(0, length(h) // 2),
             lambda k: [CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
             lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h FROM hashed),
word AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM marked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cut),
near AS (SELECT DISTINCT * FROM (
    SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word FROM less a JOIN word b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word FROM less a JOIN word b ON a.rest = b.word)),
best AS (SELECT a AS word, count(*) AS n_near, min({'n': -n, 'word': b}) AS top FROM near JOIN word ON b = word GROUP BY a),
named AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 10 * w.n THEN top.word END AS form,
            CASE WHEN -top.n >= 10 * w.n THEN -top.n END AS form_n FROM word w LEFT JOIN best USING (word)),
s0 AS MATERIALIZED (SELECT word, coalesce(form, word) AS root FROM named),
s1 AS MATERIALIZED (SELECT a.word, b.root FROM s0 a JOIN s0 b ON b.word = a.root),
s2 AS MATERIALIZED (SELECT a.word, b.root FROM s1 a JOIN s1 b ON b.word = a.root),
s3 AS MATERIALIZED (SELECT a.word, b.root FROM s2 a JOIN s2 b ON b.word = a.root),
s4 AS MATERIALIZED (SELECT a.word, b.root FROM s3 a JOIN s3 b ON b.word = a.root),
s5 AS MATERIALIZED (SELECT a.word, b.root FROM s4 a JOIN s4 b ON b.word = a.root)
SELECT n.word, n.form, s5.root, n.n, n.n_near, n.form_n FROM named n JOIN s5 USING (word)"""


#: The rules that the query applies.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.build(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES["op12_url_filter"] = r"""
WITH rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
r AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rule_host, substr(rule, length(regexp_extract(rule, '^[^/]*')) + 1) AS rule_path FROM rules),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.mine(hard_negatives.integers(rows))


ORACLES["op13_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3"""
