"""From raw documents to token ids: five stages, each over the whole of what the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the result is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``docs`` unchanged in name, order and type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm import bpe, decontaminate, language, minhash, secret_scan
from symlake.llm.queries import byte_vocabulary
from symlake.session import scratch_root


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without text, or whose text has no letter, go."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8 or more) the smallest ``doc_id`` stays."""
    return minhash.keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten or more benchmark words go; a document that is mostly such passages goes as a whole."""
    return decontaminate.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_bytes, n_tokens, ids, ids_sha256``: the token ids, decoded again and compared with the
    text on the way."""
    tokens = bpe.encode(docs, byte_vocabulary(), keep=["lang", "source"], verify=True)
    return tokens.select("doc_id", "lang", "source", "n_bytes", bpe.count_tokens("ids").alias("n_tokens"), "ids",
                         F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_copies), ("decontamination", remove_benchmark),
          ("secret_scan", redact_secrets), ("byte_bpe", tokenize)]

#: Trained models, minhash sampling and byte-pair merges have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    base = f"{scratch_root(spark)}/symlake/pipeline-{uuid.uuid4().hex[:12]}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
