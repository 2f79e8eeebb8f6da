"""Incremental index: new or replaced archives flow into a log-structured posting table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake import model
from symlake.operators.index import index_entries
from symlake.operators.postings import build_postings
from symlake.sources.archives import archive_glob, expand_archives
from symlake.sources.index_store import write_index

# Schema of the binaryFile source.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def append_batch(files: DataFrame, batch_id: int, path: str, source: str = "manual") -> None:
    """Index one batch of archive files of one ``source`` (a name of its own for every stream). A replayed batch
    overwrites its own folders and no other's; an archive that comes again supersedes its older rows through the
    container log."""
    entries = expand_archives(files.select(
        F.col("path").alias("container"), F.col("path").alias("root_container"), F.lit(0).alias("depth"), "content"))
    part = f"source={source}/batch={batch_id}"
    found = index_entries(entries)
    write_index(build_postings(found["postings"]), f"{path}/postings/{part}")
    for name in ("supertypes", "texts"):
        found[name].write.mode("overwrite").parquet(f"{path}/{name}/{part}")
    files.select(F.col("path").alias("root_container"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{path}/containers/{part}")


def stream_index(spark: SparkSession, source: str, path: str, checkpoint: str,
                 max_files: int = 1000) -> StreamingQuery:
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", archive_glob())
        .option("maxFilesPerTrigger", max_files).load(source)
    )
    return (
        files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, path, stream_id(spark, checkpoint))).start()
    )


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the stream that owns a checkpoint: Spark writes it there before the first batch."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def read_stream_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings of the latest version of every archive."""
    return _latest(spark, path, "postings", model.POSTINGS)


def read_stream_supertypes(spark: SparkSession, path: str) -> DataFrame:
    """Super types of the latest version of every archive, for the hierarchy operators."""
    return _latest(spark, path, "supertypes", model.SUPERTYPES)


def _latest(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema + ", source string, batch bigint").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    log = spark.read.schema("root_container string, at timestamp, source string, batch bigint").option(
        "basePath", f"{path}/containers").parquet(f"{path}/containers")
    latest = log.groupBy("root_container").agg(F.max(F.struct("at", "batch", "source")).alias("v")).select(
        "root_container", F.col("v.source").alias("source"), F.col("v.batch").alias("batch"))
    root = F.substring_index("container", "!/", 1)
    return rows.withColumn("root_container", root).join(
        latest, ["root_container", "source", "batch"], "left_semi").select(*[c.split(" ")[0] for c in schema.split(", ")])
