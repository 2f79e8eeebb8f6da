"""Stored symbol index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake import model



def write_index(postings: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None,
                max_records_per_file: int = 20_000_000) -> None:
    """Write postings by ``index_name``, range-partitioned and sorted by key.

    Every file covers a narrow key range, so exact and prefix lookups skip most files and row groups. An entry hash
    is the last range column: a key that owns a large share of all rows spreads over as many files as its share
    asks for. The number of ranges follows ``spark.sql.shuffle.partitions`` unless given.
    """
    spread = F.xxhash64("container", "entry_path")
    columns = ["index_name", "key", spread]
    ranged = postings.repartitionByRange(partitions, *columns) if partitions else postings.repartitionByRange(*columns)
    (
        ranged.sortWithinPartitions("index_name", "key")
        .write.mode(mode).option("maxRecordsPerFile", max_records_per_file).partitionBy("index_name").parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.POSTINGS).parquet(path).select("index_name", "key", "container", "entry_path")
