"""What every operator here needs from the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.session import Scratch, ship_package

__all__ = ["TASK_BYTES", "Scratch", "ids_and_texts", "prepare", "table", "tasks_for"]

#: Bytes of compressed files that one task reads by range.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(df: DataFrame) -> SparkSession:
    """Make this package importable in the Python workers of the session of ``df``."""
    ship_package(df.sparkSession)
    return df.sparkSession


def tasks_for(amount: int, per_task: int) -> int:
    """Tasks that handle about ``per_task`` of ``amount`` each. An explicit count is kept by adaptive execution, which
    would merge rows that are few but stand for much."""
    return max(1, -(-amount // per_task))


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """The two columns the operators read. Other columns, whatever their names, never reach them."""
    return docs.select(F.col("doc_id"), F.col("text"))
