"""Log sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines of all log files as ``(source, text)``. Large files are split by Spark."""
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
        .select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    )


def stream_logs(spark: SparkSession, path: str, glob: str = "*.log", max_files: int = 1000) -> DataFrame:
    """The same lines as a stream over a growing directory."""
    return (
        spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).text(path)
        .select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    )


def lines_from_column(df: DataFrame, col: str, ids: list[str]) -> DataFrame:
    """Lines of text held in a column as ``(ids, line_no, text)``, numbered from 1."""
    return df.select(*ids, F.posexplode(F.split(F.col(col), "\r?\n", -1)).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no") + 1)
