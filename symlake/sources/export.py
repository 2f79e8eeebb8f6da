"""Export of whole containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.operators.resolve import remove_inner
from symlake.sources.archives import ARCHIVE_EXTENSIONS

# Container types whose nested class entries are folded into their outer class.
FOLDED_TYPES = ["jar", "war", "ear"]


def _stem(path: Column) -> Column:
    """Path without its last extension; a dot in a directory name does not count."""
    name = F.substring_index(path, "/", -1)
    ext = F.substring_index(name, ".", -1)
    return F.when(name.contains("."), F.substring(path, F.lit(1), F.length(path) - F.length(ext) - 1)).otherwise(path)


def export_path(path: Column) -> Column:
    ext = F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))
    named = F.substring_index(path, "/", -1).contains(".")
    return (
        F.when(named & (ext == "class"), F.concat(_stem(path), F.lit(".java")))
        .when(named & ext.isin(ARCHIVE_EXTENSIONS), F.concat(_stem(path), F.lit("-sources.jar")))
        .otherwise(path)
    )


def export_plan(entries: DataFrame, inner_classes: DataFrame) -> DataFrame:
    """``(container, entry_path, target_path)`` for every file to write; listed nested classes of folded
    container types are left out because they go into the file of their outer class."""
    files = entries.filter(~F.col("is_dir")).select("container", "container_type", "entry_path")
    folded = F.col("container_type").isin(FOLDED_TYPES)
    kept = remove_inner(files.filter(folded), inner_classes).unionByName(files.filter(~folded))
    return kept.select("container", "entry_path", export_path(F.col("entry_path")).alias("target_path"))


def export_file_count(entries: DataFrame) -> DataFrame:
    """Files an export will write per container: nested classes and archives themselves count 0 (the content of
    an archive counts through its own rows), every other file 1."""
    path = F.col("entry_path")
    ext = F.lower(F.substring_index(path, ".", -1))
    weight = F.when(path.endswith(".class") & path.contains("$"), 0).when(
        path.contains(".") & ext.isin(ARCHIVE_EXTENSIONS), 0).otherwise(1)
    return entries.filter(~F.col("is_dir")).groupBy("container").agg(F.sum(weight).alias("n_files"))


def export_entries(plan: DataFrame, entries: DataFrame, out: str) -> None:
    """Write the planned entries, byte for byte, as a table ``(container, target_path, content)``. Rows are ranged and
    sorted by container and path: small containers share a file, large ones spread over several, and a reader of one
    container skips the files of all others."""
    content = entries.filter(F.col("content").isNotNull()).select("container", "entry_path", "content")
    (
        plan.join(content, ["container", "entry_path"])
        .select("container", "target_path", "content")
        .repartitionByRange("container", "target_path").sortWithinPartitions("container", "target_path")
        .write.mode("overwrite").parquet(out)
    )
