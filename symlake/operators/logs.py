"""Stack traces in logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.locators import build_locator
from symlake.functions.names import simple_name
from symlake.sources.logs import lines_from_column

# One frame of a stack trace, with any loader or module prefix skipped.
FRAME = r"^\s*at (?:[^\s/(]*/)*([^\s/(]+)\.([^\s/.(]+)\(([^)]*)\)"
NATIVE = "Native Method"


def stack_frames(lines: DataFrame, text: str = "text") -> DataFrame:
    """Frames among ``lines``: ``type_name`` (internal), ``method``, ``file``, ``line`` and ``native`` next to the
    other columns. Lines that are not frames drop out. Works on streams too."""
    c = F.col(text)
    where = F.regexp_extract(c, FRAME, 3)
    keep = [x for x in lines.columns if x != text]
    return lines.filter(c.rlike(FRAME)).select(
        *keep,
        F.translate(F.regexp_extract(c, FRAME, 1), ".", "/").alias("type_name"),
        F.regexp_extract(c, FRAME, 2).alias("method"),
        F.when(where.contains(":"), F.substring_index(where, ":", 1)).alias("file"),
        F.when(where.rlike(r":\d+$"), F.regexp_extract(where, r":(\d+)$", 1)).cast("int").alias("line"),
        (where == NATIVE).alias("native"))


def frames_from_column(df: DataFrame, col: str, ids: list[str]) -> DataFrame:
    """Frames of log text held in a column, with ``line_no`` inside each text."""
    return stack_frames(lines_from_column(df, col, ids))


def declared_targets(decls: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per type: number of declaring entries and the first of them, at its outermost entry if ``roots``
    (see ``hierarchy.root_entries``) is given. A stored result of this function passes through, which spares
    streams the aggregation in every batch."""
    if "n_targets" in decls.columns:
        return decls
    if roots is not None:
        decls = decls.join(roots, ["container", "entry_path"], "left").withColumn(
            "entry_path", F.coalesce("root_entry", "entry_path"))
    return (
        decls.select("type_name", "container", "entry_path").distinct().groupBy("type_name")
        .agg(F.count(F.lit(1)).alias("n_targets"), F.min(F.struct("container", "entry_path")).alias("t"))
        .select("type_name", "n_targets", F.col("t.container").alias("container"),
                F.col("t.entry_path").alias("entry_path"))
    )


def link_frames(frames: DataFrame, decls: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``frames`` with the number of declaring entries and a locator into the first: a line query, or a member
    fragment for native methods. Unknown types keep a null locator."""
    targets = declared_targets(decls, roots)
    query = F.when(~F.col("native") & F.col("line").isNotNull(),
                   F.concat(F.lit("lineNumber="), F.col("line").cast("string")))
    fragment = F.when(F.col("native"), F.concat(simple_name("type_name"), F.lit("-"), "method", F.lit("-(*)?")))
    return frames.join(targets, "type_name", "left").select(
        *frames.columns, F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
        F.when(F.col("n_targets").isNotNull(), build_locator("container", "entry_path", query, fragment))
        .alias("locator"))


def hot_frames(frames: DataFrame) -> DataFrame:
    return frames.groupBy("type_name", "method", "line").agg(F.count(F.lit(1)).alias("n_frames"))
