"""As-of lookups: the greatest right position at or below a left position, per key.

Rows of both sides are dealt by range over (key, position), so one key may span any number of partitions. Each
partition is scanned on its own, and what the partitions before it hold of the same key (one row per key and partition)
is carried in. There is one way for keys of every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symlake.session import Scratch


def asof_floor(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, value: str) -> DataFrame:
    """``left`` plus ``value`` and ``matched_pos`` of the last right row at or below ``left_pos``; ties on the
    right take the highest value. No match gives nulls, and so does a null key or position."""
    right = right.dropna(subset=[*keys, right_pos])
    usable = F.lit(True)
    for c in (*keys, left_pos):
        usable = usable & F.col(c).isNotNull()
    hit = right.select(F.struct(F.col(right_pos).alias("_pos"), F.col(value).alias("_value")).alias("_hit"))
    row = F.struct(*left.columns)
    asked = left.filter(usable).select(*keys, F.col(left_pos).alias("_pos"), F.lit(1).alias("_side"), row.alias("_row"),
                                       F.lit(None).cast(hit.schema[0].dataType).alias("_hit"))
    known = right.select(*keys, F.col(right_pos).alias("_pos"), F.lit(0).alias("_side"),
                         F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"),
                         F.struct(F.col(right_pos).alias("_pos"), F.col(value).alias("_value")).alias("_hit"))
    # A hash spreads even rows of one key and position.
    laid, _ = Scratch(left.sparkSession, "asof").save(
        asked.unionByName(known).repartitionByRange(*keys, "_pos", "_side", F.xxhash64("_row", "_hit"))
        .withColumn("_part", F.spark_partition_id()), "laid")
    # A hit is (position, value), so the last one is the greatest one so far.
    inside = W.partitionBy(*keys, "_part").orderBy("_pos", "_side").rowsBetween(W.unboundedPreceding, 0)
    scanned = laid.withColumn("_in", F.max("_hit").over(inside)).filter(F.col("_side") == 1)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = laid.groupBy(*keys, "_part").agg(F.max("_hit").alias("_tail")).withColumn(
        "_carry", F.max("_tail").over(before)).drop("_tail")
    last = F.coalesce("_in", "_carry")
    found = scanned.join(carry, [*keys, "_part"], "left").select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns], last["_value"].alias(value), last["_pos"].alias("matched_pos"))
    return found.unionByName(left.filter(~usable).select(
        *left.columns, F.lit(None).cast(found.schema[value].dataType).alias(value), F.lit(None).cast(found.schema["matched_pos"].dataType).alias("matched_pos")))


def line_lookup(requests: DataFrame, line_map: DataFrame) -> DataFrame:
    """View line for ``requests(container, entry_path, line)``: the view line of the greatest source line at or
    below the request, the highest one on ties, and 1 without any."""
    known = line_map.filter(F.col("src_line") > 0)
    return asof_floor(requests, known, ["container", "entry_path"], "line", "src_line", "view_line") \
        .withColumn("view_line", F.coalesce("view_line", F.lit(1))).drop("matched_pos")


def enclosing_declaration(offsets: DataFrame, declarations: DataFrame) -> DataFrame:
    """Type declared at or before ``offsets(container, entry_path, offset)``; null ahead of the first one."""
    return asof_floor(offsets, declarations, ["container", "entry_path"], "offset", "start", "type_name")
