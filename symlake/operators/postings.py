"""Posting tables: building, grouping, counting.

The long form ``(index_name, key, container, entry_path)`` is the working form. Grouped forms split a long list
into blocks, so one key may own any share of the corpus without its list landing in a single row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symlake.session import Scratch

BLOCK_SIZE = 65_536


def build_postings(symbols: DataFrame) -> DataFrame:
    """One row per distinct ``(index_name, key, container, entry_path)``; empty keys of text are kept."""
    return symbols.filter(F.col("key").isNotNull()).dropDuplicates(
        ["index_name", "key", "container", "entry_path"])


def positions(df: DataFrame, groups: list[str], order: list[Column], out: str = "position", distinct: bool = False) -> DataFrame:
    """Row number per group, from 1, for groups of any size.

    Rows are spread by range over (group, order), so a group may span many partitions, sorted there and numbered in that
    order; a written table fixes the numbers. Less what a group's rows start with in a partition, plus what the
    partitions before hold of it, they are the positions: the rows are moved and sorted once. Equal rows of the order
    are told apart by a hash of all columns, so numbers are repeatable. ``distinct`` drops repeated rows on the way, for
    which ``order`` must name all other columns."""
    scratch = Scratch(df.sparkSession, "positions")
    tie = [] if distinct else [F.xxhash64(*df.columns)]
    spread = df.repartitionByRange(*groups, *order, *tie)
    if distinct:
        spread = spread.distinct()
    laid, _ = scratch.save(spread.sortWithinPartitions(*groups, *order, *tie).withColumn("_id", F.monotonically_increasing_id()), "laid")
    # The partition is in the upper bits.
    part = F.shiftright("_id", 33)
    named = [F.col(g).alias(f"_g_{g}") for g in groups]
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts, _ = scratch.save(laid.groupBy(*groups, part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")).select(
        *named, F.col("_part").alias("_at"), (F.col("_first") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - 1).alias("_start")), "starts")
    same = part == F.col("_at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return laid.join(starts, same).withColumn(out, (F.col("_id") - F.col("_start")).cast("int")).select(*df.columns, out)


def grouped_lists(pairs: DataFrame, keys: list[str], values: list[str], out: str = "entries",
                  block_size: int = BLOCK_SIZE) -> DataFrame:
    """``keys -> sorted set of values`` as rows ``(keys, block, n_block, out)``: block ``k`` holds the values number
    ``k * block_size`` to ``(k + 1) * block_size - 1`` in order, so no row grows with the data."""
    numbered = positions(pairs.select(*keys, *values), keys, [F.col(v) for v in values], "_n", distinct=True)
    block = F.floor((F.col("_n") - 1) / block_size).cast("int")
    item: Column = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    return (
        numbered.groupBy(*keys, block.alias("block"))
        .agg(F.array_sort(F.collect_list(item)).alias(out))
        .withColumn("n_block", F.size(out))
    )


def postings_grouped(postings: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(index_name, key, block) -> entries``."""
    return grouped_lists(postings, ["index_name", "key"], ["container", "entry_path"], "entries", block_size)


def subtype_lists(supertypes: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``(super_name, block) -> sub types``."""
    return grouped_lists(supertypes, ["super_name"], ["type_name"], "sub_types", block_size)


def merge_locations(declarations: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Locations of each type name over all containers: ``(type_name, block) -> locations``."""
    return grouped_lists(declarations, ["type_name"], ["container", "entry_path"], "locations", block_size)


def match_counts(matches: DataFrame) -> DataFrame:
    """Distinct matching entries per container and, as ``container = NULL``, in total.

    Entries belong to one container, so the total is the sum of the per-container counts and only those counts
    pass through the roll-up.
    """
    per_container = (
        matches.select("container", "entry_path").distinct()
        .groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    )
    return per_container.rollup("container").agg(F.sum("n").alias("n_matches"))


def ambiguous_declarations(declarations: DataFrame) -> DataFrame:
    """Type names declared by more than one entry."""
    return (
        declarations.select("type_name", "container", "entry_path").distinct()
        .groupBy("type_name").agg(F.count(F.lit(1)).alias("n_entries"),
                                  F.min(F.struct("container", "entry_path")).alias("first"))
        .filter(F.col("n_entries") > 1)
        .select("type_name", "n_entries", F.col("first.container").alias("first_container"),
                F.col("first.entry_path").alias("first_entry"))
    )


def by_root_container(entries: DataFrame) -> DataFrame:
    return entries.groupBy("root_container").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("length").alias("total_length"))


def usage_rank(postings: DataFrame, approximate: bool = False, distinct: bool = False) -> DataFrame:
    """How many entries use each key. ``approximate`` trades the distinct shuffle for a sketch per key;
    ``distinct=True`` says the rows are distinct already (as from ``build_postings``), which leaves one shuffle of
    pre-aggregated counts."""
    if distinct and not approximate:
        return postings.groupBy("index_name", "key").agg(F.count(F.lit(1)).alias("n_entries"))
    if approximate:
        return postings.groupBy("index_name", "key").agg(
            F.approx_count_distinct(F.struct("container", "entry_path")).alias("n_entries"))
    return (
        postings.select("index_name", "key", "container", "entry_path").distinct()
        .groupBy("index_name", "key").agg(F.count(F.lit(1)).alias("n_entries"))
    )


def union_containers(*tables: DataFrame) -> DataFrame:
    """Union of the same table from several containers or batches."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
