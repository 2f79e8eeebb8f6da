"""Orderings that carry meaning: entry lists and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.operators.postings import BLOCK_SIZE, grouped_lists, positions


def sorted_entries(entries: DataFrame, by_parent: bool = True) -> DataFrame:
    """Directories first, then path. With ``by_parent`` each row gets its ``position`` among its siblings, else
    the whole table is range-sorted."""
    if not by_parent:
        return entries.orderBy("container", F.desc("is_dir"), "entry_path")
    return positions(entries, ["container", "parent_path"], [F.desc("is_dir"), F.asc("entry_path")])


def outline(members: DataFrame, label: str = "display_name", block_size: int = BLOCK_SIZE) -> DataFrame:
    """Sorted distinct members per type: ``(container, type_name, block, members, n_block)``."""
    shown = members.select("container", "type_name", "kind", F.col(label).alias("label"))
    return grouped_lists(shown, ["container", "type_name"], ["kind", "label"], "members", block_size)
