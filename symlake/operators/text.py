"""Finding ranges inside text columns."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.patterns import find_regex


def _ranges(text: Column, regex: str) -> Column:
    """Array of ``(hit_start, hit_end)`` of all non-empty matches, in order, from the row alone: a match starts where
    the gaps and matches before it end."""
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, F.lit(regex), 0), lambda h: F.length(h))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda z: z["hit"].isNotNull())
    # Bound to a lambda variable, so that the matches are looked for once and not for every block.
    return F.transform(F.array(steps), _placed)[0]


def _placed(steps: Column) -> Column:
    """Ranges of all steps. A fold that appends copies what it has got so far, so it only ever runs over one block, and
    once over the blocks."""
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps), F.lit(BLOCK)), lambda i: i < F.size(steps)),
                         lambda i: F.slice(steps, i + 1, F.lit(BLOCK)))
    return F.flatten(_fold(blocks, "array<struct<start:int,steps:array<struct<gap:int,hit:int>>>>",
                           lambda at, b: F.struct(at.alias("start"), b.alias("steps")),
                           lambda b: F.aggregate(b, F.lit(0), lambda n, z: n + z["gap"] + z["hit"]),
                           lambda placed: F.transform(placed, lambda p: _fold(
                               p["steps"], "array<struct<hit_start:int,hit_end:int>>",
                               lambda at, z: F.struct((at + z["gap"]).alias("hit_start"), (at + z["gap"] + z["hit"]).alias("hit_end")),
                               lambda z: z["gap"] + z["hit"], start=p["start"]))))


#: Hits of a text that are numbered in one go.
BLOCK = 256


def _fold(items: Column, kind: str, item: Callable, length: Callable, finish: Callable = lambda out: out, start: Column | None = None) -> Column:
    """``item(at, x)`` for every ``x`` of ``items``, where ``at`` is ``start`` plus the lengths of those before it."""
    first = F.struct((F.lit(0) if start is None else start).alias("at"), F.expr(f"cast(array() AS {kind})").alias("out"))
    return F.aggregate(items, first, lambda acc, x: F.struct(
        (acc["at"] + length(x)).alias("at"), F.array_append(acc["out"], item(acc["at"], x)).alias("out")), lambda acc: finish(acc["out"]))


def range_hits(df: DataFrame, ids: list[str], col: str, regex: str) -> DataFrame:
    """All non-empty matches of ``regex`` as ``(ids, hit_no, hit_start, hit_end)``; offsets count characters. Nothing
    leaves the scan stage but the hits."""
    text = F.col(col)
    return (
        df.filter(text.rlike(regex)).select(*ids, F.posexplode(_ranges(text, regex)).alias("hit_no", "h"))
        .select(*ids, "hit_no", F.col("h.hit_start").alias("hit_start"), F.col("h.hit_end").alias("hit_end"))
        .filter(F.col("hit_end") > F.col("hit_start"))
    )


def _needle_regex(needle: str, case_sensitive: bool = True) -> str:
    literal = "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in needle)
    return literal if case_sensitive else "(?iu)" + literal


def text_hits(df: DataFrame, ids: list[str], col: str, pattern: str) -> DataFrame:
    """Ranges of a wildcard pattern inside text; ``*`` stays within a line."""
    if pattern.strip("*") == "":
        return range_hits(df, ids, col, ".+")
    return range_hits(df, ids, col, find_regex(pattern))


def find_text(df: DataFrame, ids: list[str], col: str, needle: str, case_sensitive: bool = True) -> DataFrame:
    """Every occurrence of a plain needle; needles under two characters find nothing."""
    if len(needle) < 2:
        return range_hits(df.limit(0), ids, col, "..")
    return range_hits(df, ids, col, _needle_regex(needle, case_sensitive))


def find_next(df: DataFrame, ids: list[str], col: str, needle: str, caret: str,
              case_sensitive: bool = True, forward: bool = True) -> DataFrame:
    """Per row: number of hits and the next one at or after ``caret``, or the last one ending at or before it
    when searching backwards; past the edge the search wraps around."""
    if len(needle) < 2:
        df, needle = df.limit(0), ".."
    regex = _needle_regex(needle, case_sensitive)
    rows = df.filter(F.col(col).rlike(regex)).select(*ids, caret, _ranges(F.col(col), regex).alias("hits"))
    if forward:
        chosen = F.coalesce(F.get(F.filter("hits", lambda h: h["hit_start"] >= F.col(caret)), F.lit(0)), F.get("hits", F.lit(0)))
    else:
        chosen = F.coalesce(F.try_element_at(F.filter("hits", lambda h: h["hit_end"] <= F.col(caret)), F.lit(-1)), F.try_element_at("hits", F.lit(-1)))
    return rows.select(*ids, caret, F.size("hits").cast("bigint").alias("n_hits"), chosen.alias("h")).select(
        *ids, caret, "n_hits", F.col("h.hit_start").alias("next_start"), F.col("h.hit_end").alias("next_end"))
