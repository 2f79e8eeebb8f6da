"""Removal of repeated passages by level-wise doubling.

Windows are compared by length: only what repeats in several documents at one length is extended to twice that length,
until the wanted length is reached or nothing survives. The first level compares one anchor for each window of the next
length (the sub-window of smallest hash), which finds every repeat with about a quarter of the windows.

A level is one shuffle of ``(hash, document)`` rows, distinct per document, and the survivors go back to their documents
as one list each, bounded by the document itself. Windows that a bounded sample of documents shows in a good part of all
documents never enter a shuffle row by row: they count as repeated at once, and for the wanted length their smallest
document comes from an aggregation with one row per batch and window. Which windows these are changes no result.

Defined results: null or empty text has no words; a text of fewer words than the window keeps all; windows repeated
within one document only stay; rows of one ``doc_id`` count as one document, each row is judged on its own text; a row
without ``doc_id`` neither loses words nor makes others lose any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.arrays import NON_SPACE, Roller, signed, slices, utf8, word_spans
from symlake.llm.session import Scratch, prepare

U = np.uint64
_WORDS = Roller(51)
#: Two independent hashes of a window; together they stand for its words.
_FIRST, _SECOND = Roller(52), Roller(53)
_ROW = U(0x9E3779B97F4A7C15)


class _Words:
    """Words of some rows and hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = word_spans(data, offsets, NON_SPACE)
        self.hashes = _WORDS.words(data, starts, ends)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def windows(self, n: int, roller: Roller = _FIRST) -> np.ndarray:
        return roller.windows(self.hashes, n)

    def inside(self, n: int) -> np.ndarray:
        """Which windows lie within one row."""
        m = max(len(self.row) - n + 1, 0)
        return self.row[:m] == self.row[n - 1:n - 1 + m]

    def anchors(self, small: int, large: int) -> np.ndarray:
        """For each window of ``large`` words the place of its sub-window of smallest hash."""
        values = self.windows(small)
        m = max(len(self.row) - large + 1, 0)
        best, at = values[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, large - small + 1):
            other = values[k:k + m]
            less = other < best
            best[less] = other[less]
            at[less] = k
        return np.arange(m) + at

    def keys(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for row and window hash."""
        return values[at] + self.row[at].astype(np.uint64) * _ROW


def levels(length: int) -> list[int]:
    """Lengths by doubling that end with ``length``."""
    out = [length]
    while out[0] > 8:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _listed(batch: pa.RecordBatch, name: str, i: int, j: int) -> np.ndarray:
    """Row keys of the hashes listed for rows ``i`` to ``j``, sorted."""
    lists = batch[name].slice(i, j - i)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.sort(values + np.repeat(np.arange(j - i), sizes).astype(np.uint64) * _ROW)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _emit(docs: DataFrame, choose: Callable, extra: str = "") -> DataFrame:
    """``h1, h2, doc`` of the windows that ``choose(words, batch, i, j)`` picks, once per document.

    ``choose`` returns the places and the hashes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            named = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                words = _Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                at, one, two = choose(words, batch, i, j)
                at = at[named[words.row[at] + i]]
                _, once = np.unique(words.keys(one, at), return_index=True)
                at = at[once]
                columns = [pa.array(signed(v[at])) for v in (one, two) if v is not None]
                yield pa.RecordBatch.from_arrays([*columns, batch["doc_id"].take(pa.array(words.row[at] + i))], names=[*["h1", "h2"][:len(columns)], "doc"])

    return docs.mapInArrow(run, f"h1 bigint{extra}, doc {id_type}")


def _first_level(docs: DataFrame, small: int, large: int, hot: np.ndarray) -> DataFrame:
    def choose(words: _Words, batch, i, j):
        values = words.windows(small)
        at = np.unique(words.anchors(small, large)[words.inside(large)])
        return at[~_member(values[at], hot)], values, None

    return _emit(docs.select("doc_id", "text"), choose)


def _next_level(docs: DataFrame, small: int, large: int, hot_small: np.ndarray, hot_large: np.ndarray, anchored: bool) -> DataFrame:
    """Windows of ``large`` words that what survived at ``small`` (column ``known``) leaves possible."""

    def choose(words: _Words, batch, i, j):
        values = words.windows(small)
        known = _member(words.keys(values, np.arange(len(values))), _listed(batch, "known", i, j)) | _member(values, hot_small)
        one = words.windows(large)
        if anchored:
            alive = known[words.anchors(small, large)]
        else:
            alive = known[:len(one)] & known[large - small:large - small + len(one)]
        at = np.flatnonzero(alive & words.inside(large))
        return at[~_member(one[at], hot_large)], one, words.windows(large, _SECOND)

    # No filter here: every level and the end join the same rows, so their texts are shuffled once.
    return _emit(docs, choose, ", h2 bigint")


def _repeated(rows: DataFrame, keys: list[str], test: str) -> DataFrame:
    """``doc, h1`` of the rows that pass ``test`` on the smallest and largest document of their window."""
    same = Window.partitionBy(*keys)
    return (rows.withColumn("lo", F.min("doc").over(same)).withColumn("hi", F.max("doc").over(same))
            .filter(test).select("doc", "h1"))


def _back(docs: DataFrame, survivors: DataFrame, name: str = "known") -> DataFrame:
    """``docs`` with the list of their surviving windows."""
    lists = survivors.groupBy("doc").agg(F.collect_list("h1").alias(name)).withColumnRenamed("doc", "doc_id")
    return docs.join(lists, "doc_id", "left")


def _frequent(docs: DataFrame, sizes: list[int], sample_docs: int, share: float) -> dict[int, np.ndarray]:
    """Windows seen in at least ``share`` of about ``sample_docs`` sampled documents (20 at least): at most
    ``sample windows / 20`` hashes reach the driver."""
    n = docs.count()
    rate = min(1.0, sample_docs / max(n, 1))
    sample = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * rate) + 1))
    least = max(20, int(share * min(n, sample_docs)))
    out = {}
    for size, following in zip(sizes, [*sizes[1:], None]):
        def choose(words: _Words, batch, i, j, size=size, following=following):
            at = np.flatnonzero(words.inside(size)) if following is None else np.unique(words.anchors(size, following)[words.inside(following)])
            return at, words.windows(size), None

        counted = _emit(sample.select("doc_id", "text"), choose).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        out[size] = np.sort(counted.select("h1").toArrow()["h1"].to_numpy().astype(np.int64).view(np.uint64))
    return out


def _owners(docs: DataFrame, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent windows and the smallest document of each."""
    if not len(hot):
        return hot, np.zeros(0, np.int64)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(hot), np.iinfo(np.int64).max)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                words = _Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                values = words.windows(length)
                at = np.flatnonzero(_member(values, hot) & words.inside(length))
                np.minimum.at(least, np.searchsorted(hot, values[at]), ids[i:j][words.row[at]])
        seen = np.flatnonzero(least != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(signed(hot[seen])), pa.array(least[seen])], names=["h1", "doc"])

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"h1 bigint, doc {id_type}")
    got = rows.groupBy("h1").agg(F.min("doc").alias("doc")).toArrow()
    keys = got["h1"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["doc"].to_numpy().astype(np.int64)[order]


def remove_repeats(docs: DataFrame, length: int = 13, sample_docs: int = 5000, share: float = 0.002) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` for every row: ``text`` holds the words that stay, joined by one space.

    A word goes if it lies in a window of ``length`` words that also starts in a document of smaller ``doc_id``;
    windows are judged on the input."""
    prepare(docs)
    docs = docs.select("doc_id", "text")
    sizes = levels(length)
    hot = _frequent(docs, sizes, sample_docs, share)
    hot_keys, hot_docs = _owners(docs, length, hot[length])
    if len(sizes) == 1:
        found = _emit(docs,
                      lambda words, batch, i, j: ((at := np.flatnonzero(words.inside(length)))[~_member(words.windows(length)[at], hot_keys)],
                                                  words.windows(length), words.windows(length, _SECOND)), ", h2 bigint")
    else:
        known = _repeated(_first_level(docs, sizes[0], sizes[1], hot[sizes[0]]), ["h1"], "lo < hi")
        for k in range(1, len(sizes)):
            if k > 1:
                known = _repeated(found, ["h1", "h2"], "lo < hi")
            found = _next_level(_back(docs, known), sizes[k - 1], sizes[k], hot[sizes[k - 1]], hot_keys if k == len(sizes) - 1 else hot[sizes[k]], k == 1)
    gone = _repeated(found, ["h1", "h2"], "lo < doc")
    marked = _back(docs, gone)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids = batch["doc_id"]
            for i, j in slices(offsets):
                lo = offsets[i]
                raw = data[lo:offsets[j]].tobytes()
                cut = (offsets[i:j + 1] - lo).tolist()
                words = _Words(data[lo:offsets[j]], offsets[i:j + 1] - lo)
                values = words.windows(length)
                bad = _member(words.keys(values, np.arange(len(values))), _listed(batch, "known", i, j))
                if len(hot_keys) and len(values):
                    own = ids.slice(i, j - i)
                    numbers = own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[words.row[:len(values)]]
                    at = np.minimum(np.searchsorted(hot_keys, values), len(hot_keys) - 1)
                    bad |= (hot_keys[at] == values) & (hot_docs[at] < numbers)
                bad &= words.inside(length)
                step = np.zeros(len(words.row) + 1, np.int64)
                at = np.flatnonzero(bad)
                step[at] += 1
                step[at + length] -= 1
                keep = np.cumsum(step)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
                counts = np.diff(words.first)
                left = np.diff(kept)
                texts = []
                for k in range(j - i):
                    own = raw[cut[k]:cut[k + 1]].split()
                    if left[k] < counts[k]:
                        own = compress(own, keep[words.first[k]:words.first[k + 1]].tolist())
                    texts.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(counts), pa.array(counts - left), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"])

    return marked.mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, text string")


def longest_repeats(docs: DataFrame, start: int = 13) -> DataFrame:
    """``doc_id, n_words``: the longest of the lengths ``start``, ``2 start``, ``4 start`` ... at which the document
    shares a window with another one; documents that share none are left out. Runs until nothing survives."""
    scratch = Scratch(prepare(docs), "longest-repeats")
    docs = docs.select("doc_id", "text")
    none = np.zeros(0, np.uint64)
    rows = _emit(docs,
                 lambda words, batch, i, j: (np.flatnonzero(words.inside(start)), words.windows(start), words.windows(start, _SECOND)), ", h2 bigint")
    size, found = start, None
    while True:
        known, n = scratch.save(_repeated(rows, ["h1", "h2"], "lo < hi"), f"level-{size}")
        if not n:
            break
        level = known.select(F.col("doc").alias("doc_id")).distinct().withColumn("n_words", F.lit(size).cast("bigint"))
        found = level if found is None else found.unionAll(level)
        rows = _next_level(_back(docs, known), size, 2 * size, none, none, anchored=False)
        size *= 2
    if found is None:
        return docs.select("doc_id").filter("false").withColumn("n_words", F.lit(0).cast("bigint"))
    return found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))

