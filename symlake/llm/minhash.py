"""Near-duplicate detection: tensored minhash banding, candidates verified on whole shingle sets.

Two small collections of half keys are computed, ``halves`` on each side of ``rows`` minimum hashes each. A table key
is one left half with one right half, so ``2 * halves * rows`` minimum hashes fill ``halves**2`` tables. A pair of
similarity ``s`` meets in no table with probability at most ``2 * (1 - s**rows)**halves``: 8e-5 at 0.8 by default, the
worst case, 4e-7 at 0.9.

Work is one row per document and table, never one per pair:

1. documents with equal shingle sets form a class and only its smallest id goes on;
2. in every table entry, members are compared with the smallest one only;
3. members of different components that share a smallest member are compared by their differences from it
   (``_links_across``: exact), so no link between components is lost, whatever the size of the entry;
4. confirmed links are contracted to components (``symlake.llm.components``).

Defined results: null or empty text has no shingles and is linked with nothing; a text of one word (fewer words than a
shingle) is one shingle; repeated rows of one id are copies of each other where their texts agree; a row with null
``doc_id`` gets the component of its copies and is never the one that stays if a copy has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.arrays import LOWER, NON_SPACE, Roller, mix, releasing, signed, slices, utf8, word_spans
from symlake.llm.components import components
from symlake.llm.session import Scratch, prepare, tasks_for

U = np.uint64
#: Rows of table keys that one task puts out.
TASK_ROWS = 500_000
_WORDS, _SHINGLES = Roller(91), Roller(92)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, one after the other, and the offsets of the rows in them."""
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    hashes = _WORDS.words(LOWER[data], starts, ends)
    grams = _SHINGLES.windows(hashes, width)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(grams[a:b - width + 1]))
        else:
            sets.append(_SHINGLES.spans(hashes, np.array([a]), np.array([b])) if b > a else hashes[:0])
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _minimum_hashes(flat: np.ndarray, at: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One row per non-empty set, one column per hash function."""
    out = np.empty((len(at), len(factors)), dtype=np.uint64)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(flat * f, at)
    return out


def signatures(docs: DataFrame, width: int = 2, halves: int = 10, rows: int = 2, seed: int = 7) -> DataFrame:
    """``doc_id, n_shingles, s1, s2`` (the set's identity) ``, lefts, rights`` (half keys; empty for an empty set)."""
    factors = np.random.default_rng(seed).integers(1 << 61, 1 << 63, 2 * halves * rows, dtype=np.uint64) | U(1)
    prepare(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in slices(offsets):
                flat, cut = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)
                sizes = np.diff(cut)
                full = np.flatnonzero(sizes)
                at = cut[:-1][full]
                ident = np.zeros((j - i, 2), dtype=np.uint64)
                halfkeys = np.zeros((len(full), 2, halves), dtype=np.uint64)
                if len(full):
                    for c in range(2):
                        ident[full, c] = np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D * (c + 1) & (1 << 63) - 1)), at)
                    least = _minimum_hashes(flat, at, factors).reshape(len(full), 2, halves, rows)
                    for r in range(rows):
                        halfkeys = mix(halfkeys * U(0x2545F4914F6CDD1D) + least[..., r])
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, halves, 0))]).astype(np.int32)
                sides = [pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(halfkeys[:, s]).ravel())))
                         for s in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(sizes), pa.array(signed(np.ascontiguousarray(ident[:, 0]))),
                     pa.array(signed(np.ascontiguousarray(ident[:, 1]))), *sides],
                    names=["doc_id", "n_shingles", "s1", "s2", "lefts", "rights"])

    return docs.select("doc_id", "text").mapInArrow(
        releasing(run), f"doc_id {id_type}, n_shingles bigint, s1 bigint, s2 bigint, lefts array<bigint>, rights array<bigint>")


def table_keys(signed_docs: DataFrame) -> DataFrame:
    """``key, doc``: one row per document and table; a key joins a left half, a right half and their places."""
    pairs = "flatten(transform(lefts, (l, i) -> transform(rights, (r, j) -> xxhash64(l, r, i * 1000 + j))))"
    return signed_docs.select(F.explode(F.expr(pairs)).alias("key"), F.col("doc_id").alias("doc"))


def compare(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """``a, b, linked, size_a, size_b, apart`` for pairs ``(a, b)``, from whole texts: are the shingle sets similar
    (``100 * intersection >= percent * union``), their sizes, and the shingles that only one of them has."""
    prepare(docs)
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [utf8(batch[c]) for c in ("text_a", "text_b")]
            linked, sizes, apart = [], [], []
            ids = batch["b"].to_numpy(zero_copy_only=False)
            last, last_set = None, None
            for k in range(batch.num_rows):
                if last is None or ids[k] != last:
                    last, last_set = ids[k], _one_set(*columns[1], k, width)
                own = _one_set(*columns[0], k, width)
                different = np.setxor1d(own, last_set, assume_unique=True)
                total = len(own) + len(last_set)
                linked.append((100 + percent) * len(different) <= (100 - percent) * total)
                sizes.append((len(own), len(last_set)))
                apart.append(signed(different))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in apart])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(apart) if apart else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array(linked, pa.bool_()), pa.array([x for x, _ in sizes], pa.int64()),
                 pa.array([y for _, y in sizes], pa.int64()), lists], names=["a", "b", "linked", "size_a", "size_b", "apart"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), f"{kinds}, linked boolean, size_a bigint, size_b bigint, apart array<bigint>")


def _one_set(data: np.ndarray, offsets: np.ndarray, k: int, width: int) -> np.ndarray:
    lo, hi = offsets[k], offsets[k + 1]
    return shingle_sets(data[lo:hi], np.array([0, hi - lo]), width)[0]


def _links_across(compared: DataFrame, found: DataFrame, percent: int, x_tokens: int = 200_000, y_tokens: int = 1_000_000) -> DataFrame:
    """Links ``(a, b)`` between members of different components that were compared with one smallest member (hub).

    Let ``D(x)`` be the shingles in which ``x`` and the hub differ. ``x`` and ``y`` differ in
    ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|`` shingles, so their similarity follows from these short lists alone, exactly and
    without their texts. Two members that are linked to the hub are in one component already, so one of a pair is not:
    the few such members (side x) meet all (side y) in blocks of bounded size, in which an inverted list over the
    differences of the x side counts what is shared. Only links leave a block, never pairs."""
    prepare(compared)
    placed = compared.join(found.select(F.col("node").alias("a"), "component"), "a", "left").select(
        F.col("b").alias("hub"), F.col("a").alias("doc"), F.coalesce("component", "a").alias("component"), "linked", F.col("size_a").alias("size"), "apart")
    n = F.size("apart").cast("bigint")
    hubs = placed.groupBy("hub").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum(F.when(F.col("linked"), 0).otherwise(n)).alias("x"), F.sum(n).alias("y")
    ).filter("lo < hi").select("hub", F.ceil(F.col("x") / x_tokens).alias("x_blocks"), F.ceil(F.col("y") / y_tokens).alias("y_blocks"))
    rows = placed.join(hubs, "hub")
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))
    keep = ["hub", "doc", "component", "size", "apart"]
    x = rows.filter("NOT linked").select(*keep, F.pmod(F.xxhash64("doc", F.lit(1)), F.col("x_blocks")).alias("i"), every("y_blocks").alias("j"))
    y = rows.filter("x_blocks > 0").select(*(F.col(c).alias(f"y_{c}") for c in keep), every("x_blocks").alias("y_i"), F.pmod(
        F.xxhash64("doc", F.lit(2)), F.col("y_blocks")).alias("y_j"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [[t[f"{side}{c}"].combine_chunks() for c in ("doc", "component", "size", "apart")] for t, side in ((left, ""), (right, "y_"))]
        (x_doc, x_part, x_size), (y_doc, y_part, y_size) = ([c.to_numpy(zero_copy_only=False) for c in s[:3]] for s in sides)
        (x_cut, x_all), (y_cut, y_all) = ((s[3].offsets.to_numpy() - s[3].offsets[0].as_py(), s[3].flatten().to_numpy()) for s in sides)
        x_n, y_n = np.diff(x_cut), np.diff(y_cut)
        order = np.argsort(x_all, kind="stable")
        tokens, owner = x_all[order], np.repeat(np.arange(len(x_doc)), x_n)[order]
        first, last = np.searchsorted(tokens, y_all, "left"), np.searchsorted(tokens, y_all, "right")
        a, b = [], []
        for k in range(len(y_doc)):
            lo, hi = first[y_cut[k]:y_cut[k + 1]], last[y_cut[k]:y_cut[k + 1]]
            some = np.flatnonzero(hi > lo)
            shared = np.bincount(np.concatenate([owner[lo[q]:hi[q]] for q in some]), minlength=len(x_doc)) if len(some) else np.zeros(len(x_doc), np.int64)
            good = ((100 + percent) * (x_n + y_n[k] - 2 * shared) <= (100 - percent) * (x_size + y_size[k])) & (x_part != y_part[k])
            a += x_doc[good].tolist()
            b += [y_doc[k]] * int(good.sum())
        return pa.table({"a": pa.array(a, left["doc"].type), "b": pa.array(b, left["doc"].type)})

    kind = compared.schema["a"].dataType.simpleString()
    return x.groupBy("hub", "i", "j").cogroup(y.groupBy("y_hub", "y_i", "y_j")).applyInArrow(meet, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, halves: int = 10, rows: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at least ``percent`` similarity."""
    spark = prepare(docs)
    scratch = Scratch(spark, "minhash")
    marked, _ = scratch.save(signatures(docs, width, halves, rows), "signatures")
    classes, n_classes = scratch.save(
        marked.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "classes")
    reps = marked.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).filter("doc_id = rep").select("doc_id", "lefts", "rights")

    # A row becomes halves**2 rows: the number of tasks follows what they put out, which adaptive execution cannot see.
    keys = table_keys(reps.repartition(tasks_for(n_classes * halves * halves, TASK_ROWS), "doc_id"))
    shared = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).filter("hub < last").select("key", "hub")
    pairs = keys.join(shared, "key").filter("doc != hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    compared, _ = scratch.save(compare(pairs, docs, percent, width), "compared")
    links = compared.filter("linked").select("a", "b")
    found = components(links, scratch, "stars-1")
    more, n = scratch.save(_links_across(compared, found, percent), "links-2")
    if n:
        found = components(links.unionAll(more), scratch, "stars-2")
    named = classes.select("s1", "s2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, halves: int = 10, rows: int = 2) -> DataFrame:
    """``docs`` without the near copies of a document of smaller id; all columns stay. Rows that share a ``doc_id`` stay
    or go together, rows without one stay."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    gone, _ = scratch.save(near_duplicates(docs, width, percent, halves, rows).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
