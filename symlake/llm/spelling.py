"""Spelling variants: words that differ in one code point, found by pivotal grams.

Every word has its bigrams in the order of how rare they are among all words (ties by the bigram, then by place). The
first three are its gram prefix; dynamic programming picks from them two bigrams that do not overlap and are rarest
together: its pivots. One edit touches at most one of two disjoint bigrams, so of two near words the one whose prefix ends
earlier in the order of bigrams keeps a pivot that stands in the other's prefix. (A bigram that the edit may repeat is
indexed at up to five of its places, which is as far as a pivot of a near word can be.)

Pivots meet prefixes at their place: the edit lies behind a kept bigram or before it, so the part from the word's start to
the bigram, or from the bigram to the word's end, is the same in both and is hashed into the key. That is the position
limit in its sharpest form, and lengths may differ by one. What meets is verified on whole words, in the task, over all
pivots and prefixes of a key at once; a pair that several pivots find leaves the task of the first one only.

Keys whose pivots and prefixes would make more than ``most_pairs`` comparisons, or that hold more than ``most_rows`` rows,
are counted before anything is dealt out and refined: the zone where the edit may lie is halved, each half keeping the
other one in the key, until the keys are small or the zone is one code point. So no key of any size lands in one task and
no link is lost. Words travel as Latin-1 bytes, one per code point.

Defined results: null and empty texts have no words; runs in rows without ``doc_id`` are never altered; repeated rows
count again; of several near words of the same count the smallest in code-point order is the form; an empty table has no
words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.arrays import mix, signed, utf8
from symlake.llm.session import Scratch, prepare

U = np.uint64
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
#: Pairs that are verified at once, and rows that are gathered for it.
PAIRS, ROWS = 1_000_000, 200_000
#: Places of one bigram that are indexed.
PLACES = 5
BASE = U(0x9E3779B97F4A7C15)
ROW = ("key bigint, pivot boolean, word binary, n bigint, last int, first_pivot int, second_pivot int, way tinyint, head int, tail int, "
       "pivot_length int, prefix_length int, low int, high int, open boolean")
END = 1 << 30


def words(docs: DataFrame, shortest: int = 7, least: int = 2, alter: int | None = None) -> DataFrame:
    """``word`` (Latin-1) and ``n``: runs of letters with A-Z lower-cased, of ``shortest`` code points and ``least``
    occurrences in all documents. Where ``alter`` divides the crc32 of ``<doc_id>:<run>``, the run loses the code point
    at crc32 modulo its length."""
    prepare(docs)
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.encode("latin-1") for w in total], pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if not text:
                    continue
                own = Counter(runs.findall(text.encode().lower().decode()))
                if alter is None or name is None:
                    total.update(own)
                else:
                    start = zlib.crc32(f"{name}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % alter == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield hand_on()
        yield hand_on()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def gram_counts(found: DataFrame) -> np.ndarray:
    """How many words each bigram has, by ``256 * first + second``: as many rows as bigrams reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, cut = utf8(batch["word"])
            grams = data[:-1].astype(np.int64) << 8 | data[1:]
            grams = np.delete(grams, cut[1:-1] - 1) if len(cut) > 2 else grams
            total += np.bincount(grams, minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["gram", "n"])

    got = found.select("word").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def pivots(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Two disjoint of the prefix bigrams (``places`` ascending in each row) of smallest weight together: the best pair
    that ends at each place follows from the best single one that ends two code points before it or earlier."""
    n = places.shape[1]
    never = np.iinfo(np.int64).max // 4
    best, before = np.full(places.shape, never), np.zeros(places.shape, np.int64)
    for j in range(n):
        for i in range(j):
            sums = np.where(places[:, j] - places[:, i] >= 2, weights[:, i] + weights[:, j], never)
            better = sums < best[:, j]
            best[better, j], before[better, j] = sums[better], i
    last = best.argmin(axis=1)
    at = np.arange(len(places))
    return np.stack([places[at, before[at, last]], places[at, last]], axis=1)


def _entries(codes: np.ndarray, rank: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Index entries of words of one length (rows of ``codes``): for each, which words, and the columns of the key row."""
    m, length = codes.shape
    grams = codes[:, :-1].astype(np.int64) << 8 | codes[:, 1:]
    ranks = rank[grams].astype(np.int64)
    order = np.argsort(ranks * length + np.arange(length - 1), axis=1, kind="stable")
    rows = np.arange(m)
    ordered = np.take_along_axis(ranks, order[:, :3 + PLACES], axis=1)
    last = ordered[:, 2]
    places = np.sort(order[:, :3], axis=1)
    chosen = pivots(places, counts[np.take_along_axis(grams, places, axis=1)])
    powers = np.ones(length, U)
    powers[1:] = np.cumprod(np.full(length - 1, BASE, U), dtype=U)
    values = codes.astype(U) + U(1)
    heads = np.cumsum(values * powers, axis=1, dtype=U)
    tails = np.cumsum(values[:, ::-1] * powers, axis=1, dtype=U)

    def key(own: np.ndarray, at: np.ndarray, head: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = at + 2 if head else length - at
        hashed = (heads if head else tails)[own, kept - 1]
        none = np.zeros(len(own), np.int32)
        hashed = mix(hashed ^ mix(kept.astype(U) * U(2) + U(head)))
        return hashed, (kept if head else none), (none if head else kept)

    for way in range(4):
        at = chosen[:, way // 2]
        yield rows, True, way, last, chosen, key(rows, at, way % 2 == 0)
    lower = (ordered[:, :3] < last[:, None]).sum(axis=1)
    for c in range(order[:, :2 + PLACES].shape[1]):
        own = rows if c < 3 else np.flatnonzero((ordered[:, c] == last) & (c - lower < PLACES))
        if len(own):
            for head in (True, False):
                yield own, False, 0, last[own], chosen[own], key(own, order[own, c], head)


def key_rows(found: DataFrame, counts: np.ndarray) -> DataFrame:
    """Rows of ``ROW``: four for the pivots of a word and two for each bigram of its prefix."""
    seen = np.flatnonzero(counts)
    rank = np.zeros(1 << 16, np.int32)
    rank[seen[np.lexsort((seen, counts[seen]))]] = np.arange(len(seen))
    schema = ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, cut = utf8(batch["word"])
            lengths = np.diff(cut)
            for length in np.unique(lengths).tolist():
                all_own = np.flatnonzero(lengths == length)
                step = max(1, (1 << 20) // length)
                for lo in range(0, len(all_own), step):
                    own = all_own[lo:lo + step]
                    codes = data[cut[own][:, None] + np.arange(length)]
                    for rows, pivot, way, last, chosen, (keys, head, tail) in _entries(codes, rank, counts):
                        n = len(rows)
                        taken = pa.array(own[rows])
                        whole = lambda x, kind=pa.int32(): pa.array(np.broadcast_to(x, n), kind)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(signed(keys)), whole(pivot, pa.bool_()), batch["word"].take(taken), batch["n"].take(taken), whole(last), whole(chosen[:, 0]),
                             whole(chosen[:, 1]), whole(way, pa.int8()), whole(head), whole(tail), whole(0), whole(0), whole(0), whole(END), whole(True, pa.bool_())],
                            names=[c.split()[0] for c in schema.split(", ")])

    return found.mapInArrow(run, ROW)


def refine(rows: DataFrame, shortest: int) -> DataFrame:
    """Both lengths into the key, and one row for each half of the zone where the edit may lie: behind the middle, with
    everything before it kept, or before it, with everything behind it kept. Which half holds a pair's edit follows from
    how many code points its words share at the start."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                word, own = row["word"], len(row["word"])
                if row["pivot_length"]:
                    lengths = [(row["pivot_length"], row["prefix_length"])]
                else:
                    lengths = [(own, x) if row["pivot"] else (x, own) for x in (own - 1, own, own + 1) if x >= shortest]
                for one, other in lengths:
                    zone = one - row["head"] - row["tail"]
                    if zone < 0 or other - row["head"] - row["tail"] < 0:
                        continue
                    middle = row["head"] + zone // 2
                    halves = [(middle, row["tail"], middle, row["high"]), (row["head"], one - middle, row["low"], middle)] if zone > 1 else [
                        (row["head"], row["tail"], row["low"], row["high"])]
                    for half, (head, tail, low, high) in enumerate(halves):
                        if head + tail > own:
                            continue
                        left = one - head - tail
                        key = xxhash.xxh64_intdigest(b"%d %d %d %d " % (row["key"], one, other, half) + word[:head] + b" " + word[own - tail:])
                        out.append({**row, "key": key - (1 << 64) if key >> 63 else key, "head": head, "tail": tail, "pivot_length": one,
                                    "prefix_length": other, "low": low, "high": high, "open": zone > 1 and left > 1})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.select(names).mapInArrow(run, ROW)


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many code points from ``a`` and ``b`` on (backwards for ``step`` -1) are equal, up to ``limit``."""
    out = np.zeros(len(a), np.int64)
    todo = np.flatnonzero(limit > 0)
    k = 0
    while len(todo):
        todo = todo[data[a[todo] + step * k] == data[b[todo] + step * k]]
        k += 1
        out[todo] = k
        todo = todo[limit[todo] > k]
    return out


def verify(rows: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: near words, each pair once."""
    columns = ["key", "pivot", "word", "n", "last", "first_pivot", "second_pivot", "way", "head", "tail", "low", "high"]

    def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, pivot, last, n, way, head, tail, low, high, p1, p2 = (table[c].to_numpy() for c in (
            "key", "pivot", "last", "n", "way", "head", "tail", "low", "high", "first_pivot", "second_pivot"))
        data, cut = utf8(table["word"])
        start, length = cut[:-1], np.diff(cut)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
        left, right = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        right = right[np.lexsort((length[right], group[right]))]
        places = group[right] << 32 | length[right]
        first = np.searchsorted(places, group[left] << 32 | length[left] - 1)
        count = np.searchsorted(places, group[left] << 32 | length[left] + 1, side="right") - first
        ends = np.cumsum(count)
        i = 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
            for lo in range(0, int(count[i]) if j == i + 1 else 1, PAIRS):  # one pivot row may meet very many
                sizes = count[i:j] if j > i + 1 else np.minimum(count[i:j] - lo, PAIRS)
                s = np.repeat(left[i:j], sizes)
                offset = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                r = right[np.repeat(first[i:j] + lo, sizes) + offset]
                ok = (last[s] <= last[r]) & (head[s] == head[r]) & (tail[s] == tail[r])
                s, r = s[ok], r[ok]
                shorter, longer = np.minimum(length[s], length[r]), np.maximum(length[s], length[r])
                same = _common(data, start[s], start[r], shorter, 1)
                # One edit behind the common start: the rest must be common to the end.
                ok = (same < longer) & (same >= low[s]) & (same < high[s])
                s, r, same, shorter, longer = s[ok], r[ok], same[ok], shorter[ok], longer[ok]
                same_end = _common(data, cut[s + 1] - 1, cut[r + 1] - 1, shorter, -1)
                ok = same + np.minimum(same_end, shorter - same) >= longer - 1
                s, r, same, same_end, shorter = s[ok], r[ok], same[ok], same_end[ok], shorter[ok]
                # Which pivot finds the pair first, and with equal prefixes, which word comes first.
                ways = np.stack([same >= p1[s] + 2, same_end >= length[s] - p1[s], same >= p2[s] + 2, same_end >= length[s] - p2[s]])
                at = np.minimum(same, shorter - 1)
                smaller = np.where(same < shorter, data[start[s] + at] < data[start[r] + at], length[s] < length[r])
                ok = (ways.argmax(axis=0) == way[s]) & ways.any(axis=0) & ((last[s] < last[r]) | smaller)
                s, r = pa.array(s[ok]), pa.array(r[ok])
                if len(s):
                    w, c = table["word"].combine_chunks(), pa.array(n)
                    yield pa.RecordBatch.from_arrays([w.take(s), c.take(s), w.take(r), c.take(r)], names=["a", "a_n", "b", "b_n"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                keys = batch["key"].to_numpy()
                same = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if same:
                    whole = pa.Table.from_batches([*held[:-1], batch.slice(0, same)])
                    held, size = [batch.slice(same)], batch.num_rows - same
                    yield from near(whole.combine_chunks())
        if held:
            yield from near(pa.Table.from_batches(held).combine_chunks())

    return rows.select(columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, a_n bigint, b binary, b_n bigint")


def near_words(found: DataFrame, scratch: Scratch, shortest: int = 7, most_pairs: int = 4_000_000, most_rows: int = 100_000) -> DataFrame:
    """All pairs of ``found(word, n)`` that differ by one inserted, deleted or replaced code point."""
    prepare(found)
    rows = key_rows(found, gram_counts(found))
    cold, k = [], 0
    while True:
        is_pivot = F.col("pivot").cast("bigint")
        crowded, n = scratch.save(
            rows.filter("open").groupBy("key").agg(F.sum(is_pivot).alias("p"), F.sum(1 - is_pivot).alias("q"))
            .filter((F.col("p") * F.col("q") > most_pairs) | (F.col("p") + F.col("q") > most_rows)).select("key", F.lit(True).alias("crowded")), f"crowded-{k}")
        if not n:
            cold.append(rows)
            break
        marked = rows.join(crowded, "key", "left")
        cold.append(marked.filter("crowded IS NULL OR NOT open").select(rows.columns))
        rows, _ = scratch.save(refine(marked.filter("crowded AND open").select(rows.columns), shortest), f"refined-{k}")
        k += 1
    whole = cold[0]
    for more in cold[1:]:
        whole = whole.unionAll(more)
    return verify(whole)


def variants(found: DataFrame, ratio: int = 10, **limits) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` for every row of ``found(word, n)``: ``form`` is the near word of largest
    ``n`` (ties: the smallest), if that is ``ratio`` times the word's at least; ``root`` is the last form that following
    forms from the word leads to, the word itself if it has none."""
    spark = prepare(found)
    scratch = Scratch(spark, "spelling")
    found, _ = scratch.save(found, "words")
    pairs = near_words(found, scratch, **limits)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("near")),
                             F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word")).alias("near"))))
    near = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    is_form = -F.col("best.n") >= F.col("n") * ratio
    rows, _ = scratch.save(found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"),
        F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    # Counts grow along the forms, so chains end; each round doubles how far a word looks.
    steps, n = scratch.save(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while n:
        k += 1
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        whole, _ = scratch.save(moved, f"roots-{k}")
        steps, n = whole.select("word", "root"), whole.filter("moved").limit(1).count()
    text = lambda c: F.decode(c, "ISO-8859-1")
    return rows.join(steps, "word", "left").select(
        text(F.col("word")).alias("word"), text(F.col("form")).alias("form"), text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
