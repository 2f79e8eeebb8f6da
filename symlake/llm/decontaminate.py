"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word ids of all items. Documents are streamed through it word by word; the state keeps the
longest suffix of what was read that occurs in some item. A document word is hit where that length reaches the window
(``window`` words, or the whole item for a shorter one). Runs of words that occur in no item, and runs too short for the
smallest window, leave the automaton in its start state and are skipped as a whole.

Items go into automata of at most ``max_words`` words, so the size of what is broadcast is bounded by a parameter,
whatever the number of items; more items mean more passes, each written to the shared folder.

Defined results: null or empty text has no words and no hits; items without words are ignored; repeated rows are judged
each on their own; an item id that occurs twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlake.llm.arrays import ALNUM, LOWER, pieces, releasing, slices, utf8, word_spans
from symlake.llm.session import Scratch, prepare

#: Separators become spaces, A-Z small letters; all else stays.
_FOLD = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
HITS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Substrings of several word sequences, with the items each relevant state occurs in."""

    def __init__(self, items: dict, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Items whose windows end in a state: of whole windows, and of items shorter than that (by length).
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        #: Items of words that follow each other: ``item -> word ids``.
        sequences = {item: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for item, words in items.items() if words}
        for ids in sequences.values():
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.smallest = min((min(len(s), window) for s in sequences.values()), default=0)
        for item, ids in sequences.items():
            for state, _ in self._windows(ids):
                if len(ids) >= window:
                    self.items.setdefault(state, set()).add(item)
                else:
                    self.short.setdefault(state, []).append((len(ids), item))
        #: The next state up the suffix links that completes a short item.
        self.short_up = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.short_up[s] = up if up in self.short else self.short_up[up]

    def _clone(self, p: int, q: int, c: int) -> int:
        """State for the part of ``q`` that also ends after ``p`` and ``c``."""
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            # Another item went this way before.
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, c)
        cur = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def cut(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _windows(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        state = length = 0
        n = min(self.window, len(ids))
        for i, c in enumerate(ids):
            state, length = self.step(state, length, c)
            if i + 1 >= n:
                yield self.cut(state, n), i

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (end exclusive, in order, apart) and the items with a window in the sequence; -1 stands for
        a word of no item."""
        hits: list[list[int]] = []
        items: set = set()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        runs = edge.reshape(-1, 2)
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.smallest].tolist():
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.step(state, length, c)
                first = i + 1
                if length >= self.window:
                    first = i + 1 - length
                    at = self.cut(state, self.window)
                    items |= self.items.get(at, _NONE)
                if self.short:
                    at = state if state in self.short else self.short_up[state]
                    while at:
                        for n, item in self.short[at]:
                            if n <= length:
                                items.add(item)
                                first = min(first, i + 1 - n)
                        at = self.short_up[at]
                if first <= i:
                    if hits and hits[-1][1] >= first:
                        while len(hits) > 1 and hits[-2][1] >= first:
                            hits.pop()
                        hits[-1] = [min(first, hits[-1][0]), i + 1]
                    else:
                        hits.append([first, i + 1])
        return [tuple(h) for h in hits], items


_NONE: frozenset = frozenset()


def automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most ``max_words`` words (one item may be longer), read item by item."""
    items: dict = {}
    held = 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        words = words_of(row["text"].encode())
        if items and (held + len(words) > max_words or row["item_id"] in items):
            yield SuffixAutomaton(items, window)
            items, held = {}, 0
        items[row["item_id"]] = words
        held += len(words)
    yield SuffixAutomaton(items, window)


def _word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 2_000_000) -> DataFrame:
    """``doc_id, text, n_words, hits, items`` for every row: the hit word ranges and the ids of the items found."""
    spark = prepare(docs)
    item_type = benchmark.schema["item_id"].dataType
    found = docs.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(HITS).alias("hits"),
                        F.array().cast(T.ArrayType(item_type)).alias("items"))
    scratch = None
    for k, automaton in enumerate(automata(benchmark, window, max_words)):
        if k:
            scratch = scratch or Scratch(spark, "decontamination")
            found, _ = scratch.save(found, f"pass-{k}")
        found = _one_pass(found, spark.sparkContext.broadcast(automaton))
    return found


def _one_pass(found: DataFrame, shared) -> DataFrame:
    """Add the hits of one automaton."""
    schema = found.schema
    kinds = {n: _arrow(schema, n) for n in ("hits", "items")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            data, offsets = utf8(batch["text"])
            raw = data.tobytes()
            before = [batch[c].to_pylist() for c in ("hits", "items")]
            counts, hits, items = [], [], []
            for k in range(batch.num_rows):
                ids = _word_ids(raw[offsets[k]:offsets[k + 1]], automaton.vocabulary)
                got, names = automaton.scan(ids)
                counts.append(len(ids))
                hits.append([{"first": a, "end": b} for a, b in merged(got, [(h["first"], h["end"]) for h in before[0][k]])])
                items.append(sorted(names.union(before[1][k]), key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], pa.array(counts, pa.int64()), pa.array(hits, kinds["hits"]), pa.array(items, kinds["items"])],
                names=["doc_id", "text", "n_words", "hits", "items"])

    return found.mapInArrow(run, schema)


def _arrow(schema: T.StructType, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema[name].dataType)


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of ranges, as ranges that do not touch."""
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5,
                max_words: int = 2_000_000) -> DataFrame:
    """``docs`` without benchmark passages; all columns stay, ``n_chars`` (if there) follows the new text.

    Each hit range goes from the start of its first word to the start of the next word that stays. A row of which more
    than ``max_coverage`` of the words are hit, by the items of all automata together, goes as a whole. Rows without a
    hit stay as they are, null texts too. What remains is read again until nothing is hit, as a cut may join words to a
    new window. With several automata each round marks the hits of all of them before it cuts; only rows that were cut
    go to the next round."""
    spark = prepare(docs)
    shared = [spark.sparkContext.broadcast(a) for a in automata(benchmark, window, max_words)]
    if len(shared) == 1:
        return docs.mapInArrow(_rewrite(lambda text, _: without_hits(text, shared[0].value, max_coverage)), docs.schema)
    scratch = Scratch(spark, "decontaminated")
    left, done, first = docs, [], True
    while True:
        marked = left.withColumn(_MARK, F.array().cast(HITS))
        for k, automaton in enumerate(shared):
            marked, _ = scratch.save(_marked(marked, automaton), f"round-{len(done)}-{k}")
        done.append(marked.filter(F.size(_MARK) == 0).drop(_MARK))
        limit = max_coverage if first else None
        cut = marked.filter(F.size(_MARK) > 0).mapInArrow(_rewrite(lambda text, hits, limit=limit: _cut(text, hits, limit)), marked.schema)
        left, n = scratch.save(cut.drop(_MARK), f"round-{len(done)}")
        first = False
        if not n:
            return reduce(DataFrame.union, done)


#: Column of the hits of all automata, for as long as a round lasts.
_MARK = "__benchmark_hits__"


def _marked(docs: DataFrame, shared) -> DataFrame:
    """Add the hits of one automaton to the marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            data, offsets = utf8(batch["text"])
            raw = data.tobytes()
            at = batch.schema.names.index(_MARK)
            hits = []
            for i, before in enumerate(batch[_MARK].to_pylist()):
                got, _ = automaton.scan(_word_ids(raw[offsets[i]:offsets[i + 1]], automaton.vocabulary))
                hits.append([{"first": a, "end": b} for a, b in merged(got, [(h["first"], h["end"]) for h in before])])
            yield batch.set_column(at, batch.schema.field(at), pa.array(hits, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _rewrite(change: Callable[[bytes, list], bytes | None]) -> Callable:
    """Put ``change(text, marks)`` into the place of each text; rows for which it is ``None`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(pieces, batches)):
            data, offsets = utf8(batch["text"])
            raw = data.tobytes()
            marks = batch[_MARK].to_pylist() if _MARK in batch.schema.names else [()] * batch.num_rows
            changed: dict[int, str | None] = {}
            for i in range(batch.num_rows):
                text = raw[offsets[i]:offsets[i + 1]]
                clean = change(text, marks[i])
                if clean is not text:
                    changed[i] = None if clean is None else clean.decode()
            yield _replace(batch, changed) if changed else batch

    return releasing(run)


def _cut(text: bytes, marks: list[dict], max_coverage: float | None) -> bytes | None:
    """The text without the marked words, or ``None`` if they are more than ``max_coverage`` of all."""
    hits = [(h["first"], h["end"]) for h in marks]
    if max_coverage is not None and sum(b - a for a, b in hits) > max_coverage * len(words_of(text)):
        return None
    return _without(text, hits)


def without_hits(text: bytes, automaton: SuffixAutomaton, max_coverage: float) -> bytes | None:
    """The same object if nothing is hit, a shorter text, or ``None`` if the coverage is too high."""
    first = True
    while True:
        ids = _word_ids(text, automaton.vocabulary)
        hits, _ = automaton.scan(ids)
        if not hits:
            return text
        if first and sum(b - a for a, b in hits) > max_coverage * len(ids):
            return None
        first = False
        text = _without(text, hits)


def _without(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    data = np.frombuffer(text, np.uint8)
    starts, _, _ = word_spans(data, np.array([0, len(text)]), ALNUM)
    parts, at = [], 0
    for a, b in hits:
        parts.append(text[at:starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*parts, text[at:]])


def _replace(batch: pa.RecordBatch, changed: dict[int, str | None]) -> pa.RecordBatch:
    names = batch.schema.names
    columns = list(batch.columns)
    texts = columns[names.index("text")].to_pylist()
    for i, new in changed.items():
        texts[i] = new
    columns[names.index("text")] = pa.array(texts, columns[names.index("text")].type)
    if "n_chars" in names:
        old = columns[names.index("n_chars")]
        sizes = old.to_pylist()
        for i, new in changed.items():
            sizes[i] = None if new is None else len(new)
        columns[names.index("n_chars")] = pa.array(sizes, old.type)
    keep = np.ones(batch.num_rows, dtype=bool)
    keep[[i for i, new in changed.items() if new is None]] = False
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
