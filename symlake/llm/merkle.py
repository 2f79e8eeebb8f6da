"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

A paragraph is a line; it is cut into pieces of ``PIECE`` bytes from its own start, so an edit inside one paragraph
moves no other. A section ends after a blank paragraph, or after a paragraph whose hash says so (one in eight), so
inserted or removed paragraphs change the sections around them only. Every node is the hash of its children in order.

A fingerprint is text: ``root:section;section`` with each section ``hash=paragraph,paragraph`` and each paragraph the
first 32 bits of its pieces in hex. Roots (128 bits) test equality; where they differ, equal sections and then equal
paragraphs are skipped, which leaves the edited places (``differences``). ``likeness`` is the share of pieces that two
fingerprints have in common.

Defined results: null counts as empty text, which has a root and one empty paragraph; two empty texts are alike (1), an
empty and another text are not (0); repeated rows get equal fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.arrays import Roller, slices, utf8
from symlake.llm.session import prepare

U = np.uint64
PIECE = 32
_PIECES, _PARAGRAPHS, _SECTIONS, _ROOTS, _ROOTS_2 = (Roller(70 + k) for k in range(5))


class Trees:
    """The trees of some texts, all levels as arrays; ``*_of`` are offsets of one level in the next lower one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
        order = np.argsort(owner * (len(data) + 2) + starts, kind="stable")
        starts, owner = starts[order], owner[order]
        last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
        ends = np.where(last, offsets[1:][owner], np.append(starts[1:], 0) - 1)
        sizes = ends - starts
        count = -(-sizes // PIECE)
        self.paragraph_of = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(starts - self.paragraph_of[:-1] * PIECE, count) + np.arange(self.paragraph_of[-1]) * PIECE
        self.pieces = _PIECES.words(data, at, np.minimum(at + PIECE, np.repeat(ends, count)))
        self.paragraphs = _PARAGRAPHS.spans(self.pieces, self.paragraph_of[:-1], self.paragraph_of[1:])
        closes = last | (sizes == 0) | (self.paragraphs % U(8) == 0)
        self.section_of = np.concatenate([[0], np.flatnonzero(closes) + 1])
        self.sections = _SECTIONS.spans(self.paragraphs, self.section_of[:-1], self.section_of[1:])
        self.text_of = np.concatenate([[0], np.cumsum(np.bincount(owner[closes], minlength=n))]).astype(np.int64)
        roots = [r.spans(self.sections, self.text_of[:-1], self.text_of[1:]) for r in (_ROOTS, _ROOTS_2)]
        self.roots = np.stack(roots, axis=1)

    def strings(self) -> list[str]:
        short = (self.pieces >> U(32)).astype(">u4").tobytes().hex()
        cut = (self.paragraph_of * 8).tolist()
        paragraphs = [short[a:b] for a, b in zip(cut[:-1], cut[1:])]
        heads = (self.sections >> U(32)).astype(">u4").tobytes().hex()
        of = self.section_of.tolist()
        sections = [f"{heads[8 * k:8 * k + 8]}={','.join(paragraphs[of[k]:of[k + 1]])}" for k in range(len(of) - 1)]
        roots = self.roots.astype(">u8").tobytes().hex()
        of = self.text_of.tolist()
        return [f"{roots[32 * k:32 * k + 32]}:{';'.join(sections[of[k]:of[k + 1]])}" for k in range(len(of) - 1)]

    def likeness(self, other: Trees) -> np.ndarray:
        """Row by row: pieces in common, twice, by all pieces of both."""
        sides = []
        for t in (self, other):
            counts = np.diff(t.paragraph_of[t.section_of[t.text_of]])
            key = np.repeat(np.arange(len(counts)), counts).astype(np.uint64) << U(32) | t.pieces >> U(32)
            sides.append((counts, *np.unique(key, return_counts=True)))
        (n, keys, times), (m, other_keys, other_times) = sides
        both, i, j = np.intersect1d(keys, other_keys, assume_unique=True, return_indices=True)
        common = np.bincount((both >> U(32)).astype(np.int64), np.minimum(times[i], other_times[j]), len(n))
        out = 2 * common / np.maximum(n + m, 1)
        return np.where((self.roots == other.roots).all(axis=1), 1.0, out)


def likeness(a: str, b: str) -> float:
    """The same from two fingerprints alone."""
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    x, y = (Counter(p[k:k + 8] for s in f.split(":")[1].split(";") for p in s.split("=")[1].split(",") for k in range(0, len(p), 8)) for f in (a, b))
    return 2 * sum((x & y).values()) / max(sum(x.values()) + sum(y.values()), 1)


def differences(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of ``a`` that have no equal in ``b``, found from the root down."""
    if a.split(":")[0] == b.split(":")[0]:
        return []
    sections = [[s.split("=") for s in f.split(":")[1].split(";")] for f in (a, b)]
    equal = Counter(s[0] for s in sections[0]) & Counter(s[0] for s in sections[1])
    left = [[], []]
    for side, rows in enumerate(sections):
        skip, number = Counter(equal), 0
        for head, paragraphs in rows:
            inner = paragraphs.split(",")
            if skip[head]:
                skip[head] -= 1
            else:
                left[side] += [(number + k, p) for k, p in enumerate(inner)]
            number += len(inner)
    there = Counter(p for _, p in left[1])
    out = []
    for number, p in left[0]:
        if there[p]:
            there[p] -= 1
        else:
            out.append(number)
    return out


def fingerprint(docs: DataFrame, columns: dict[str, str], compare: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` without the text columns named in ``columns`` and their companions, with a fingerprint for each.

    ``columns``: text column to the name of its fingerprint; ``compare``: name of a likeness to two text columns, which
    may be outside ``columns``. All other columns stay."""
    prepare(docs)
    compare = compare or {}
    texts = list(dict.fromkeys([*columns, *(c for pair in compare.values() for c in pair)]))
    rest = [f for f in docs.schema if f.name not in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = {c: utf8(batch[c]) for c in texts}
            total = sum(off for _, off in views.values())
            for i, j in slices(np.asarray(total)):
                trees = {c: Trees(data[off[i]:off[j]], off[i:j + 1] - off[i]) for c, (data, off) in views.items()}
                arrays = [batch[f.name].slice(i, j - i) for f in rest]
                arrays += [pa.array(trees[c].strings(), pa.string()) for c in columns]
                arrays += [pa.array(trees[a].likeness(trees[b])) for a, b in compare.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in rest), *columns.values(), *compare])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"`{c}` string" for c in columns.values()),
             *(f"`{c}` double" for c in compare)]
    return docs.mapInArrow(run, ", ".join(kinds))


def with_next(docs: DataFrame, rows_per_range: int = 400) -> DataFrame:
    """``doc_id, text, next_text``: the text of the document that follows in descending ``doc_id`` (after the last: the
    first). Null texts come as empty ones; equal ids follow each other in the order of a hash of their texts; null ids
    come last.

    Documents are dealt to ranges of ids (bounds from quantiles); the first document of each range goes to the range
    before as well, so every neighbour is found inside a range and no window spans the table."""
    low = -(1 << 63)
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).cast("bigint").alias("order"))
    n = docs.count()
    pieces = max(1, min(n // rows_per_range, 20_000))
    bounds = np.unique(clean.approxQuantile("order", [k / pieces for k in range(1, pieces)], 0.1 / pieces)).astype(np.int64) if pieces > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("bigint")
    def range_of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order.to_numpy(np.int64)))

    heads = {r["range"]: r["head"] for r in clean.select(range_of("order").alias("range"), "order").groupBy("range").agg(F.max("order").alias("head")).collect()}
    there = sorted(heads)
    # The first of each range is the next of the last one of the range above; the top one follows the lowest of all.
    above = {heads[r]: there[(k + 1) % len(there)] for k, r in enumerate(there)}

    @F.pandas_udf("array<bigint>")
    def ranges_of(order: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, order.to_numpy(np.int64)).tolist()
        return pd.Series([[r] if (up := above.get(o)) is None else [r, up] for r, o in zip(own, order.tolist())])

    dealt = clean.select("doc_id", "text", "order", F.posexplode(ranges_of("order")).alias("copy", "range"))
    follow = Window.partitionBy("range").orderBy("copy", F.desc("order"), F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(follow)).filter("copy = 0").select("doc_id", "text", "next_text")


def edited(text: str = "text", following: str = "next_text", part: int = 3) -> F.Column:
    """The text with its last ``1 / part`` (code points, rounded down) replaced by as many first ones of ``following``."""
    k = F.floor(F.char_length(text) / part).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - k), F.substring(F.col(following), F.lit(1), k))
