"""Byte-level BPE: pre-tokenisation as a scan of transition functions, merges cached and done for many pieces at once.

Pre-tokenisation reads arrays of codepoint classes. A class already carries what the pattern looks ahead for (is this
the last white space before something else, does a contraction start here), so each codepoint is a function from the
state before it to the state after it. These functions form a finite monoid; its composition table is built here once.
Composition is associative: blocks are scanned side by side, block totals are scanned, and both are put together. The
states give the token starts, without a regex.

Pieces that are not in the cache are merged together, all pieces of a slice per round: each round merges the pairs of
lowest rank in every piece.

Defined results: null text counts as empty, empty text has no tokens; repeated rows are encoded each on their own.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.llm.arrays import release, slices, utf8
from symlake.llm.session import prepare

SLICE_BYTES = 1 << 20
#: Longer pieces are merged alone with a heap, so that one of them does not keep all others waiting. Same result.
LONG_PIECE = 64

# Classes of codepoints: what they are.
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# Symbols of the scan: classes with what follows folded in.
(S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_LEAD, S_LONE, S_SHORT, S_LONG, S_END) = range(9)
# States after a codepoint. LEAD: a space that belongs to what follows. OWED_n: n more letters of a contraction.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, LEAD, OWED_1, OWED_2) = range(8)
N_STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state and whether a token starts at this codepoint."""
    if symbol == S_END:
        return START, True
    if symbol == S_LETTER:
        if state == OWED_2:
            return OWED_1, False
        if state == OWED_1:
            return START, False
        return IN_LETTERS, state not in (IN_LETTERS, LEAD)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, LEAD)
    if symbol in (S_SHORT, S_LONG) and state not in (IN_OTHER, LEAD):
        return (OWED_1 if symbol == S_SHORT else OWED_2), True
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        return IN_OTHER, state not in (IN_OTHER, LEAD)
    if symbol == S_RUN:
        return IN_SPACE, state != IN_SPACE
    # The last white space before something else stands alone, or leads it if it is a space.
    return (LEAD if symbol == S_LEAD else START), True


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, composition table (left first), results by function and state, starts by state and symbol."""
    symbols = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(9)]
    known = {tuple(range(N_STATES)): 0}
    queue = list(known)
    for f in queue:
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    functions = list(known)
    assert len(functions) < 256
    compose = np.zeros((len(functions), len(functions)), dtype=np.uint8)
    for (i, f), (j, g) in product(enumerate(functions), repeat=2):
        compose[i, j] = known[tuple(g[x] for x in f)]
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(N_STATES)])
    return np.array([known[f] for f in symbols], np.uint8), compose, np.array(functions, np.uint8), starts


#: White space as the pattern's \\s has it (fixed values: the Unicode property White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of every codepoint."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def prefix_functions(functions: np.ndarray, block: int = 512) -> np.ndarray:
    """For each place the composition of all functions before it, by blocks side by side."""
    _, compose, _, _ = monoid()
    n = len(functions)
    if n <= block:
        out = np.empty(n, np.uint8)
        now = 0
        for i, f in enumerate(functions.tolist()):
            out[i] = now
            now = compose[now, f]
        return out
    count = -(-n // block)
    grid = np.zeros(count * block, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(count, block).T)
    flat, size = compose.ravel(), len(compose)
    before = np.empty_like(grid)
    now = np.zeros(count, np.intp)
    for i in range(block):
        before[i] = now
        now = flat[now * size + grid[i]].astype(np.intp)
    heads = prefix_functions(now.astype(np.uint8), block).astype(np.intp)
    return flat[heads[None, :] * size + before].T.ravel()[:n]


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which codepoints start a token. ``ends``: last codepoint of each text (a separator that belongs to no token)."""
    kind = classes()[points]
    n = len(points)
    blank = kind >= BLANK
    last = np.zeros(n, bool)
    last[ends] = True
    follows = np.zeros(n, bool)  # something other than white space comes next, in the same text
    follows[:-1] = ~blank[1:] & ~last[1:]
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_RUN], np.uint8)[kind]
    symbol[blank & follows] = S_LONE
    symbol[(kind == SPACE) & follows] = S_LEAD
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[quote[pair]] = S_LONG
    symbol[ends] = S_END
    by_symbol, _, results, starts = monoid()
    before = prefix_functions(by_symbol[symbol])
    return starts[results[before, START], symbol]


_NONE = np.iinfo(np.int64).max


def _place(key: np.ndarray, size: int) -> np.ndarray:
    """First place of a pair in a table of ``size`` (a power of two)."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


@dataclass
class Vocabulary:
    """Ranks of byte strings; ``tokens[id]`` are the bytes of an id."""

    ranks: dict[bytes, int]
    remembered: int = 200_000
    _cache: dict[bytes, bytes] = field(default_factory=dict, repr=False)
    _base: dict[bytes, bytes] | None = field(default=None, repr=False)
    _pairs: tuple | None = field(default=None, repr=False)
    _bytes: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}, "_base": None, "_pairs": None, "_bytes": None}

    def forget(self) -> None:
        """Give back the memory of what was remembered."""
        self._cache, self._base = {}, None
        release()

    @property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ``left << 32 | right`` of ids whose joined bytes are a token and their ranks, as a table with open
        addressing; ids of bytes."""
        if self._pairs is None:
            pairs, joined = [], []
            get = self.ranks.get
            for token, rank in self.ranks.items():
                for cut in range(1, len(token)):
                    a, b = get(token[:cut]), get(token[cut:])
                    if a is not None and b is not None:
                        pairs.append(a << 32 | b)
                        joined.append(rank)
            size = 1 << max(4, (4 * len(pairs)).bit_length())
            keys, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
            for at, key, rank in zip(_place(np.array(pairs, np.int64), size).tolist(), pairs, joined):
                while keys[at] >= 0:
                    at = (at + 1) & (size - 1)
                keys[at], ranks[at] = key, rank
            single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
            self._pairs = keys, ranks, single
        return self._pairs

    def _byte_pairs(self) -> np.ndarray:
        """Rank of every pair of bytes, the largest number where it is none."""
        if self._bytes is None:
            _, _, single = self._pair_table()
            self._bytes = self._pair_ranks((single[:, None] << 32 | single).ravel()).reshape(256, 256)
        return self._bytes

    def _pair_ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of every pair, the largest number where it is none."""
        keys, ranks, _ = self._pair_table()
        out = np.full(len(key), _NONE)
        at = _place(key, len(keys))
        todo = np.arange(len(key))
        while len(todo):
            there = keys[at]
            hit = there == key[todo]
            out[todo[hit]] = ranks[at[hit]]
            go_on = (there >= 0) & ~hit
            todo, at = todo[go_on], (at[go_on] + 1) & (len(keys) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of every piece, all merged side by side.

        In each round the leftmost pair of lowest rank of each piece becomes one id, as if it were alone, until no pair
        of its ids is a token. A round makes a piece one id shorter, so pieces are taken by their number of ids, from the
        longest down: those of one number are the columns of one array, and shorter ones join when their turn comes."""
        _, _, single = self._pair_table()
        pairs = self._byte_pairs()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order = np.argsort(lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        groups = np.searchsorted(lengths[order], np.arange(longest + 2))
        bits = longest.bit_length()
        highest = max(self.ranks.values()) + 1
        kind = np.int32 if (highest + 1) << bits < 1 << 31 else np.int64
        none = highest << bits
        single, pairs = single.astype(kind), np.where(pairs == _NONE, none, pairs << bits).astype(kind)
        places = np.arange(longest, dtype=kind)[:, None]
        who, ids, rank = np.zeros(0, np.int64), np.zeros((longest + 1, 0), kind), np.zeros((longest, 0), kind)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self._pair_ranks(left.astype(np.int64) << 32 | right)
            return np.where(found == _NONE, none, found << bits)

        for n in range(longest, 0, -1):
            ids, rank = ids[:n], rank[:n - 1]
            fresh = order[groups[n]:groups[n + 1]]
            if len(fresh):
                raw = data[begins[fresh] + np.arange(n)[:, None]]
                who = np.concatenate([who, fresh])
                ids = np.concatenate([ids, single[raw]], axis=1)
                rank = np.concatenate([rank, pairs[raw[:-1], raw[1:]]], axis=1)
            if n == 1 or not len(who):
                done.append((who, ids))
                continue
            best = (rank + places[:n - 1]).min(axis=0)
            stay = best < none
            if not stay.all():
                done.append((who[~stay], ids[:, ~stay]))
                stay = np.flatnonzero(stay)
                who, ids, rank, best = who[stay], ids.take(stay, 1), rank.take(stay, 1), best[stay]
            at, column = best & ((1 << bits) - 1), np.arange(len(best))
            ids = np.where(places[:n - 1] <= at, ids[:-1], ids[1:])
            ids[at, column] = best >> bits
            rank = np.where(places[:n - 2] < at, rank[:-1], rank[1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            before, after = at[left] - 1, at[right]
            rank[before, left] = ranks(ids[before, left], ids[before + 1, left])
            rank[after, right] = ranks(ids[after, right], ids[after + 1, right])
        sizes = np.zeros(len(pieces), np.int64)
        for who, ids in done:
            sizes[who] = len(ids)
        stops = np.cumsum(sizes)
        flat = np.zeros(int(sizes.sum()), "<u4")
        for who, ids in done:
            flat[(stops - sizes)[who] + np.arange(len(ids))[:, None]] = ids
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(((stops - sizes) * 4).tolist(), (stops * 4).tolist())]

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece: lowest rank first, then leftmost, with a heap of pairs and links between neighbours."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (rank := get(piece[a:end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))

        for i in range(n):
            offer(i)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(self.ranks[piece[a:end[a]]])
            a = end[a]
        return np.array(out, "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of every row of UTF-8 bytes."""
        raw = data.tobytes()
        rows = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        joined = b"\n".join(rows) + b"\n"
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) == len(joined):
            at = np.arange(len(points), dtype=np.int32)
        else:
            width = (points >= 0x80).astype(np.int8)
            width += points >= 0x800
            width += points >= 0x10000
            width += 1
            at = np.cumsum(width, dtype=np.int64) - width
        ends_byte = offsets[1:] + np.arange(len(rows))
        ends = np.searchsorted(at, ends_byte)
        start = token_starts(points, ends)
        places = np.flatnonzero(start)
        # The pieces follow each other without gaps. Each different one is looked up once.
        bounds = np.append(at[places], len(joined)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        codes, (named, begin) = pieces.indices.to_numpy(), utf8(pieces.dictionary)
        named, begin = named.tobytes(), begin.tolist()
        different = [named[a:b] for a, b in zip(begin[:-1], begin[1:])]
        if not self._cache or len(self._cache) > self.remembered:
            # What was remembered is only a speed-up: it starts anew from the vocabulary.
            self._base = self._base or {t: int(r).to_bytes(4, "little") for t, r in self.ranks.items()}
            self._cache = self._base.copy()
        found = self._cache
        parts = list(map(found.get, different))
        missing = [k for k, part in enumerate(parts) if part is None]
        if missing:
            short = [p for k in missing if len(p := different[k]) <= LONG_PIECE]
            found.update(zip(short, self.merge(short)))
            found.update((p, self.merge_long(p)) for k in missing if len(p := different[k]) > LONG_PIECE)
            for k in missing:
                parts[k] = found[different[k]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        heads = np.cumsum(sizes) - sizes
        # The separator of each row is a piece of its own, the last one of the row; its ids are left out.
        cut = np.searchsorted(places, ends)
        counts = sizes[codes]
        counts[cut] = 0
        stops = np.cumsum(counts)
        source = np.repeat(heads[codes] - (stops - counts), counts)
        source += np.arange(len(source))
        ids = np.frombuffer(b"".join(parts), "<u4")[source].tobytes()
        out, a = [], 0
        for b in (stops[cut] * 4).tolist():
            out.append(ids[a:b])
            a = b
        return out


def count_tokens(ids: str) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("bigint")


def encode(docs: DataFrame, vocabulary: Vocabulary, with_offsets: bool = False, keep: tuple[str, ...] | list[str] = (),
           verify: bool = False) -> DataFrame:
    """``doc_id``, the columns to ``keep``, ``n_bytes, ids`` (binary: little-endian unsigned 32-bit numbers) and, if asked
    for, ``offsets`` (likewise: the byte of the text at which each token starts). ``n_bytes`` is the length of the text
    in UTF-8. ``verify`` decodes every row on the spot and fails if the text does not come back."""
    shared = prepare(docs).sparkContext.broadcast(vocabulary)
    kept = ["doc_id", *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        tokens = words.tokens if with_offsets or verify else []
        lengths = np.array([len(t) for t in tokens], np.int64)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in slices(offsets, SLICE_BYTES):
                lo = offsets[i]
                ids = words.encode(data[lo:offsets[j]], offsets[i:j + 1] - lo)
                if verify and decoded(b"".join(ids), tokens) != data[lo:offsets[j]].tobytes():
                    raise ValueError("tokens do not decode to the text")
                columns = [*(batch[c].slice(i, j - i) for c in kept), pa.array(np.diff(offsets[i:j + 1])), pa.array(ids, pa.binary())]
                if with_offsets:
                    columns.append(pa.array([token_offsets(x, lengths) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_bytes", "ids", "offsets"][:len(columns)])
        # The worker may wait for its next task for long.
        words.forget()

    extra = ", offsets binary" if with_offsets else ""
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, n_bytes bigint, ids binary{extra}")


def decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def token_offsets(ids: bytes, lengths: np.ndarray) -> bytes:
    each = lengths[np.frombuffer(ids, "<u4")]
    return (np.cumsum(each) - each).astype("<u4").tobytes()


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with ``bytes`` (binary): what the ids stand for."""
    shared = prepare(encoded).sparkContext.broadcast(vocabulary)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            data, offsets = utf8(batch["ids"])
            raw = data.tobytes()
            out = [decoded(raw[a:b], tokens) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return encoded.mapInArrow(run, f"{kinds}, bytes binary")
