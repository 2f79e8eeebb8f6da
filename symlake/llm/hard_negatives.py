"""Hard negatives by threshold joins over an inverted index.

Vectors are integers (``floor(256 * x)``), scores exact inner products. Dimensions are ordered by their energy over all
rows and cut into segments; rows are dealt to stripes, each written once as an index file: ids, labels, the dimensions as
columns, and for every row the norm of what remains after each segment (suffix norm). Anchors are written in blocks of
the same form, with a threshold each.

A join takes one block of anchors and one stripe. From the suffix norms follows for every row from which segment on the
rest cannot reach the smallest threshold of the block: these dimensions are left out of the inverted lists, and rows that
cannot reach it at all are not touched. Partial scores are accumulated segment by segment; after each, pairs whose partial
score plus the product of the remaining norms stays below the anchor's threshold are dropped, and what survives is
finished exactly.

Thresholds begin high and are lowered, only for anchors whose windows are not full: first until ``n_positives`` rows of
the anchor's label are found, then until every window below a positive's score holds ``n_negatives`` rows of other labels
or its lower end is reached. A window that is full above the threshold is final. Each round is a job over the pairs
(block, stripe), named by two numbers; vectors are read from the files and never shuffled again. Per anchor and stripe
only the best few rows leave a task.

Defined results: rows without id, label or vector or with a null or non-finite component take no part; components are
held to +-2**26, shorter vectors count as zero where they end; of several rows with one id the one of smallest label, then
smallest vector counts; ties go to the smaller id; anchors with too few positives have fewer, windows may be empty; a
positive of negative score has no window; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.session import Scratch, prepare

LARGEST = 1 << 26
SEGMENT = 8
#: Rows and anchors that are multiplied at once.
ROWS, ANCHORS = 4096, 512
BLOCK = "block int, file string"


def integers(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, v``: the rows that take part, one per id."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(LARGEST).cast("bigint")), F.lit(-LARGEST).cast("bigint")).cast("int"))
    held = rows.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return held.select(F.col(id).cast("bigint").alias("id"), F.struct(F.col(label).cast("bigint").alias("label"), whole.alias("v")).alias("row")).groupBy(
        "id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def _matrix(column: pa.Array, order: np.ndarray | None = None) -> np.ndarray:
    """Vectors as rows, padded with zeros, dimensions in ``order``."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(order) if order is not None else int(sizes.max(initial=0))
    out = np.zeros((len(column), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out if order is None else out[:, order]


def energies(vectors: DataFrame) -> np.ndarray:
    """Sum of squares of every dimension: one row per dimension reaches the driver."""
    prepare(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for batch in batches:
            own = (_matrix(batch["v"]).astype(np.float64) ** 2).sum(axis=0)
            wide = max(len(total), len(own))
            total = np.pad(total, (0, wide - len(total))) + np.pad(own, (0, wide - len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["d", "e"])

    got = vectors.select("v").mapInArrow(run, "d int, e double").groupBy("d").agg(F.sum("e").alias("e")).orderBy("d").toArrow()
    return got["e"].to_numpy()


def tails(x: np.ndarray) -> np.ndarray:
    """Norm of what remains from each segment on; the last column is zero."""
    squares = x.astype(np.float64) ** 2
    cuts = np.arange(0, x.shape[1], SEGMENT)
    sums = np.add.reduceat(squares, cuts, axis=1) if x.shape[1] else np.zeros((len(x), 0))
    left = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)


@dataclass
class Part:
    """Some vectors in order of the dimensions, with labels, ids and, for anchors, thresholds and windows."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    tails: np.ndarray
    floors: np.ndarray  # an anchor's threshold
    windows: np.ndarray  # lower and upper ends of an anchor's open windows, and their numbers

    def save(self, folder: str, name: str) -> None:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            sink = pa.BufferOutputStream()
            for a in (self.ids, self.labels, self.x, self.tails, self.floors, self.windows):
                np.lib.format.write_array(sink, a)
            out.write(sink.getvalue())

    @staticmethod
    def load(folder: str, name: str) -> Part:
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/{name}") as f:
            raw = pa.BufferReader(f.read())
        return Part(*(np.lib.format.read_array(raw) for _ in range(6)))


def above(x: np.ndarray, x_tails: np.ndarray, floors: np.ndarray, y: np.ndarray, y_tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(row of x, row of y, score)`` with ``score >= floors[row of x]``."""
    n_segments = x_tails.shape[1] - 1
    least, slack = floors.min(), 1e-6
    if least > 0:
        # How many segments of a row are in the inverted lists: the rest cannot bring any anchor to its threshold.
        kept = (y_tails[:, :-1] * x_tails.max(axis=0)[:-1] + slack >= least).sum(axis=1)
    else:
        kept = np.full(len(y), n_segments)
    order = np.argsort(-kept, kind="stable")
    order = order[:int((kept > 0).sum())] if least > 0 else order
    y, y_tails, kept = y[order], y_tails[order], kept[order]
    score = np.zeros((len(x), len(y)))
    alive = np.ones(score.shape, bool)
    done = 0
    for s in range(n_segments):
        k = int((kept > s).sum())  # the inverted lists of this segment: a prefix
        part = slice(s * SEGMENT, (s + 1) * SEGMENT)
        score[:, :k] += x[:, part] @ y[:k, part].T
        done = s + 1
        if least > 0 and s % 2:
            alive[:, :k] = score[:, :k] + x_tails[:, done][:, None] * y_tails[:k, done] + slack >= floors[:, None]
            if np.count_nonzero(alive) < alive.size // 16:
                break
    a, b = np.nonzero(alive)
    got, at = score[a, b], np.minimum(kept[b], done)
    for s in range(n_segments):
        todo = np.flatnonzero(at <= s)
        part = slice(s * SEGMENT, (s + 1) * SEGMENT)
        if len(todo):
            got[todo] += np.einsum("ij,ij->i", x[a[todo], part], y[b[todo], part])
            keep = got + np.where(at <= s, x_tails[a, s + 1] * y_tails[b, s + 1], np.inf) + slack >= floors[a]
            a, b, got, at = a[keep], b[keep], got[keep], at[keep]
    good = got >= floors[a]
    return a[good], order[b[good]], got[good]


def _best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each group by score, then id."""
    order = np.lexsort((ids, -scores, groups))
    sorted_groups = groups[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_groups[1:] != sorted_groups[:-1]])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.concatenate([first, [len(order)]])))
    return order[rank < n]


def join(anchors: Part, rows: Part, n: int) -> Iterator[pa.RecordBatch]:
    """``anchor, k, score, id``: of each anchor's rows above its threshold the first ``n`` of its own label (``k`` 0), or,
    where the anchor has windows, the first ``n`` of other labels in each (``k`` is the window's number)."""
    # Doubles add whole numbers exactly below 2**53; beyond, 64-bit integers do.
    most = float(np.abs(anchors.x).max(initial=0)) * float(np.abs(rows.x).max(initial=0)) * max(1, rows.x.shape[1])
    kind = np.float64 if most < 2 ** 53 else np.int64
    for j in range(0, len(rows.ids), ROWS):
        y, y_tails = rows.x[j:j + ROWS].astype(kind), rows.tails[j:j + ROWS]
        y_ids, y_labels = rows.ids[j:j + ROWS], rows.labels[j:j + ROWS]
        for i in range(0, len(anchors.ids), ANCHORS):
            a, b, score = _scores(anchors.x[i:i + ANCHORS].astype(kind), anchors.tails[i:i + ANCHORS], anchors.floors[i:i + ANCHORS], y, y_tails)
            a = a + i
            same = anchors.labels[a] == y_labels[b]
            if anchors.windows.shape[1]:
                found = []
                for w in range(anchors.windows.shape[1]):
                    low, high, number = anchors.windows[a, w].T
                    inside = np.flatnonzero(~same & (score >= low) & (score <= high))
                    best = inside[_best(a[inside], score[inside], y_ids[b[inside]], n)]
                    found.append((best, number[best]))
                places, numbers = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            else:
                inside = np.flatnonzero(same & (anchors.ids[a] != y_ids[b]))
                places = inside[_best(a[inside], score[inside], y_ids[b[inside]], n)]
                numbers = np.zeros(len(places), np.int64)
            if len(places):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.ids[a[places]]), pa.array(numbers.astype(np.int32)), pa.array(score[places].astype(np.int64)), pa.array(y_ids[b[places]])],
                    names=["anchor", "k", "score", "id"])


def _scores(x, x_tails, floors, y, y_tails):
    if x.dtype == np.int64:  # a floor is a double: what lies closest below it may stand for the same number
        score = x @ y.T
        a, b = np.nonzero(score >= np.where(np.isinf(floors), floors, floors - np.abs(floors) * 2.0 ** -50)[:, None])
        return a, b, score[a, b]
    return above(x, x_tails, floors, y, y_tails)


@dataclass
class Miner:
    """The written index of all rows and what its joins need."""

    spark: SparkSession
    scratch: Scratch
    folder: str
    order: np.ndarray
    stripes: list[str]
    norm: float  # of the longest row
    block_rows: int

    def blocks(self, vectors: DataFrame, n: int, name: str, rows: int, floor: str = "NULL", windows: str = "array()") -> list[str]:
        """Write the ``n`` rows of ``vectors(id, label, v)`` as files of about ``rows`` each; their names."""
        order, folder = self.order, self.folder

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("id").combine_chunks()
            x = _matrix(table["v"].combine_chunks(), order)
            flat = table["windows"].combine_chunks()
            wide = len(flat[0]) // 3 if len(flat) else 0
            part = Part(table["id"].to_numpy(), table["label"].to_numpy(), x, tails(x), table["floor"].to_numpy(),
                        flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(table), wide, 3))
            file = f"{name}-{uuid.uuid4().hex}"
            part.save(folder, file)
            return pa.table({"block": table["block"].slice(0, 1), "file": [file]})

        if not n:
            return []
        dealt = vectors.select("id", "label", "v", F.expr(f"cast({floor} AS double)").alias("floor"), F.expr(f"cast({windows} AS array<bigint>)").alias("windows"),
                               F.pmod(F.xxhash64("id"), F.lit(-(-n // rows))).cast("int").alias("block"))
        return [r["file"] for r in dealt.groupBy("block").applyInArrow(run, BLOCK).collect()]

    def meet(self, anchors: list[str], n: int) -> DataFrame:
        """Join every block of anchors with every stripe and keep the first ``n`` per anchor and window."""
        stripes, folder, wide = self.stripes, self.folder, len(self.stripes)
        pairs = self.spark.range(0, len(anchors) * wide, 1, min(len(anchors) * wide, 10_000))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Part] = {}
            for batch in batches:
                for pair in batch["id"].to_pylist():
                    names = anchors[pair // wide], stripes[pair % wide]
                    held = {name: held.get(name) or Part.load(folder, name) for name in names}
                    yield from join(held[names[0]], held[names[1]], n)

        found = pairs.mapInArrow(run, "anchor bigint, k int, score bigint, id bigint")
        best = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def index(vectors: DataFrame, stripe_rows: int, block_rows: int) -> Miner:
    spark = prepare(vectors)
    scratch = Scratch(spark, "hard-negatives")
    held, n = scratch.save(vectors, "vectors")
    order = np.argsort(-energies(held), kind="stable")
    norm = held.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0]
    miner = Miner(spark, scratch, scratch.path("files"), order, [], float(norm or 0) ** 0.5, block_rows)
    miner.stripes = miner.blocks(held, n, "stripe", stripe_rows)
    return miner


def _rounds(miner: Miner, todo: DataFrame, start: str, lower: str, full: str, windows: str, n: int, name: str) -> DataFrame:
    """Join at the threshold ``start`` and lower it by ``lower`` for the anchors that are not ``full``.

    ``todo``: anchors ``id, label, v`` and what the expressions name; ``full`` sees the number of found rows as ``found``
    (per anchor, an array by window) and the threshold as ``floor``."""
    scratch, out, k = miner.scratch, [], 0
    todo, left = scratch.save(todo.withColumn("floor", F.expr(f"cast({start} AS double)")), f"{name}-todo-0")
    while left:
        files = miner.blocks(todo, left, f"{name}-{k}", miner.block_rows, "floor", windows)
        got, _ = scratch.save(miner.meet(files, n), f"{name}-got-{k}")
        counts = got.groupBy("anchor", "k").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("anchor").alias("id")).agg(
            F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("found"))
        state = todo.join(counts, "id", "left").withColumn("found", F.coalesce("found", F.create_map().cast("map<int,bigint>")))
        k += 1
        todo, left = scratch.save(state.filter(f"NOT ({full})").drop("found").withColumn("floor", F.expr(lower)), f"{name}-todo-{k}")
        out.append(got.join(todo.select(F.col("id").alias("anchor")), "anchor", "left_anti"))
    if not out:
        return miner.spark.createDataFrame([], "anchor bigint, k int, score bigint, id bigint, rank int")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return scratch.save(whole, f"{name}-found")[0]


def mine(vectors: DataFrame, anchor: str = "id % 50 = 0", n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
         first_share: float = 0.5, lowered: float = 0.6, stripe_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors(id, label, v)`` as ``integers`` gives them; rows that pass ``anchor`` are anchors. Thresholds begin at
    ``first_share`` of what the anchor can score at most and fall to ``lowered`` of that each round; below a fiftieth of
    the largest possible score everything is read."""
    miner = index(vectors, stripe_rows, block_rows)
    scratch = miner.scratch
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not miner.stripes:
        return miner.spark.createDataFrame([], empty)
    everything = "cast('-Infinity' AS double)"
    anchors = scratch.read("vectors").filter(anchor).withColumn(
        "most", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) * miner.norm)
    positives = _rounds(miner, anchors, f"most * {first_share}", f"CASE WHEN floor * {lowered} > most / 50 THEN floor * {lowered} ELSE {everything} END",
                        f"coalesce(found[0], 0) >= {n_positives} OR floor = {everything}", "array()", n_positives, "positive")
    # Windows: whole scores from low to high percent of the positive's score.
    ends = positives.filter("score >= 0").selectExpr(
        "anchor", "rank AS k", "id AS positive_id", "score AS positive_score", f"cast(ceil(score * {low_percent} / cast(100 AS decimal(3, 0))) AS bigint) AS low",
        f"cast(floor(score * {high_percent} / cast(100 AS decimal(3, 0))) AS bigint) AS high").filter("low <= high")
    ends, _ = scratch.save(ends, "windows")
    per_anchor = ends.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("ends"))
    # One triple (low, high, number) per possible window; absent ones are empty.
    absent = ", ".join(f"coalesce(get(filter(ends, e -> e.k = {k}), 0).low, 1L), coalesce(get(filter(ends, e -> e.k = {k}), 0).high, 0L), {k}L" for k in range(1, n_positives + 1))
    searched = scratch.read("vectors").join(per_anchor, "id").withColumn("lowest", F.expr("array_min(transform(ends, e -> e.low))")).withColumn(
        "start", F.expr("array_min(transform(ends, e -> e.high))"))
    negatives = _rounds(
        miner, searched, "greatest(start * 0.9, lowest)", f"CASE WHEN floor <= lowest THEN {everything} ELSE greatest(floor * 0.75, cast(lowest AS double)) END",
        f"forall(ends, e -> e.low >= floor OR coalesce(found[e.k], 0) >= {n_negatives})", f"array({absent})", n_negatives, "negative")
    return negatives.selectExpr("anchor", "k", "rank", "id AS negative_id", "score AS negative_score").join(ends, ["anchor", "k"]).selectExpr(
        "anchor AS anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
