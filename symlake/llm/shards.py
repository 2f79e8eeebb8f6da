"""Token ids in training order, as fixed-stride binary shards.

The ids of all documents of a partition follow each other, with an end mark after each document, and are cut into
sequences of ``length`` ids; only the last one of a partition is padded. Sequences are numbered without gaps: partition
sizes (one number each) are added up on the driver. A keyed Feistel permutation of that range (cycle-walking: applied
again until the value is inside) gives each sequence its slot in training order. The order follows from the key and the
number of sequences alone: there is no sort by random numbers, and slot and number can be computed from each other.

Slots are dealt by range: sequence ``s`` is row ``s % per_shard`` of shard ``s // per_shard``, and a row has
``2 * length`` bytes (ids are 16-bit little-endian). Reading from any slot on is one seek and a sequential read, so
training resumes anywhere.

A shard is written by one task under a name of its own; the manifest that Spark commits names the files that count.

Defined results: null and empty texts leave their end mark only; repeated rows are written each; an empty table has no
sequence and no shard.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from symlake.llm.arrays import mix, slices, utf8
from symlake.llm.bpe import SLICE_BYTES, Vocabulary
from symlake.llm.session import TASK_BYTES, Scratch, prepare, tasks_for

U = np.uint64
#: Beyond so many shards a task writes several neighbouring ones.
MOST_TASKS = 10_000
#: Compression of sequences until they have their place, and the bytes of ids it may refer to from the start.
LEVEL, FAMILIAR_BYTES = 5, 112 << 10


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of ``range(n)``."""

    n: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        """Bits of one half: the smallest even number of bits that holds the range."""
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round_keys(self) -> list[np.uint64]:
        digest = hashlib.sha512(f"{self.key}/{self.n}".encode()).digest()
        return [U(int.from_bytes(digest[8 * k:8 * k + 8], "little")) for k in range(self.rounds)]

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        bits, mask = U(self.half), U((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << bits | right

    def _back(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        bits, mask = U(self.half), U((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in reversed(keys):
            left, right = right ^ (mix(left ^ k) & mask), left
        return left << bits | right

    def _walk(self, values: np.ndarray, step) -> np.ndarray:
        out = np.asarray(values, dtype=np.int64).astype(np.uint64)
        keys = self._round_keys()
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = step(out[todo], keys)
            todo = todo[out[todo] >= U(self.n)]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._back)


def familiar(docs: DataFrame, vocabulary: Vocabulary, n: int = 128, n_chars: int = 1024) -> bytes:
    """Ids of the beginnings of some documents. A sequence is short for a compression of its own; with these before it
    it takes less room. They change the size of what is held, never a result."""
    texts = pa.array([r[0] for r in docs.select(F.substring("text", 1, n_chars)).limit(n).collect()], pa.string())
    found = vocabulary.encode(*utf8(texts)) if len(texts) else []
    vocabulary.forget()
    return np.frombuffer(b"".join(found), "<u4").astype("<u2").tobytes()[:FAMILIAR_BYTES]


def _dictionary(known: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if known else None


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int, known: bytes = b"") -> DataFrame:
    """``part, number, doc_ids, ids``: the sequences of each partition in order (compressed, as they are stored and
    shuffled before they get their place, with ``known`` ids before them), and whose ids they hold.

    The end mark is the first id that is free in the vocabulary, padding repeats it."""
    if max(vocabulary.ranks.values()) + 1 >= 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    shared = prepare(docs).sparkContext.broadcast(vocabulary)
    end = max(vocabulary.ranks.values()) + 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        mark = np.array([end], "<u2").tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(known))
        held = b""  # ids not cut yet
        owners: list[tuple[object, int]] = []  # documents in them, with the byte at which each ends

        def cut(stream: bytes) -> pa.RecordBatch | None:
            nonlocal held, owners, number
            whole = len(stream) // size
            lists, k = [], 0
            for stop in range(size, whole * size + 1, size):
                own = []
                while k < len(owners):
                    own.append(owners[k][0])
                    if owners[k][1] > stop:
                        break
                    k += 1
                    if owners[k - 1][1] == stop:
                        break
                lists.append(own)
            held, owners = stream[whole * size:], [(name, at - whole * size) for name, at in owners[k:]]
            first, number = number, number + whole
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * whole, pa.int32()), pa.array(range(first, number), pa.int64()), pa.array(lists, pa.list_(owner_type)),
                 pa.array([packer.compress(stream[r * size:(r + 1) * size]) for r in range(whole)], pa.binary())], names=["part", "number", "doc_ids", "ids"])

        for batch in batches:
            data, offsets = utf8(batch["text"])
            names = batch["doc_id"].to_pylist()
            for i, j in slices(offsets, SLICE_BYTES):
                parts, at = [held], len(held)
                for name, ids in zip(names[i:j], shared.value.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])):
                    parts.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() + mark)
                    at += len(parts[-1])
                    owners.append((name, at))
                yield cut(b"".join(parts))
        if held:
            yield cut(held + mark * ((size - len(held)) // 2))
        shared.value.forget()

    owner_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"part int, number bigint, doc_ids array<{id_type}>, ids binary")


def write(docs: DataFrame, vocabulary: Vocabulary, key: int, length: int = 1024, per_shard: int = 16_384, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the shards below ``folder`` and return ``(manifest, index)``.

    ``manifest``: ``shard, file, first_slot, n_rows, length, folder``; ``index``: ``slot, doc_ids``."""
    spark = prepare(docs)
    scratch = Scratch(spark, "shards")
    folder = folder or scratch.path("files")
    packed = scratch.path("packed")
    known = familiar(docs, vocabulary)
    sequences = pack(docs, vocabulary, length, known)
    sequences.write.option("compression", "none").parquet(packed)
    sequences = spark.read.schema(sequences.schema).parquet(packed)
    sizes = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    order = Permutation(max(total, 1), key)

    @F.pandas_udf("bigint")
    def slot_of(part: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(order.slots(part.map(before).to_numpy(np.int64) + number.to_numpy(np.int64)))

    placed = sequences.withColumn("slot", slot_of("part", "number"))
    # The ranges are known, so no sample of the rows is needed: the shard number is the partition.
    n_shards = tasks_for(total, per_shard)
    tasks = min(n_shards, MOST_TASKS)
    rows = placed.select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), "ids").repartitionById(
        tasks, F.floor(F.col("shard") * tasks / n_shards).cast("int")).sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, done, current = None, [], None
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(known))
        for batch in batches:
            for slot, shard, ids in zip(*(batch[c].to_pylist() for c in ("slot", "shard", "ids"))):
                if shard != current:
                    if out:
                        out.close()
                    current = shard
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}.bin"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    done.append([shard, name, slot, 0])
                out.write(unpacker.decompress(ids))
                done[-1][3] += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["shard", "file", "first_slot", "n_rows"])

    manifest, _ = scratch.save(rows.mapInArrow(run, "shard bigint, file string, first_slot bigint, n_rows bigint"), "manifest")
    index, _ = scratch.save(placed.select("slot", "doc_ids"), "index")
    return manifest.withColumns({"length": F.lit(length), "folder": F.lit(folder)}), index


def read(manifest: DataFrame, chunk: int = 1024) -> DataFrame:
    """``slot, ids`` of all shards, each read from its start in ranges of ``chunk`` rows."""
    prepare(manifest)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1, F.lit(chunk).cast("bigint")))
    wanted = manifest.agg(F.sum(F.col("n_rows") * F.col("length") * 2)).first()[0] or 0
    ranges = manifest.select("folder", "file", "length", F.col("first_slot"), starts.alias("row"), "n_rows").repartition(
        tasks_for(wanted, TASK_BYTES), "file", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = min(chunk, r["n_rows"] - r["row"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(r["first_slot"] + r["row"], r["first_slot"] + r["row"] + n), pa.int64()),
                     pa.array(_rows(r["folder"], r["file"], r["row"], n, 2 * r["length"]), pa.binary())], names=["slot", "ids"])

    return ranges.mapInArrow(run, "slot bigint, ids binary")


def _rows(folder: str, file: str, row: int, n: int, stride: int) -> list[bytes]:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{file}") as f:
        raw = f.read_at(n * stride, row * stride)
    return [raw[k * stride:(k + 1) * stride] for k in range(n)]


def resume(manifest: DataFrame, slot: int, n: int) -> list[np.ndarray]:
    """The ids of ``n`` sequences from ``slot`` on, as a trainer reads them: the shards of these slots, one range each."""
    out = []
    for r in manifest.filter((F.col("first_slot") < slot + n) & (F.col("first_slot") + F.col("n_rows") > slot)).orderBy("first_slot").collect():
        lo, hi = max(slot, r["first_slot"]), min(slot + n, r["first_slot"] + r["n_rows"])
        out += [np.frombuffer(x, "<u2") for x in _rows(r["folder"], r["file"], lo - r["first_slot"], hi - lo, 2 * r["length"])]
    return out
