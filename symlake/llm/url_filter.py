"""URL rules in sorted digest arrays that tasks map into memory.

A rule is a host and the beginning of a path; it fits the host and all its subdomains. The rules become two arrays, each
sorted by the 64-bit xxhash of its strings and written in segments by range of the digest:

- ``hosts``: every rule host with the path lengths (bytes) that its rules have;
- ``rules``: host and path together, with the verdict.

A segment holds digests, string offsets and the full strings; a task maps the segments that its probes reach, so memory
is page cache that the machine may take back, shared by all workers (from a store that cannot be mapped, a task reads
the segment, and keeps a few). All probes of a batch go through one vectorised
binary search per segment; a hit counts only if the stored string equals the wanted one, and equal digests of different
strings are walked through, so collisions change nothing. First the suffixes of the distinct hosts of a batch are probed,
no longer than the longest rule host, then the path prefixes of exactly the lengths that the found hosts have. Nothing is
shuffled or broadcast; only the directory (one row per segment of ``segment_rows`` strings) passes the driver.

Defined results: a url without ``://`` and a null url have empty host and path and fit no rule; hosts compare with A-Z
lower-cased, paths as they are; the rule of most code points wins, then the one with the longer host; a rule given twice
with two verdicts blocks; rules without a host or verdict are left out; without rules everything is judged
``otherwise``; repeated pages are judged each.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.llm.session import Scratch, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that a task keeps open; the one used longest ago is let go.
HELD = 16
DIRECTORY = "array string, low bigint, high bigint, file string, n bigint, longest bigint"


def digest(string: bytes) -> int:
    """What Spark's ``xxhash64`` gives for a string."""
    return xxhash.xxh64_intdigest(string, 42)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.get(F.split(F.col(url), "://", 2), F.lit(1))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rules:
    """The written arrays: their folder and one entry ``(low, high, file, longest string)`` per segment, in order."""

    folder: str
    hosts: tuple
    rules: tuple


def build(rules: DataFrame, folder: str | None = None, segment_rows: int = 1_000_000) -> Rules:
    """Write the arrays of ``rules(rule, verdict)`` below ``folder``, a path that executors can reach."""
    spark = prepare(rules)
    scratch = Scratch(spark, "url-rules")
    folder = folder or scratch.path("arrays")
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract("rule", "(?s)^[^/]*(.*)", 1)
    parsed, _ = scratch.save(
        rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").select(host.alias("host"), path.alias("path"), "verdict").filter("host != ''")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    hosts = parsed.groupBy("host").agg(F.sort_array(F.collect_set(F.octet_length("path"))).alias("sizes")).select(
        F.col("host").alias("string"), F.array_join("sizes", ",").alias("value"))
    whole = parsed.select(F.concat("host", "path").alias("string"), F.col("verdict").alias("value"))
    return Rules(folder, *(_write(df, name, folder, segment_rows, scratch) for df, name in ((hosts, "hosts"), (whole, "rules"))))


def _write(strings: DataFrame, name: str, folder: str, segment_rows: int, scratch: Scratch) -> tuple:
    """Segments of ``string, value`` in order of the digest."""
    placed, n = scratch.save(strings.withColumn("digest", F.xxhash64("string")), f"strings-{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            keys = rows["digest"].to_numpy()
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            file = f"{name}-{uuid.uuid4().hex}.bin"
            columns = [[x.encode() for x in rows[c].to_pylist()] for c in ("string", "value")]
            with store.open_output_stream(f"{path}/{file}", compression=None) as out:
                out.write(np.array([len(keys)], np.int64).tobytes() + keys.astype(np.int64).tobytes())
                for c in columns:
                    out.write(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int64).tobytes())
                for c in columns:
                    out.write(b"".join(c))
            longest = max(map(len, columns[0]))
            yield pa.RecordBatch.from_pylist([{"array": name, "low": int(keys[0]), "high": int(keys[-1]), "file": file, "n": len(keys), "longest": longest}])

    ranged = placed.repartitionByRange(max(1, -(-n // segment_rows)), "digest").sortWithinPartitions("digest", "string")
    directory, _ = scratch.save(ranged.mapInArrow(run, DIRECTORY), f"directory-{name}")
    return tuple((r["low"], r["high"], r["file"], r["longest"]) for r in directory.orderBy("low").collect())


class Segment:
    """One file: mapped where its folder is mounted, else read as a whole (its size is bounded by ``segment_rows``)."""

    def __init__(self, folder: str, name: str):
        store, path = fs.FileSystem.from_uri(folder)
        if isinstance(store, fs.LocalFileSystem):
            with open(f"{path}/{name}", "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with store.open_input_stream(f"{path}/{name}") as f:
                self.map = f.read()
        n = int(np.frombuffer(self.map, np.int64, 1)[0])
        self.keys = np.frombuffer(self.map, np.int64, n, 8)
        self.cuts = [np.frombuffer(self.map, np.int64, n + 1, 8 + 8 * n + k * 8 * (n + 1)) for k in range(2)]
        first = 8 + 8 * n + 16 * (n + 1)
        self.starts = [first, first + int(self.cuts[0][-1])]

    def text(self, column: int, row: int) -> bytes:
        a, b = self.cuts[column][row:row + 2]
        return bytes(self.map[self.starts[column] + int(a):self.starts[column] + int(b)])


class DigestArray:
    """All segments of one array; ``find`` gives the value of each string that is there."""

    def __init__(self, folder: str, segments: tuple, digest: Callable[[bytes], int] = digest):
        self.folder, self.segments, self.digest = folder, segments, digest
        self.highs = np.array([s[1] for s in segments], np.int64)
        self.longest = max((s[3] for s in segments), default=0)
        self.open: dict[int, Segment] = {}

    def find(self, strings: list[bytes]) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(strings)
        if not self.segments or not strings:
            return out
        keys = np.array([self.digest(s) for s in strings], np.uint64).view(np.int64)
        places = np.searchsorted(self.highs, keys)
        for k in np.unique(places[places < len(self.segments)]).tolist():
            if k not in self.open:
                if len(self.open) >= HELD:
                    self.open.pop(next(iter(self.open)))
                self.open[k] = Segment(self.folder, self.segments[k][2])
            segment = self.open[k] = self.open.pop(k)
            own = np.flatnonzero(places == k)
            first, last = np.searchsorted(segment.keys, keys[own], "left"), np.searchsorted(segment.keys, keys[own], "right")
            for q in np.flatnonzero(last > first).tolist():
                for row in range(first[q], last[q]):
                    if segment.text(0, row) == strings[own[q]]:
                        out[own[q]] = segment.text(1, row)
                        break
        return out


def suffixes(host: str, longest: int) -> list[bytes]:
    """``host`` and its parent domains, as far as a rule of ``longest`` bytes can be one of them."""
    raw = host.encode()
    out = [raw] if 0 < len(raw) <= longest else []
    at = raw.find(b".", max(0, len(raw) - longest - 1))
    while at >= 0:
        if at + 1 < len(raw):
            out.append(raw[at + 1:])
        at = raw.find(b".", at + 1)
    return out


def judge(pages: DataFrame, rules: Rules, otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``."""
    prepare(pages)
    host, path = host_and_path()
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, whole = DigestArray(rules.folder, rules.hosts), DigestArray(rules.folder, rules.rules)
        for batch in batches:
            named = pc.dictionary_encode(batch["host"])
            of_host = _of_hosts(named.dictionary.to_pylist(), hosts)
            paths = batch["path"].cast(pa.binary()).to_pylist()
            wanted: dict[bytes, None] = {}
            for k, path in zip(named.indices.to_numpy(), paths):
                for own, size in of_host[k]:
                    if len(path) >= size:
                        wanted[own + path[:size]] = None
            keys = list(wanted)
            verdicts = {key: value.decode() for key, value in zip(keys, whole.find(keys)) if value is not None}
            found: list[tuple[str | None, str]] = []
            for k, path in zip(named.indices.to_numpy(), paths):
                fits = [(own, size) for own, size in of_host[k] if len(path) >= size and own + path[:size] in verdicts]
                best = max(((len((own + path[:size]).decode("utf-8", "replace")), len(own), own + path[:size]) for own, size in fits), default=None)
                found.append((best[2].decode(), verdicts[best[2]]) if best else (None, otherwise))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string")


def _of_hosts(names: list[str], hosts: DigestArray) -> list[list[tuple[bytes, int]]]:
    """For each host the rule hosts that it lies under, each with the path lengths of its rules."""
    tails = [suffixes(name, hosts.longest) for name in names]
    flat = list(dict.fromkeys(x for own in tails for x in own))
    sizes = {x: [int(s) for s in value.split(b",")] for x, value in zip(flat, hosts.find(flat)) if value is not None}
    return [[(x, size) for x in own if x in sizes for size in sizes[x]] for own in tails]
