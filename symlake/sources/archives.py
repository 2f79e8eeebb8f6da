"""Archive and directory scans.

``read_archives`` opens archives by their central directory. A first pass reads only directory records, by range, and
gives one row per member: where it lies in its file, how long it is, how it is packed. Members are then dealt to tasks by
stretches of ``SLOT_BYTES`` of their file, and each is inflated from its own range. So an archive may have any size and
as many tasks as it has stretches, and none is held as a value. Inner archives that are stored without compression are
read in place, at any depth; compressed ones go round again as rows of their inflated bytes (``expand_archives``).

``expand_archives`` takes archives that are already values (at most 2 GiB). Members leave a task in byte-bounded batches.
Every member becomes a row: one that cannot be read keeps its row with ``content`` null and the reason in ``error``.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake import model
from symlake.session import ship_package

# File extensions opened as archives.
ARCHIVE_EXTENSIONS = ["zip", "jar", "war", "ear", "aar", "kar", "jmod"]

BATCH_BYTES = 8 << 20
#: What one binary value can hold; larger files and members keep a row with the reason.
LARGEST_VALUE = (1 << 31) - 1
DEFAULT_DEPTH = 15
#: Bytes of an archive whose members go to one task together.
SLOT_BYTES = 64 << 20
#: Directory rows that leave the first pass at once.
DIRECTORY_ROWS = 8192
STORED, DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
MEMBERS = (
    "container string, root_container string, container_type string, entry_path string, parent_path string, is_dir boolean, "
    "length bigint, depth int, error string, base bigint, size bigint, place bigint, packed bigint, method int, crc bigint, "
    "inner boolean"
)


def is_archive(path: str) -> bool:
    return path.rsplit(".", 1)[-1].lower() in ARCHIVE_EXTENSIONS and "." in path


def archive_glob() -> str:
    """File name pattern of all archive suffixes, letters in either case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in ARCHIVE_EXTENSIONS) + "}"


def container_type_of(name: str) -> str:
    """Type by suffix alone, as for every zipped container."""
    ext = name.rsplit(".", 1)[-1].lower()
    return ext if ext in ("kar", "jmod", "ear", "war", "jar") else "generic"


def _folders(infos: dict[str, zipfile.ZipInfo]) -> set[str]:
    """Directories that an archive names or that the paths of its members imply."""
    folders = {n.rstrip("/") for n, i in infos.items() if i.is_dir()}
    for name in infos:
        parent = posixpath.dirname(name.rstrip("/"))
        while parent and parent not in folders:
            folders.add(parent)
            parent = posixpath.dirname(parent)
    return folders


def _members(container: str, root: str, data: bytes, depth: int, max_depth: int, limit: int) -> Iterator[dict]:
    kind = container_type_of(container)
    base = {"container": container, "root_container": root, "container_type": kind, "depth": depth}
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = {i.filename: i for i in archive.infolist()}
    except Exception as e:
        yield {**base, "entry_path": "", "parent_path": "", "is_dir": True, "length": len(data),
               "content": None, "error": f"{type(e).__name__}: {e}"}
        return
    for name in sorted(_folders(infos)):
        yield {**base, "entry_path": name, "parent_path": posixpath.dirname(name), "is_dir": True, "length": 0,
               "content": None, "error": None}
    for name, info in infos.items():
        if info.is_dir():
            continue
        content, error = None, None
        if info.file_size > limit:
            error = f"member of {info.file_size} bytes is above the limit of {limit}"
        else:
            try:
                content = archive.read(info)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        inner = content is not None and is_archive(name)
        if inner and depth >= max_depth:
            error = f"inner archive not opened: {max_depth} levels of nesting are"
        yield {**base, "entry_path": name, "parent_path": posixpath.dirname(name), "is_dir": False,
               "length": info.file_size, "content": content, "error": error}
        if inner and depth < max_depth:
            yield from _members(f"{container}!/{name}", root, content, depth + 1, max_depth, limit)


COLUMNS = ["container", "root_container", "container_type", "entry_path", "parent_path", "is_dir", "length",
           "depth", "content", "error"]


def _expander(max_depth: int, limit: int):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                # One archive at a time becomes a Python value.
                file = batch.slice(i, 1).to_pylist()[0]
                for row in _members(file["container"], file["root_container"], file["content"], file["depth"], max_depth, limit):
                    rows.append(row)
                    size += len(row["content"] or b"") + 256
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return expand


def expand_archives(files: DataFrame, max_depth: int = DEFAULT_DEPTH,
                    max_member_bytes: int = LARGEST_VALUE) -> DataFrame:
    """Entries of ``files(container, root_container, depth, content)`` and of archives nested inside them."""
    ship_package(files.sparkSession)
    return files.select("container", "root_container", "depth", "content").mapInArrow(
        _expander(max_depth, max_member_bytes), model.ENTRIES)


class _Part(io.RawIOBase):
    """``size`` bytes of a seekable file from ``base`` on, as a file of their own."""

    def __init__(self, file, base: int, size: int):
        self.file, self.base, self.size, self.at = file, base, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("seek before the start")
        self.at = at
        return at

    def read(self, n: int = -1) -> bytes:
        left = max(0, self.size - self.at)
        n = left if n is None or n < 0 else min(n, left)
        if not n:
            return b""
        self.file.seek(self.base + self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data


def _data_start(file, place: int) -> int:
    """Where the bytes of the member begin whose local header is at ``place``."""
    file.seek(place)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("Bad magic number for file header")
    return place + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def _directory(file, root: str, container: str, base: int, size: int, depth: int, max_depth: int, limit: int) -> Iterator[dict]:
    """Rows of ``MEMBERS`` for the archive in bytes ``base`` to ``base + size`` of ``file``, read from its directory."""
    row = {"container": container, "root_container": root, "container_type": container_type_of(container), "depth": depth, "error": None,
           "base": base, "size": size, "place": None, "packed": 0, "method": None, "crc": None, "inner": False}
    try:
        infos = {i.filename: i for i in zipfile.ZipFile(_Part(file, base, size)).infolist()}
    except Exception as e:
        yield {**row, "entry_path": "", "parent_path": "", "is_dir": True, "length": size, "error": f"{type(e).__name__}: {e}"}
        return
    for name in sorted(_folders(infos)):
        yield {**row, "entry_path": name, "parent_path": posixpath.dirname(name), "is_dir": True, "length": 0}
    for name, info in infos.items():
        if info.is_dir():
            continue
        place = base + info.header_offset
        member = {**row, "entry_path": name, "parent_path": posixpath.dirname(name), "is_dir": False, "length": info.file_size, "place": place,
                  "packed": info.compress_size, "method": -1 if info.flag_bits & 1 else info.compress_type, "crc": info.CRC}
        inside = None
        if info.file_size > limit:
            member["error"] = f"member of {info.file_size} bytes is above the limit of {limit}"
        if is_archive(name):
            stored = member["method"] == STORED
            if depth >= max_depth:
                member["error"] = member["error"] or f"inner archive not opened: {max_depth} levels of nesting are"
            elif stored:
                try:
                    inside = _data_start(file, place)
                except Exception as e:
                    member["error"] = member["error"] or f"{type(e).__name__}: {e}"
            else:
                member["inner"] = member["error"] is None
        yield member
        if inside is not None:
            yield from _directory(file, root, f"{container}!/{name}", inside, info.file_size, depth + 1, max_depth, limit)


def _open(path: str):
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def archive_members(files: DataFrame, max_depth: int = DEFAULT_DEPTH, max_member_bytes: int = LARGEST_VALUE) -> DataFrame:
    """Rows of ``MEMBERS`` for ``files(path, length)``: what the directories of the archives tell, without contents."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MEMBERS.split(", ")])
        for batch in batches:
            for path, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                rows = []
                with _open(path) as file:
                    for row in _directory(file, path, path, 0, size, 0, max_depth, max_member_bytes):
                        rows.append(row)
                        if len(rows) == DIRECTORY_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "length").mapInArrow(run, MEMBERS)


def _content(file, row: dict) -> bytes:
    """The bytes of one member, from its own range."""
    if row["method"] not in (STORED, DEFLATED):  # other methods, and encrypted members with their reason
        return zipfile.ZipFile(_Part(file, row["base"], row["size"])).read(row["entry_path"])
    start = _data_start(file, row["place"])
    file.seek(start)
    data = file.read(row["packed"])
    if row["method"] == DEFLATED:
        # One byte more than announced shows a member that holds more, and no more than that is ever unpacked.
        data = zlib.decompressobj(-15).decompress(data, row["length"] + 1)
    if len(data) != row["length"] or zlib.crc32(data) != row["crc"]:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {row['entry_path']!r}")
    return data


def member_contents(members: DataFrame, partitions: int, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """Entries of ``members`` with their contents. Stretches of ``slot_bytes`` of each file are dealt to ``partitions``
    tasks; directories go with the first stretch of their archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                content, error = None, row["error"]
                # What is too long has no content; an inner archive that is not opened keeps its bytes.
                if not row["is_dir"] and (error is None or error.startswith("inner archive not opened")):
                    if path != row["root_container"]:
                        if file is not None:
                            file.close()
                        path, file = row["root_container"], _open(row["root_container"])
                    try:
                        content = _content(file, row)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append({**row, "content": content, "error": error})
                size += len(content or b"") + 256
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        if file is not None:
            file.close()

    slot = F.floor(F.coalesce("place", "base") / slot_bytes)
    dealt = members.repartition(partitions, F.col("root_container"), slot).sortWithinPartitions("root_container", "place")
    return dealt.mapInArrow(run, model.ENTRIES)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"is_dir": pa.bool_(), "length": pa.int64(), "depth": pa.int32(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], names=COLUMNS)


def read_archives(spark: SparkSession, path: str, max_depth: int = DEFAULT_DEPTH,
                  max_member_bytes: int = LARGEST_VALUE, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """Entries of all archives below ``path``, a folder that the tasks' Arrow file systems can open. ``max_depth`` counts
    levels of nested archives. Files may have any size; only where ``spark.sql.sources.binaryFile.maxLength`` is set
    below what a value can hold, longer files are not opened and keep one row with the reason. No archive gives no row."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", archive_glob()).load(path).select("path", "length")
    )
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(LARGEST_VALUE)))
    limit = limit if limit < LARGEST_VALUE else (1 << 63) - 1
    # Names and lengths alone are read here.
    total, n_files = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    partitions = max(1, min(-(-(total or 0) // slot_bytes) + min(n_files, spark.sparkContext.defaultParallelism), 100_000))
    members = archive_members(files.filter(F.col("length") <= limit), max_depth, max_member_bytes)
    inner = member_contents(members.filter("inner"), partitions, slot_bytes).filter("content IS NOT NULL").select(
        F.concat_ws("!/", "container", "entry_path").alias("container"), "root_container", (F.col("depth") + 1).alias("depth"), "content")
    ext = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(ext.isin("kar", "jmod", "ear", "war", "jar"), ext).otherwise("generic")
    too_long = files.filter(F.col("length") > limit).select(
        F.col("path").alias("container"), F.col("path").alias("root_container"), kind.alias("container_type"), F.lit("").alias("entry_path"),
        F.lit("").alias("parent_path"), F.lit(True).alias("is_dir"), "length", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("content"),
        F.concat(F.lit("file of "), F.col("length").cast("string"), F.lit(f" bytes is above the limit of {limit}")).alias("error"))
    return member_contents(members, partitions, slot_bytes).unionByName(expand_archives(inner, max_depth, max_member_bytes)).unionByName(too_long)


def expand_nested(entries: DataFrame, max_depth: int = DEFAULT_DEPTH,
                  max_member_bytes: int = LARGEST_VALUE) -> DataFrame:
    """Entries of the archives among ``entries`` that were not opened yet (for a scan done with depth 0)."""
    ext = F.lower(F.substring_index("entry_path", ".", -1))
    nested = entries.filter(~F.col("is_dir") & ext.isin(ARCHIVE_EXTENSIONS) & F.col("content").isNotNull())
    return expand_archives(
        nested.select(F.concat_ws("!/", "container", "entry_path").alias("container"), "root_container",
                      (F.col("depth") + 1).alias("depth"), "content"), max_depth, max_member_bytes)


def read_directory(spark: SparkSession, path: str, max_depth: int = DEFAULT_DEPTH,
                   glob: str | None = None, with_content: bool = True) -> DataFrame:
    """Files of an exploded directory down to ``max_depth`` levels. The depth filter works on the path alone, and
    without content the scan never opens a file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = "file:" + path.rstrip("/") if path.startswith("/") else path.rstrip("/")
    files = reader.load(path)
    rel = F.ltrim(F.regexp_replace(F.col("path"), "^.*?" + _quote(path.rstrip("/")) + "/", ""), F.lit("/"))
    out = files.select(
        F.lit(root).alias("container"), F.lit(root).alias("root_container"), F.lit("generic").alias("container_type"),
        rel.alias("entry_path"),
        F.substring(rel, F.lit(1), F.length(rel) - F.length(F.substring_index(rel, "/", -1)) - 1).alias("parent_path"),
        F.lit(False).alias("is_dir"), F.col("length"), F.lit(0).alias("depth"),
        (F.col("content") if with_content else F.lit(None).cast("binary")).alias("content"),
        F.lit(None).cast("string").alias("error"))
    return depth_limited(out, max_depth)


def depth_limited(entries: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """Entries at most ``max_depth`` levels below the root of their container."""
    return entries.filter(F.size(F.split("entry_path", "/")) <= max_depth)


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)
