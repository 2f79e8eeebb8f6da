"""WARC archives with a two-level capture index.

Captures are dealt by range of their reversed-host URL key, so that archives and index have one order. Each task writes
one archive (records compressed one by one) and beside it the capture lines in compressed blocks; what it returns is the
sparse directory: one row per block with its first and last key and where block and records lie. The directory is a
Parquet table written by Spark. Files of a task attempt that did not commit are named by no row and never read.

A lookup reads the directory rows that may hold the key, searches the block by bisection and reads one byte range of
one archive. Reading everything back goes block by block, each a single byte range.

Payloads of at least ``min_bytes`` that occur several times are kept once, in the record of the smallest ``page_id``;
the others refer to it. The table of repeated digests is joined; whether it is broadcast, Spark decides by its size.

Defined results: null html counts as empty; a null url has the empty key; rows with an equal payload and the same
smallest ``page_id`` are all responses, as are rows without a ``page_id``; repeated rows make repeated records; an empty
table makes an empty directory.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.llm.session import TASK_BYTES, Scratch, prepare, tasks_for

DIRECTORY = ("first_key string, last_key string, n bigint, index_file string, index_offset bigint, index_length bigint, "
             "archive string, archive_offset bigint, archive_length bigint")
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)((?::\d+)?[^#]*)"
CONTROL = {c: f"%{c:02X}" for c in [*range(33), 127]}


def url_key(url: str = "url") -> Column:
    """``http://www.example.com/a?b`` as ``com,example,www)/a?b``; what is no absolute URL stays as it is."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    backwards = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.coalesce(F.when(F.col(url).rlike(URL), F.concat(backwards, F.lit(")"), F.regexp_extract(url, URL, 2))).otherwise(F.col(url)), F.lit(""))


def captures(pages: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """``key, page_id, url, html, digest, refers_to``: one row per page; ``refers_to`` is set for revisits."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(url_key().alias("key"), "page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    repeated, _ = scratch.save(
        rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first < last").select("digest", "first"), "repeated")
    return rows.join(repeated, "digest", "left").select(
        "key", "page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {(url or '').translate(CONTROL)}", f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
             f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; ``payload`` is ``None`` for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    body = rest[:int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    response = fields["warc-type"] == "response"
    number = lambda name: int(fields[name]) if fields.get(name, "").strip() else None
    return {"page_id": number("x-page-id"), "type": fields["warc-type"], "digest": fields["warc-payload-digest"].removeprefix("sha256:"),
            "size": size, "refers_to": number("x-refers-to-page-id"), "url": fields.get("warc-target-uri"), "payload": payload if response else None}


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, block: int = 500, level: int = 4) -> DataFrame:
    """Write archives and index below ``folder`` (a path that executors can reach; by default in the scratch folder) and
    return the directory."""
    spark = prepare(pages)
    scratch = Scratch(spark, "warc")
    folder = folder or scratch.path("archives")
    rows = captures(pages, min_bytes, scratch).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        archive = index = None
        at = index_at = 0
        lines: list[str] = []
        directory: list[tuple] = []

        def close_block() -> None:
            nonlocal index_at, lines
            packed = zlib.compress("\n".join(lines).encode(), 6)
            index.write(packed)
            first, last = json.loads(lines[0]), json.loads(lines[-1])
            directory.append((first[0], last[0], len(lines), f"{name}.cdx", index_at, len(packed), f"{name}.warc.gz", first[2], last[2] + last[3] - first[2]))
            index_at += len(packed)
            lines = []

        for batch in batches:
            if archive is None and batch.num_rows:
                archive, index = (store.open_output_stream(f"{path}/{name}.{end}", compression=None) for end in ("warc.gz", "cdx"))
            for key, page_id, url, html, digest, refers_to in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "url", "html", "digest", "refers_to"))):
                packer = zlib.compressobj(level, wbits=31)
                packed = packer.compress(record(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                archive.write(packed)
                lines.append(json.dumps([key, page_id, at, len(packed), digest]))
                at += len(packed)
                if len(lines) == block:
                    close_block()
        if archive is not None:
            if lines:
                close_block()
            archive.close()
            index.close()
            schema = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (c.split() for c in DIRECTORY.split(", "))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*directory), schema)], schema=schema)

    directory, _ = scratch.save(rows.mapInArrow(run, DIRECTORY), "directory")
    return directory.withColumn("folder", F.lit(folder))


def _ranged(store: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)


def _block(store: fs.FileSystem, path: str, row: dict) -> list[list]:
    packed = _ranged(store, f"{path}/{row['index_file']}", row["index_offset"], row["index_length"])
    return [json.loads(line) for line in zlib.decompress(packed).decode().split("\n")]


def read(directory: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records, through the index: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if
    asked for, ``payload``. The digest of a response is computed from what was read and compared with the header."""
    prepare(directory)
    columns = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["folder"])
                raw = _ranged(store, f"{path}/{row['archive']}", row["archive_offset"], row["archive_length"])
                out = []
                for _, _, offset, length, _ in _block(store, path, row):
                    at = offset - row["archive_offset"]
                    got = parse(zlib.decompress(raw[at:at + length], wbits=31))
                    if got["payload"] is not None and hashlib.sha256(got["payload"]).hexdigest() != got["digest"]:
                        raise ValueError(f"payload of page {got['page_id']} does not match its digest")
                    out.append((got["page_id"], got["url"], got["size"], got["digest"], got["type"], got["refers_to"], got["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types[:6 + with_payload])],
                                                 names=[c.split()[0] for c in columns.split(", ")])

    # The directory is tiny, what is read through it is not: the number of tasks follows the archive bytes.
    wanted = directory.agg(F.sum("archive_length")).first()[0] or 0
    return directory.repartition(tasks_for(wanted, TASK_BYTES), "index_file", "index_offset").mapInArrow(run, columns)


def lookup(directory: DataFrame, keys: list[str]) -> list[dict]:
    """Records of few URL keys, in order of the keys: the directory rows that may hold them, bisection in the block, one
    range read per record."""
    found = []
    for key in keys:
        rows = directory.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "index_file", "index_offset").collect()
        for row in rows:
            store, path = fs.FileSystem.from_uri(row["folder"])
            lines = _block(store, path, row.asDict())
            for k in range(bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                if lines[k][0] != key:
                    break
                found.append(parse(zlib.decompress(_ranged(store, f"{path}/{row['archive']}", lines[k][2], lines[k][3]), wbits=31)))
    return found
