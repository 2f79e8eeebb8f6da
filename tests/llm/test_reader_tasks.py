"""What is read by range is dealt by its bytes, whatever adaptive execution makes of the few rows that name it."""

import pyarrow as pa

from symlake.llm import arrays, minhash, session, shards, warc


def test_task_counts():
    assert [session.tasks_for(n, 10) for n in (0, 1, 10, 11, 1000)] == [1, 1, 1, 2, 100]


def test_archives_are_read_by_several_tasks(spark, sf, monkeypatch):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    where = warc.write(pages, block=4)
    size = where.agg({"archive_length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "TASK_BYTES", -(-size // 6))
    assert warc.read(where).rdd.getNumPartitions() == 6
    assert warc.read(where).count() == pages.count()


def test_shards_are_read_by_several_tasks(spark, monkeypatch):
    manifest = spark.createDataFrame([(k, f"f{k}", 16 * k, 16, 64, "/nowhere") for k in range(8)],
                                     "shard long, file string, first_slot long, n_rows long, length int, folder string")
    monkeypatch.setattr(shards, "TASK_BYTES", 2 * 64 * 16)
    assert shards.read(manifest, chunk=4).rdd.getNumPartitions() == 8


def test_pieces_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "", "b" * 50, "c", "d" * 9])], names=["n", "text"])
    parts = list(arrays.pieces(batch, limit=12))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 2
    assert list(arrays.pieces(batch.slice(0, 0))) == []
    assert minhash.TASK_ROWS == 500_000
