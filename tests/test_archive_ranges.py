"""Archives read by their directory: any size, several tasks an archive, the entries of ``zipfile``."""

import io
import zipfile

from pyspark.sql import functions as F

from symlake.sources import archives as A


def packed(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def contents(df):
    return {(r["container"].split("/")[-1] if "!/" not in r["container"] else r["container"].split("!/", 1)[1], r["entry_path"]): bytes(r["content"])
            for r in df.filter("NOT is_dir AND content IS NOT NULL").collect()}


def test_entries_equal_those_of_whole_values(spark, tmp_path):
    deep = packed({"x/y.txt": b"deep" * 50, "empty": b""})
    middle = packed({"deep.jar": deep, "m.txt": b"m"}, zipfile.ZIP_STORED)
    for name, method in (("stored.zip", zipfile.ZIP_STORED), ("deflated.war", zipfile.ZIP_DEFLATED), ("other.ear", zipfile.ZIP_BZIP2), ("lz.kar", zipfile.ZIP_LZMA)):
        (tmp_path / name).write_bytes(b"junk before" + packed({"a.txt": b"a" * 999, "é/b.bin": bytes(range(256)), "in/middle.jar": middle, "bad.zip": b"PK"}, method))
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "hollow.zip").write_bytes(packed({}))
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.col("path").alias("container"), F.col("path").alias("root_container"), F.lit(0).alias("depth"), "content")
    for depth in (0, 1, 15):
        got, want = A.read_archives(spark, str(tmp_path), depth), A.expand_archives(whole, depth)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter("depth = 2 AND NOT is_dir").count() == 8


def test_damaged_and_overlong_members_keep_their_row(spark, tmp_path):
    raw = packed({"good.txt": b"good" * 40, "bad.txt": b"bad!" * 40}, zipfile.ZIP_STORED)
    (tmp_path / "a.zip").write_bytes(raw.replace(b"bad!bad!", b"bad!bad?", 1))
    bomb = bytearray(packed({"bomb.txt": b"0" * 100_000}))
    at = bomb.index(b"PK\x01\x02") + 24
    bomb[at:at + 4] = (10).to_bytes(4, "little")  # the directory announces ten bytes
    (tmp_path / "b.zip").write_bytes(bytes(bomb))
    got = {r["entry_path"]: (r["content"], r["error"]) for r in A.read_archives(spark, str(tmp_path)).filter("NOT is_dir").collect()}
    assert got["good.txt"] == (bytearray(b"good" * 40), None)
    assert got["bad.txt"][0] is None and "CRC" in got["bad.txt"][1]
    assert got["bomb.txt"][0] is None and "CRC" in got["bomb.txt"][1]


def test_an_archive_above_two_gibibytes(spark, tmp_path):
    # A stored member, padded by a hole in the file, behind it another: the directory lies above 2 GiB.
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.seek((2 << 30) + 5)
        f.write(packed({"late.txt": b"late", "in.jar": packed({"inner.txt": b"inner"})}, zipfile.ZIP_STORED))
    assert path.stat().st_size > A.LARGEST_VALUE
    got = A.read_archives(spark, str(tmp_path))
    assert contents(got)[("large.zip", "late.txt")] == b"late" and contents(got)[("in.jar", "inner.txt")] == b"inner"
    assert got.filter("error IS NOT NULL").count() == 0


def test_very_many_members_are_dealt_to_several_tasks(spark, tmp_path, n=100_000):
    (tmp_path / "many.jar").write_bytes(packed({f"p{i % 100}/f{i}.txt": str(i).encode() for i in range(n)}, zipfile.ZIP_STORED))
    got = A.read_archives(spark, str(tmp_path), slot_bytes=1 << 20)
    files = got.filter("NOT is_dir").select(F.spark_partition_id().alias("task"), "entry_path", F.col("content").cast("string").alias("text"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"),
                     F.count_if(F.regexp_extract("entry_path", "f([0-9]+)", 1) == F.col("text")).alias("right")).first()
    assert seen["n"] == n and seen["right"] == n and seen["tasks"] > 1
    assert got.filter("is_dir").count() == 100
