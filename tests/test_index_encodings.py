"""Files that are no UTF-8 are indexed like any other."""

from pyspark.sql import functions as F

from symlake import model as m
from symlake.operators.index import as_text, index_entries


def test_undecodable_bytes_become_replacement_characters(spark):
    cases = [b"", b"plain", "n\u00e4h".encode(), b"n\xe4h", b"\xff\xfe", b"cut \xc3", None]
    got = spark.createDataFrame(list(enumerate(cases)), "i int, content binary").select("i", as_text(F.col("content")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: None if c is None else c.decode("utf-8", "replace") for i, c in enumerate(cases)}


def test_a_latin_1_file_does_not_end_the_index(spark):
    rows = [("/x.jar", "/x.jar", "jar", name, "", False, len(data), 0, data, None) for name, data in (
        ("good.txt", b"good"), ("bad.txt", "n\u00e4h".encode("latin-1")),
        ("bad.xml", '<beans><bean class="a.B" name="\u00e4"/></beans>'.encode("latin-1")))]
    found = index_entries(spark.createDataFrame(rows, m.ENTRIES))
    assert {r["text"] for r in found["texts"].collect()} == {"good", "n\ufffdh"}
    posted = {(r["entry_path"], r["key"]) for r in found["postings"].filter(F.col("index_name") == m.TYPE_REFERENCES).collect()}
    assert ("bad.xml", "a/B") in posted
