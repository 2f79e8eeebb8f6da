"""Every character of a long candidate is read."""

import pytest

from symlake.llm import secret_scan
from tests.llm.cases import empty_docs
from tests.llm.test_secret_labels import keys


@pytest.mark.parametrize("size", [16, 48, 49, 64, 65, 200, 1001])
def test_parts_cover_every_character(size):
    text = "  " + "a1" * size
    read = list(secret_scan.parts(text, 2, 2 + size))
    assert {i for a, b in read for i in range(a, b)} == set(range(2, 2 + size))
    assert all(0 < b - a <= secret_scan.BODY for a, b in read)


def test_secrets_in_the_middle_of_long_runs_are_found_and_redacted(spark, monkeypatch):
    model = secret_scan.train(empty_docs(spark))
    texts = [f"see //git.example.com/team/project/raw/main/{key}/some/file/x/y.txt now" for key in keys(60, 4)]
    found = model.find(texts)
    assert sum([s[0] for s in spans] == ["model"] for spans in found) >= 57
    assert model.find(["see //git.example.com/team/project/raw/main/branch7/some/file/x/y.txt now"]) == [[]]
    monkeypatch.setattr(secret_scan, "CHUNK", 5)
    assert [[s[:3] for s in spans] for spans in model.find(texts)] == [[s[:3] for s in spans] for spans in found]
