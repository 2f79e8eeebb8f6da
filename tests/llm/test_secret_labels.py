"""Keys that the corpus holds in numbers but no rule covers are no look-alikes."""

import string

import numpy as np

from symlake.llm import secret_scan

CHARS = list(string.ascii_letters + string.digits)


def keys(n, seed):
    rng = np.random.default_rng(seed)
    return ["ghp_" + "".join(rng.choice(CHARS, 36)) for _ in range(n)]


def test_bare_keys_of_the_corpus_are_not_learned_as_look_alikes(spark):
    rows = [(k, f"pushed by {key} from host build{k}.internal.example.com") for k, key in enumerate(keys(1500, 1))]
    model = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    found = model.find([f"pushed by {key} from there" for key in keys(200, 2)])
    assert sum([s[0] for s in spans] == ["model"] for spans in found) >= 190
    assert model.find(["from host build7.internal.example.com"]) == [[]]


def test_only_known_forms_are_look_alikes():
    known = secret_scan.known_look_alike
    assert all(map(known, ["1234567890123456", "mail5.example.company.com", "123e4567-e89b-12d3-a456-426614174000", "src/main/java/File12"]))
    assert not any(map(known, keys(300, 3)))


def test_copies_of_one_window_count_once(spark, monkeypatch):
    seen = []
    fit = secret_scan.CharacterNetwork.train
    monkeypatch.setattr(secret_scan.CharacterNetwork, "train", lambda self, x, y, rng: (seen.append(x), fit(self, x, y, rng, epochs=1)))
    copies = [(k, "at mail5.example.company.com please") for k in range(500)]
    others = [(1000 + k, f"see file {k} at host{k % 10}.example.company.org now") for k in range(100)]
    secret_scan.train(spark.createDataFrame(copies + others, "doc_id long, text string"), findings=50, generated=40)
    x = seen[0]
    assert len(np.unique(x, axis=0)) == len(x)


def test_all_findings_of_all_documents_teach_and_calibrate(spark, monkeypatch):
    numbers = []
    fit = secret_scan.platt
    monkeypatch.setattr(secret_scan, "platt", lambda logits, y, weights=None: (numbers.append(weights), fit(logits, y, weights))[1])
    rows = [(k, f"token={key} at host{k}.example.company.org") for k, key in enumerate(keys(800, 6))]
    model = secret_scan.train(spark.createDataFrame(rows, "doc_id long, text string"), findings=50, generated=400)
    # A quarter of 800 secrets and 800 look-alikes; 50 of each label would leave a quarter of 500 at most.
    assert numbers[0] is not None and 300 < numbers[0].sum() < 500
    assert all(t >= 0.5 for t in model.thresholds)
    found = model.find([f"pushed by {key} from there" for key in keys(100, 7)])
    assert sum([s[0] for s in spans] == ["model"] for spans in found) >= 80
