"""Secret scanning: rule spans, and a small character convolutional network over every candidate and its context.

Candidates are the rule matches and all long runs of token characters with a digit (or long mixed-case ones). Each is
read with ``CONTEXT`` characters on both sides, a long one in overlapping windows and piece by piece, so that every
character is read; its probability is the largest of them. The network (one convolution over characters, maximum over places, one
output) is trained in numpy on labelled findings: rule matches (secrets) and look-alikes of a known form of all
documents, plus generated secrets and look-alikes with known labels. A candidate that neither a rule nor such
a form covers has no label and teaches nothing: it is what the network is asked about. A held-out part calibrates its
output to probabilities (Platt) and sets, per shape of candidate, the highest threshold that keeps the wanted recall, one half at least.

Rule spans always stay; the network adds spans of kind ``model`` that overlap none of them.

Defined results: null text counts as empty and has no spans; repeated rows are scanned each on their own; with no
documents at all the network learns from generated findings alone.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.arrays import pieces, releasing
from symlake.llm.session import Scratch, prepare, tasks_for

#: Rules (fixed patterns). Letters of the first one in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = {"assign": 0, "access": 1, "hex": 2, "model": 3}
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

#: Candidates that are certainly none: numbers, UUIDs, times, and words (also joined as in ``CamelCase``) with or without
#: a number at their end, between separators. Random keys of 16 characters or more do not come in these forms.
_PIECE = r"(?:[0-9]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]{0,4}|(?:[A-Z]{2,5}|[A-Za-z])[0-9]{0,4})"
LOOK_ALIKE = re.compile(rf"[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2,6}}Z?|[/._=+-]*{_PIECE}(?:[/._=+-]+{_PIECE})*[/._=+-]*")

PART = re.compile(r"[^/.=]+")

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
CONTEXT = 16
#: Characters of a candidate in one window, and how far the windows of a longer one are apart: any 33 characters that
#: follow each other stand in one window.
BODY, STRIDE = 48, 16
LENGTH = 2 * CONTEXT + BODY
#: Windows scored at a time.
CHUNK = 4096
#: Symbols 0-127: context, 128-255: inside the candidate; character 1 stands for all outside ASCII, 0 for nothing.
SYMBOLS = 256
SHAPES = ("hex", "upper", "mixed")


def rule_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[str, int, int]]:
    """Rule matches by start, then kind. ``runs``: the long runs of the text, if known (without one, no text holds a
    long key)."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if runs is None or runs:
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS[s[0]]))


def candidates(runs: list[re.Match]) -> list[tuple[int, int]]:
    """Runs that may be a secret, without points and dashes at their ends."""
    out = []
    for m in runs:
        body = m[0].strip(".-_")
        if len(body) < 16:
            continue
        digit = any(c.isdigit() for c in body)
        if digit or (len(body) >= 24 and not body.islower() and not body.isupper()):
            start = m.start() + m[0].index(body)
            out.append((start, start + len(body)))
    return out


def known_look_alike(body: str) -> bool:
    return LOOK_ALIKE.fullmatch(body) is not None


def shape(body: str) -> int:
    if all(c in "0123456789abcdef" for c in body):
        return 0
    return 1 if not any(c.islower() for c in body) else 2


def parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What is read of a candidate, ``BODY`` characters at most each: all of a short one; of a longer one windows that
    overlap, and the pieces between its separators that may be a secret of their own."""
    if end - start <= BODY:
        yield start, end
        return
    for a in range(start, end - BODY, STRIDE):
        yield a, a + BODY
    yield end - BODY, end
    for m in PART.finditer(text, start, end):
        if 16 <= m.end() - m.start() <= BODY:
            yield m.start(), m.end()


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a part of a candidate and its surroundings."""
    out = np.zeros(LENGTH, np.int64)
    body = text[start:end]
    left, right = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    codes = lambda s, base: np.array([base + (ord(c) if ord(c) < 128 else 1) for c in s], np.int64)
    out[CONTEXT - len(left):CONTEXT] = codes(left, 0)
    out[CONTEXT:CONTEXT + len(body)] = codes(body, 128)
    out[CONTEXT + len(body):CONTEXT + len(body) + len(right)] = codes(right, 0)
    return out


def _char_classes() -> np.ndarray:
    groups = [string.digits, "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", ".", "=:", "\"'", " ", "\n\r\t"]
    table = np.full(128, len(groups) + 1)
    table[0] = 0
    for k, g in enumerate(groups, 1):
        table[[ord(c) for c in g]] = k
    return np.concatenate([table, table + len(groups) + 2])


@dataclass
class CharacterNetwork:
    """Convolution weights per place and symbol; the weights of a symbol are its own plus its character class's."""

    own: np.ndarray      # width x SYMBOLS x filters
    shared: np.ndarray   # width x classes x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, width: int, filters: int, rng: np.random.Generator) -> CharacterNetwork:
        classes = int(_char_classes().max()) + 1
        return cls(np.zeros((width, SYMBOLS, filters)), rng.normal(0, 0.3, (width, classes, filters)), np.zeros(filters),
                   rng.normal(0, 0.3, filters), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, the pooled values and where each maximum stands."""
        weights = self.own + self.shared[:, _char_classes()]
        width = len(weights)
        steps = x.shape[1] - width + 1
        z = np.zeros((len(x), steps, len(self.bias)), np.float32)
        for k in range(width):
            z += weights[k].astype(np.float32)[x[:, k:k + steps]]
        at = z.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias, 0)
        return pooled @ self.out + self.out_bias, pooled, at

    def logits(self, x: np.ndarray, chunk: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + chunk])[0] for i in range(0, len(x), chunk)]) if len(x) else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the logistic loss; only the places of the maxima carry gradients."""
        names = ("own", "shared", "bias", "out")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        classes, step = _char_classes(), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i:i + batch]
                logit, pooled, at = self.forward(x[rows])
                error = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
                back = error[:, None] * self.out * (pooled > 0)
                grad = {n: np.zeros_like(getattr(self, n)) for n in names}
                grad["out"], grad["bias"] = pooled.T @ error, back.sum(axis=0)
                filters = np.broadcast_to(np.arange(len(self.bias)), at.shape)
                for k in range(len(self.own)):
                    symbols = np.take_along_axis(x[rows], at + k, 1)
                    np.add.at(grad["own"][k], (symbols, filters), back)
                    np.add.at(grad["shared"][k], (classes[symbols], filters), back)
                grad["own"] += 1e-4 * self.own
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grad[n]
                    second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8))
                self.out_bias -= rate * float(error.sum())


@dataclass
class SecretModel:
    network: CharacterNetwork
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(x) + self.offset, -50, 50)))

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """All spans of every text by start, then kind."""
        found = []
        for text in texts:
            text = text or ""
            runs = list(RUN.finditer(text))
            rules = rule_spans(text, runs)
            rows = list(rules)
            taken = sorted((a, b) for _, a, b in rules)
            for a, b in candidates(runs):
                if not any(lo < b and a < hi for lo, hi in taken):
                    rows.append(("model", a, b))
            found.append(rows)
        scores = self._largest((text or "", a, b) for text, rows in zip(texts, found) for _, a, b in rows)
        limit = dict(zip(SHAPES, self.thresholds))
        out = []
        for text, rows in zip(texts, found):
            kept = []
            for kind, a, b in rows:
                best = next(scores)
                if kind != "model" or any(p >= limit[s] for s, p in best.items()):
                    kept.append((kind, a, b, max(best.values())))
            out.append(sorted(kept, key=lambda r: (r[1], KINDS[r[0]])))
        return out

    def _largest(self, spans: Iterable[tuple[str, int, int]]) -> Iterator[dict[str, float]]:
        """For every span the largest probability of its parts of each shape; a bounded number of windows at a time."""
        best: dict[int, dict[str, float]] = {}
        held: list[tuple[int, str]] = []
        windows: list[np.ndarray] = []
        n = given = 0

        def flush() -> None:
            for (k, s), p in zip(held, self.probabilities(np.array(windows)).tolist() if windows else ()):
                best[k][s] = max(p, best[k].get(s, 0.0))
            held.clear()
            windows.clear()

        for n, (text, start, end) in enumerate(spans, 1):
            best[n - 1] = {}
            for a, b in parts(text, start, end):
                held.append((n - 1, SHAPES[shape(text[a:b])]))
                windows.append(window(text, a, b))
                if len(windows) == CHUNK:
                    flush()
            if not windows:
                while given < n:
                    yield best.pop(given)
                    given += 1
        flush()
        while given < n:
            yield best.pop(given)
            given += 1


def generated_findings(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up secrets (1) and look-alikes (0) in made-up sentences, labelled by construction."""
    letters, digits = string.ascii_letters, string.digits
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 9)))
    size = lambda a, b: int(rng.integers(a, b))
    secrets = [
        lambda: pick(letters + digits + "+/", size(32, 48)), lambda: pick(letters + digits, size(20, 44)),
        lambda: "ghp_" + pick(letters + digits, 36), lambda: "sk-" + pick(letters + digits, size(32, 48)),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(letters + digits, 24), lambda: pick("0123456789abcdef", size(24, 64)),
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16), lambda: "AIza" + pick(letters + digits + "_-", 35),
    ]
    others = [
        lambda: pick(digits, size(16, 24)), lambda: word() + pick(digits, 1) + "." + word() + "." + word() + "." + word(),
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(4)) + pick(digits, 2),
        lambda: f"20{pick(digits, 2)}-0{pick(digits, 1)}-1{pick(digits, 1)}T{pick(digits, 2)}", lambda: "_".join(word() for _ in range(4)) + pick(digits, 1),
        lambda: "".join(word().title() for _ in range(4)) + pick(digits, 1), lambda: ".".join(pick(digits, 3) for _ in range(5)),
        lambda: "=" * size(16, 30) + "1", lambda: "".join(word() for _ in range(4)) + pick(digits, 2),
    ]
    x, y = [], []
    for i in range(n):
        good = i % 2
        make = secrets if good else others
        body = make[int(rng.integers(len(make)))]()
        before = " ".join(word() for _ in range(4)) + (rng.choice([" key ", " ", ": ", ' "', "="]) if good else rng.choice([" ", ": ", " see ", "\n"]))
        after = rng.choice([" ", "\n", '" ', ". ", ", "]) + " ".join(word() for _ in range(3))
        deep = i % 8 > 5
        if deep:
            # Inside a long path: of its parts one that shows the body, or enough of it.
            before += f"//{word()}.{word()}/" + "".join(word() + "/" for _ in range(5))
            after = "".join("/" + word() for _ in range(5)) + after
        text = before + body + after
        lo, hi = len(before), len(before) + len(body)
        if deep:
            run = next(m for m in RUN.finditer(text) if m.start() < hi and lo < m.end())
            shown = [(a, b) for a, b in parts(text, run.start(), run.end()) if min(b, hi) - max(a, lo) >= min(16, hi - lo)]
        else:
            shown = list(parts(text, lo, hi))
        a, b = shown[int(rng.integers(len(shown)))]
        x.append(window(text, a, b))
        y.append(good)
    return np.array(x), np.array(y, np.float64)


def train(docs: DataFrame, findings: int = 3000, generated: int = 2000, recall: float = 0.98, seed: int = 5) -> SecretModel:
    """Fit on all distinct labelled findings of all documents and ``generated`` made-up ones. Candidates without a label
    stay out. Up to ``findings`` of each label are fitted in one place; where there are more, that fit is only the start,
    tasks go on from it over all findings (``fit_on_all``), and those held out of all calibrate and set the thresholds."""
    texts = docs.select("text").filter(F.col("text").isNotNull())
    prepare(docs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                runs = list(RUN.finditer(text))
                rules = rule_spans(text, runs)
                rows += [(1, window(text, *p)) for _, a, b in rules for p in parts(text, a, b)]
                rows += [(0, window(text, *p)) for a, b in candidates(runs) for p in parts(text, a, b)
                         if known_look_alike(text[a:b]) and not any(lo < b and a < hi for _, lo, hi in rules)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.uint8).tobytes() for r in rows], pa.binary())],
                                             names=["label", "seen"])

    # Copies of a window count once; one that a rule covers anywhere is a secret.
    seen, n, notes = Scratch(docs.sparkSession, "findings").save_noting(
        texts.mapInArrow(releasing(label), "label int, seen binary").groupBy("seen").agg(F.max("label").alias("label")), "seen", {"secrets": F.sum("label")})
    secrets = notes["secrets"] or 0
    many = secrets > findings or n - secrets > findings
    apart = F.pmod(F.xxhash64("seen", F.lit(seed)), F.lit(4)) == 0
    learned = seen.filter(~apart) if many else seen
    rng = np.random.default_rng(seed)
    x, y = generated_findings(generated, rng)
    for value in (1, 0):
        rows = learned.filter(F.col("label") == value).orderBy(F.xxhash64("seen"), "seen").limit(findings).select("seen").toArrow()["seen"].to_pylist()
        if rows:
            x = np.concatenate([x, np.array([np.frombuffer(r, np.uint8) for r in rows], np.int64)])
            y = np.concatenate([y, np.full(len(rows), float(value))])
    # Distinct windows only, so none is on both sides of the split.
    _, first = np.unique(x, axis=0, return_index=True)
    order = rng.permutation(first)
    x, y = x[order], y[order]
    network = CharacterNetwork.fresh(5, 24, rng)
    held = len(x) // 4
    network.train(x[held:], y[held:], rng)
    inside = [body_of(r) for r in x[:held]]
    logits, labels, weights = network.logits(x[:held]), y[:held], np.ones(held)
    shapes = np.array([shape(b) for b in inside])
    if many:
        made = generated_findings(generated, np.random.default_rng(seed + 1))
        network = fit_on_all(learned, network, tasks_for(n, FITTED), made, seed)
        # Of the windows fitted in one place none is held out here: they were chosen among those that are learned.
        logits, labels, weights, shapes = held_out(seen.filter(apart), network)
    slope, offset = platt(logits, labels, weights)
    model = SecretModel(network, slope, offset, (0.5,) * len(SHAPES))
    p = 1 / (1 + np.exp(-np.clip(slope * logits + offset, -50, 50)))
    whole = threshold(p, labels, recall, weights)
    limits = []
    for s in range(len(SHAPES)):
        own = shapes == s
        enough = weights[own & (labels == 1)].sum() >= 20
        limits.append(threshold(p[own], labels[own], recall, weights[own]) if enough else whole)
    model.thresholds = tuple(limits)
    return model


#: Findings that one task fits, and how often all of them are gone through and their networks averaged.
FITTED, ROUNDS = 20_000, 2


def body_of(x: np.ndarray) -> str:
    """The characters of the candidate in a window."""
    return bytes((x[x >= 128] - 128).astype(np.uint8)).decode("ascii")


def _windows(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), LENGTH).astype(np.int64)


def fit_on_all(seen: DataFrame, network: CharacterNetwork, tasks: int, made: tuple[np.ndarray, np.ndarray], seed: int) -> CharacterNetwork:
    """``network`` trained on over all rows of ``seen(seen, label)``: each task goes on over its share and the made-up
    findings, and the networks are averaged by the rows they saw (local gradient descent), ``ROUNDS`` times."""
    names = ("own", "shared", "bias", "out")
    dealt = seen.repartition(tasks, "seen").sortWithinPartitions("seen")
    for turn in range(ROUNDS):
        shared = seen.sparkSession.sparkContext.broadcast((network, made))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, labels = [], []
            for batch in batches:
                held += batch["seen"].to_pylist()
                labels += batch["label"].to_pylist()
            if not held:
                return
            start, (made_x, made_y) = shared.value
            net = CharacterNetwork(*[getattr(start, k).copy() for k in names], start.out_bias)
            net.train(np.concatenate([_windows(held), made_x]), np.concatenate([np.array(labels, np.float64), made_y]),
                      np.random.default_rng(seed + turn), epochs=2, rate=0.003)
            flat = np.concatenate([*[getattr(net, k).ravel() for k in names], [net.out_bias]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * len(held)), pa.array(np.full(len(flat), float(len(held))))],
                                             names=["at", "value", "weight"])

        parts_of = dealt.mapInArrow(releasing(fit), "at int, value double, weight double")
        flat = parts_of.groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).orderBy("at").toArrow()["value"].to_numpy()
        shared.unpersist()
        ends = np.cumsum([getattr(network, k).size for k in names])
        fields = [v.reshape(getattr(network, k).shape) for k, v in zip(names, np.split(flat[:-1], ends[:-1]))]
        network = CharacterNetwork(*fields, float(flat[-1]))
    return network


def held_out(seen: DataFrame, network: CharacterNetwork) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits (to 3 places), labels, numbers and shapes of all rows of ``seen(seen, label)``, equal ones counted together."""
    shared = seen.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _windows(batch["seen"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.round(shared.value.logits(x).astype(np.float64), 3)), batch["label"],
                                                  pa.array([shape(body_of(r)) for r in x], pa.int32())], names=["logit", "label", "shape"])

    found = seen.select("seen", "label").mapInArrow(releasing(score), "logit double, label int, shape int").groupBy("logit", "label", "shape").count()
    table = found.orderBy("logit", "label", "shape").toArrow()
    return tuple(table[c].to_numpy().astype(t) for c, t in (("logit", float), ("label", float), ("count", float), ("shape", int)))


def platt(logits: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities, by Newton steps with a weak prior towards (1, 0)."""
    n = np.ones(len(y)) if weights is None else weights
    w = np.array([1.0, 0.0])
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (n * (p - y)) + 0.1 * (w - [1.0, 0.0])
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def threshold(p: np.ndarray, y: np.ndarray, recall: float, weights: np.ndarray | None = None) -> float:
    """A threshold that finds at least ``recall`` of the labelled secrets and lets no look-alike through that a higher
    one of that recall would stop: halfway down to the next look-alike. 0.5 at least: what is less likely than not is
    never added."""
    n = np.ones(len(p)) if weights is None else weights
    order = np.argsort(p[y == 1], kind="stable")
    good, number = p[y == 1][order], n[y == 1][order]
    if not len(good):
        return 0.5
    high = float(good[np.searchsorted(np.cumsum(number), int((1 - recall) * number.sum()), side="right")])
    below = p[(y == 0) & (p < high)]
    return max(0.5, (high + float(below.max(initial=0.0))) / 2)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """``doc_id, spans`` for every row: kind, start and end (code points, end exclusive) and the network's probability."""
    shared = prepare(docs).sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(pieces, batches)):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in shared.value.find(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {id_type}, spans {SPANS}")


def redact(docs: DataFrame, model: SecretModel, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``; no row goes, all columns stay, and
    ``n_chars`` (if there) follows the new text. Rows without a span stay as they are."""
    shared = prepare(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(pieces, batches)):
            texts = batch["text"].to_pylist()
            new, changed = list(texts), []
            for k, spans in enumerate(shared.value.find(texts)):
                if spans:
                    new[k] = masked(texts[k], [(a, b) for _, a, b, _ in spans], mark)
                    changed.append(k)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                sizes = columns["n_chars"].to_pylist()
                for k in changed:
                    sizes[k] = len(new[k])
                columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(releasing(run), docs.schema)


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
