"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words.

``fit`` counts words per language in a bounded sample of labelled documents (``docs_per_language`` is the expected
number per language; the sampling rate follows from full counts) and derives the n-gram counts from the word counts.
``predict`` scores every word of every whole text: a known word by the log of its smoothed per-language relative
frequency, an unseen one by the mean log frequency of its longest character n-grams of which at least one is known.
Tasks hold the model as sorted 64-bit keys and one matrix of scores (``Scorer``), not as dictionaries of strings.

Defined results: null text, no letter at all or an empty model give ``und`` with score 0; ties go to the language that
sorts first; repeated rows are scored each on their own; rows with null ``lang`` or null ``doc_id`` teach nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symlake.llm.arrays import release, releasing
from symlake.llm.session import Scratch, prepare

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST_GRAM = 5


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


#: Odd multipliers, one per place of a character n-gram.
_PLACES = np.random.default_rng(23).integers(0, 1 << 63, LONGEST_GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all windows of ``n`` code points. Two different windows share a key with a chance near 2**-60."""
    count = max(len(codes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += codes[k:k + count].astype(np.uint64) * _PLACES[k]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Keys:
    """Rows of units by their sorted 64-bit keys: 12 bytes a unit instead of a string in a dictionary."""

    keys: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Keys:
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], rows[order])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rows[at], np.int32(-1))


@dataclass
class LanguageModel:
    """Log frequencies: ``words`` and ``grams[n]`` name rows of ``logs``, which has one column per language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    logs: np.ndarray
    floor: float = -10.0

    def scorer(self) -> Scorer:
        """The flat form that tasks work with."""
        def rows(names: dict[str, int]) -> np.ndarray:
            return np.fromiter(names.values(), np.int32, len(names))

        words = Keys.of(np.fromiter(map(word_key, self.words), np.uint64, len(self.words)), rows(self.words))
        grams = {}
        for n in sorted(self.grams, reverse=True):
            codes = code_points("".join(self.grams[n]))
            grams[n] = Keys.of(gram_keys(codes, n)[::n], rows(self.grams[n]))
        every = np.vstack([self.logs, np.full((1, len(self.languages)), self.floor, np.float32)])
        return Scorer(self.languages, words, grams, every)

    def score(self, text: str | None) -> tuple[str, float]:
        return self.scorer().score(text)


@dataclass
class Scorer:
    """A model as flat arrays: sorted keys of the words and of the n-grams of each length (longest first), and the
    scores by row, the last of which stands for a word of which nothing is known."""

    languages: list[str]
    words: Keys
    grams: dict[int, Keys]
    logs: np.ndarray
    remembered: int = 150_000
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_rows": {}, "_table": None}

    def forget(self) -> None:
        """Give back the memory of what was remembered: a worker may wait for its next task for long."""
        self._rows, self._table = {}, None
        release()

    def means(self, words: list[str]) -> np.ndarray:
        """Scores of words: their own, or the mean of the longest n-grams of which at least one is known."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        own = self.words.find(np.fromiter(map(word_key, words), np.uint64, len(words)))
        out[own >= 0] = self.logs[own[own >= 0]]
        left = np.flatnonzero(own < 0)
        for n, keys in self.grams.items():
            if not len(left):
                return out
            padded = [f"<{words[k]}>" for k in left.tolist()]
            sizes = np.fromiter(map(len, padded), np.int64, len(padded))
            windows = np.maximum(sizes - n + 1, 0)
            # The windows of each word on its own: those that reach into the next word are left out.
            at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            owner = np.repeat(np.arange(len(left)), windows)
            found = keys.find(gram_keys(code_points("".join(padded)), n)[at])
            owner, found = owner[found >= 0], found[found >= 0]
            if not len(found):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            out[left[owner[first]]] = np.add.reduceat(self.logs[found], first) / count[:, None]
            left = np.delete(left, owner[first])
        out[left] = self.logs[-1]
        return out

    def _learn(self, words: list[str]) -> None:
        """Remember the scores of words not met before, all words at once."""
        first = len(self._rows)
        while first + len(words) > len(self._table):
            self._table = np.concatenate([self._table, np.empty_like(self._table)])
        self._table[first:first + len(words)] = self.means(words)
        self._rows.update(zip(words, range(first, first + len(words))))

    def score(self, text: str | None) -> tuple[str, float]:
        """The most likely language of a whole text and its posterior probability under equal priors."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        words = WORD.findall(normal(text))
        if not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if self._table is None or len(self._rows) > self.remembered:
            # What was remembered is only a speed-up: it starts anew when full.
            self._rows, self._table = {}, np.empty((4096, len(self.languages)), np.float32)
        if new := set(words).difference(self._rows):
            self._learn(sorted(new))
        total = self._table[list(map(self._rows.__getitem__, words))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def learned_from(doc_id: str = "doc_id") -> F.Column:
    """The rows that may teach; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit(docs: DataFrame, docs_per_language: int = 2000, max_words: int = 50_000, max_grams: int = 20_000) -> LanguageModel:
    """Learn from ``text`` and ``lang``. The model holds at most ``max_words`` words and ``max_grams`` n-grams of each
    length 1 to 5 for each language (the most frequent ones), so what reaches the driver is bounded by parameters. What
    is kept for one language has its counts in all of them."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_from())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    rate = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = labelled.filter(share < rate[F.col("lang")]).select("lang", "text")
    spark = prepare(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for w in WORD.findall(normal(text)):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                 pa.array(seen.values(), pa.int64())], names=["lang", "unit", "n"])

    words = sample.mapInArrow(releasing(count), "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit("<"), F.col("unit"), F.lit(">"))
    length = F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM)))
    pieces = (words.select("lang", "n", padded.alias("p"), length.alias("size")).filter(F.length("p") >= F.col("size"))
              .select("lang", "n", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - F.col("size") + 1),
                                                                 lambda i: F.col("p").substr(i, F.col("size")))).alias("unit")))
    counted = pieces.groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")).unionByName(words.withColumn("size", F.lit(0)))
    counted, _ = Scratch(spark, "language").save(counted, "counts")
    languages = sorted(sizes)
    column = {lang: i for i, lang in enumerate(languages)}
    totals = np.ones((LONGEST_GRAM + 1, len(languages)))
    for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect():
        totals[r["size"], column[r["lang"]]] = r["total"] + 1
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "unit"))
    top = F.col("rank") <= F.when(F.col("size") == 0, max_words).otherwise(max_grams)
    # One row per unit, with a column of counts per language.
    units = (counted.withColumn("rank", rank).groupBy("size", "unit")
             .agg(F.max(top).alias("kept"), *[F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for lang, i in column.items()])
             .filter("kept").drop("kept").toArrow().sort_by("size"))
    of = units["size"].to_numpy()
    first = np.searchsorted(of, np.arange(LONGEST_GRAM + 2))
    counts = np.stack([units[f"n{i}"].fill_null(0).to_numpy() for i in range(len(languages))], axis=1)
    logs = (np.log(counts + 0.1) - np.log(totals[of])).astype(np.float32)
    placed = {n: dict(zip(units["unit"][first[n]:first[n + 1]].to_pylist(), range(first[n], first[n + 1]))) for n in range(LONGEST_GRAM + 1)}
    return LanguageModel(languages, placed[0], {n: placed[n] for n in range(1, LONGEST_GRAM + 1)}, logs)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text and nothing else."""
    shared = prepare(docs).sparkContext.broadcast(model.scorer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])
        shared.value.forget()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.0) -> DataFrame:
    """The rows whose language is known with at least ``min_score``; all columns stay as they are. Rows without text or
    without a letter go."""
    shared = prepare(docs).sparkContext.broadcast(model.scorer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch["text"]]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in found], pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(run, docs.schema)
