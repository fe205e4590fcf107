"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, with exception phrases and scores normalised by length.

Folding lower-cases, drops accents and zero-width characters, maps homoglyphs to Latin letters, reads digits and signs
inside words as the letters they stand for, and leaves words with single spaces between them. The lexicon is learned from
labelled documents: whole words and word beginnings whose documents are toxic far more often than chance. Of the terms that
match one word the heaviest counts. A term in an exception phrase, a word pair that labelled clean documents have and
toxic ones don't, doesn't count. A document's summed weight by the root of its length and its heaviest term go through a
logistic curve fitted to the same labels, so scores are probabilities.

Learning uses at most about MAX_LABELLED labelled documents, drawn by a hash of doc_id; that bounds the lexicon's cost
however many labels there are. The model is bounded, too: MAX_CANDIDATES terms, those in most toxic documents, are tried, of which the MAX_TERMS with the
greatest weight by logarithm of support stay, and MAX_EXCEPTIONS phrases, those in most clean documents; equal ones go by the alphabet. Scoring reads
every whole text, however long, in time proportional to it, and moves no data.

Null and empty texts score as texts without a hit. Without labels of both kinds every score is the share of toxic labels
(0.5 / 1 without labels). Of several labels of a document the largest counts; null labels don't. Rows with
the same doc_id, or a null one, are scored each for itself. Of other columns, whatever their names, only `keep_clean` returns any: all of them. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, tune

#: Bounds of what the model is fitted on and of what it holds.
MAX_LABELLED = 20_000
MAX_CANDIDATES = 50_000
MAX_TERMS = 2_000
MAX_EXCEPTIONS = 5_000
#: Lengths of word beginnings that may become terms.
STEMS = range(3, 9)

HOMOGLYPHS = str.maketrans(
    "аɑαạсϲԁеєεһіıιјӏκмոоοσрρԛѕтυսѵνωхχуүγʏᴢɡʟʜ",
    "aaaaccdeeehiiijlkmnoooppqstuuvvwxxyyyyzglh",
)
SIGNS = str.maketrans("013457@$!|", "oieastasil")
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457]+(?![^\W_])")
_SPLIT = re.compile(r"[\W_]+")
_HIDDEN = re.compile("[̀-ͯ­​-‏⁠﻿]")


def fold(text: str) -> str:
    """Folded words, each between single spaces: ' word word '."""
    text = text.lower()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text).translate(HOMOGLYPHS))
    text = _SIGN.sub(lambda m: m.group().translate(SIGNS), text)
    return f" {_SPLIT.sub(' ', text).strip()} "


def terms(word: str) -> list[str]:
    """What may become a term: ' word ' as a whole, ' beg' as a beginning."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if n <= len(word))]


@dataclass
class Model:
    """weights: term to log-odds; exceptions: ' word word '; curve: intercept and slopes; base: the score without a curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] | None = None
    base: float = 0.5

    def matcher(self) -> Callable[[str], np.ndarray]:
        """text -> (1, summed weight by root of length, heaviest term)."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t, w in self.weights.items():
            machine.add_word(t, (len(t), w))
        for t in self.exceptions:
            machine.add_word(t, (len(t), None))
        if len(machine):
            machine.make_automaton()

        def features(text: str) -> tuple[float, float, float]:
            folded = fold(text)
            best, spared = {}, []
            if len(machine):
                for end, (n, w) in machine.iter(folded):
                    start = end - n + 1
                    if w is None:
                        spared.append((start, end))
                    elif w > best.get(start, 0):
                        best[start] = w
            for a, b in spared:
                for at in range(a, b):
                    best.pop(at, None)
            total = sum(best.values())
            return 1.0, total / math.sqrt(folded.count(" ") + 20), max(best.values(), default=0.0)

        return features

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(features), self.base)
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.curve), -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _counted(of: Callable[[str], Iterable[str]], limit: int = 200_000):
    """mapInArrow function: (toxic, text) -> (term, toxic documents, clean documents), summed within a batch run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out():
            keys = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))], ["term", "toxic", "clean"])

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                counts[label].update(of(text))
                if len(counts[0]) + len(counts[1]) > limit:
                    yield out()
                    counts = (Counter(), Counter())
        yield out()

    return run


_COUNTS = "term string, toxic long, clean long"


def train(docs: DataFrame, labels: DataFrame, usable, exceptions: Iterable[str] = (), least_share: float = 0.01, least: int = 3, odds: float = 3.0) -> Model:
    """Learn from documents with labels (doc_id, toxic) for which the condition `usable` on doc_id holds."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.where(F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, MAX_LABELLED / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min("text").alias("text"))
    sample = materialize(sample.select("label", "text"), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(base=(n_toxic + 0.5) / (n_toxic + n_clean + 1))

    def all_terms(text: str) -> set[str]:
        return {t for w in set(fold(text).split()) for t in terms(w)}

    total = lambda df: df.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    support = max(least, math.ceil(least_share * n_toxic))
    seen = total(sample.where("label = 1").mapInArrow(_counted(all_terms), _COUNTS)).where(F.col("toxic") >= support)
    candidates = {r["term"]: r["toxic"] for r in seen.orderBy(F.desc("toxic"), "term").limit(MAX_CANDIDATES).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(candidates))
    clean = total(sample.where("label = 0").mapInArrow(_counted(lambda text: all_terms(text) & wanted.value), _COUNTS))
    in_clean = {r["term"]: r["clean"] for r in clean.collect()}
    weights = {t: math.log((k + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, k in candidates.items()}
    kept = sorted((t for t, w in weights.items() if w >= odds), key=lambda t: (-weights[t] * math.log1p(candidates[t]), t))[:MAX_TERMS]
    model = Model({t: weights[t] for t in kept})
    plain = pickle.dumps(model)

    def pairs(text: str) -> set[str]:
        heavy, ws = pickle.loads(plain).weights if not hasattr(pairs, "w") else pairs.w, fold(text).split()
        pairs.w = heavy
        return {f" {x} {y} " for x, y in zip(ws, ws[1:], strict=False) if any(t in heavy for w in (x, y) for t in terms(w))}

    around = total(sample.mapInArrow(_counted(pairs), _COUNTS)).where("clean >= 2 and toxic = 0").orderBy(F.desc("clean"), "term").limit(MAX_EXCEPTIONS)
    model.exceptions = frozenset(r["term"] for r in around.collect()) | {fold(x) for x in exceptions}

    ready = pickle.dumps(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pickle.loads(ready).matcher()
        for b in batches:
            f = [of(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in f], pa.float64()) for i in (1, 2))], ["label", "density", "heaviest"])

    rows = sample.mapInArrow(measure, "label int, density double, heaviest double").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["density"], rows["heaviest"]])
    model.curve = logistic(x, rows["label"].to_numpy(float))
    return model


@functools.lru_cache(maxsize=2)
def _ready(model: bytes) -> tuple[Model, Callable]:
    m = pickle.loads(model)
    return m, m.matcher()


def scores(model: bytes, column: pa.Array) -> np.ndarray:
    m, of = _ready(model)
    return m.score(np.array([of(t) for t in texts_of(column)]).reshape(-1, 3))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    tune(docs.sparkSession)
    data = pickle.dumps(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(data, b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of docs that score below the cut, with all their columns."""
    tune(docs.sparkSession)
    data, at = pickle.dumps(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(data, b.column(at)) < cut))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2
