"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores edited or paraphrased copies.

Words are maximal runs without ASCII marks and white space, A-Z lower-cased. Every run of three words of an item that
occurs in a document is a seed, however common it is, so a copy is found if any three neighbouring words of it are
intact. Where seeds of an item hit near each other, the words around the hits are aligned with the whole
item: 2 for equal words, -1 for other ones and for gaps. The score is the best local alignment's share of the highest
possible one, 1 for a whole copy; a copy with a fifth of its words replaced scores about 0.7. Places with too few of the
item's words for the least score go without an alignment: no alignment there could reach it.

Items are collected in blocks of at most BLOCK_ITEMS items and matched by scanning documents, once for each block to
count seeds and once to align; documents aren't moved. A block's bytes are bounded by BLOCK_BYTES.

Null and empty items match nothing, nor do null and empty documents. Items with fewer words than a seed are one seed
as a whole. Equal items are matched each for itself; rows with the same doc_id are joined to one result row per item, with
the best score, and of equal scores the first place; rows with a null doc_id are joined alike. Very long documents are read whole; only the words around hits are
aligned. Other columns are ignored, whatever their names, and kept by `keep_uncontaminated`. Either table empty: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import POSITIONS, materialize, mix64, tune

SEED = 3
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

_MARKS = bytes(i for i in range(128) if not chr(i).isalnum())
_TABLE = bytes.maketrans(_MARKS + bytes(range(65, 91)), b" " * len(_MARKS) + bytes(range(97, 123)))


def tokens(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` ids; 0 where the run holds a word that no item has (id 0)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(size):
            part = ids[j : j + n]
            known &= part > 0
            h += mix64(part.astype(np.uint64) * POSITIONS[j] + np.uint64(j))
        h = mix64(h) | np.uint64(1)
    h[~known] = 0
    return h


class Index:
    """A block of items: their words' ids, and their runs, all or only the seeds."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.names = [i for i, _ in items]
        split = [tokens(t) for _, t in items]
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.items = [np.fromiter(map(self.vocabulary.__getitem__, ws), np.int64, len(ws)) for ws in split]
        self.sizes = sorted({min(SEED, len(x)) for x in self.items if len(x)})
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.items):
            for at, h in enumerate(_runs(x, min(SEED, len(x))).tolist() if len(x) else []):
                self.seeds.setdefault(h, []).append((k, at))
        self._sort()

    def _sort(self) -> None:
        self.hashes = np.array(sorted(self.seeds), np.uint64)

    def choose(self, frequency: dict[int, int]) -> None:
        """Keep every run that occurs in a document; the others can't hit."""
        self.seeds = {h: places for h, places in self.seeds.items() if frequency.get(h, 0) > 0}
        self._sort()

    def ids(self, raw: bytes | None) -> np.ndarray:
        ws = tokens(raw)
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in ws], np.int64) if ws else np.zeros(0, np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the runs in a document that are seeds."""
        places, found = [], []
        for size in self.sizes:
            h = _runs(ids, size)
            if size < SEED or len(h):
                some = np.flatnonzero(h)
                if len(some) and len(self.hashes):
                    k = np.searchsorted(self.hashes, h[some]).clip(max=len(self.hashes) - 1)
                    some = some[self.hashes[k] == h[some]]
                    places.append(some)
                    found.append(h[some])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best local alignment as a share of the highest possible score, and where in the window it ends."""
    if not len(item) or not len(window):
        return 0.0, 0
    slope = np.arange(len(window) + 1) * GAP
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        step = row[:-1] + np.where((window == w) & (w > 0), MATCH, MISMATCH)
        new = np.zeros_like(row)
        np.maximum(np.maximum(step, row[1:] + GAP), 0, out=new[1:])
        row = np.maximum.accumulate(new - slope) + slope  # gaps in the item: a chain of them costs their number
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best / (MATCH * len(item)), end


def alignments(index: Index, ids: np.ndarray, least: float) -> dict[int, tuple[float, int, int]]:
    """Item number -> (score, first and last word about) of what a document holds."""
    places, found = index.hits(ids)
    if not len(places):
        return {}
    by_item: dict[int, list[tuple[int, int]]] = {}
    for p, h in zip(places.tolist(), found.tolist(), strict=True):
        for k, at in index.seeds[h]:
            by_item.setdefault(k, []).append((p - at, at))
    out: dict[int, tuple[float, int, int]] = {}
    for k, pairs in by_item.items():
        item, starts = index.items[k], sorted({d for d, _ in pairs})
        m, low = len(item), starts[0]
        for i, d in enumerate(starts):
            if i + 1 < len(starts) and starts[i + 1] - d <= m:
                continue
            a, b = max(0, low - m // 2 - 1), min(len(ids), d + m + m // 2 + 1)
            s, end = align(item, ids[a:b]) if _plausible(item, ids[a:b], least) else (0.0, 0)
            if s >= least and s > out.get(k, (0.0, 0, 0))[0]:
                out[k] = (s, max(0, a + end - m), a + end)
            if i + 1 < len(starts):
                low = starts[i + 1]
    return out


def _plausible(item: np.ndarray, window: np.ndarray, least: float) -> bool:
    """Whether enough of the item's words are in the window for any alignment to reach the score."""
    return int(np.isin(item, window).sum()) >= least * len(item)


def _blocks(benchmark: DataFrame, key: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded number and size, one block at a time on the driver."""
    block, held = [], 0
    rows = benchmark.select(F.col(key), F.col("text").cast("string")).where("text is not null").orderBy(key, "text").toLocalIterator()
    for name, text in rows:
        raw = text.encode()
        if block and (len(block) >= BLOCK_ITEMS or held + len(raw) > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((name, raw))
        held += len(raw)
    if block:
        yield block


def indexes(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> Iterator[Index]:
    """An index for each block of items, with the seeds that occur in documents."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark, key):
        index = Index(items)
        shared = spark.sparkContext.broadcast(index)

        def count(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = shared.value
            total = np.zeros(len(of.hashes), np.int64)
            for b in batches:
                for raw in b.column(0).cast(pa.large_binary()).to_pylist():
                    seen = np.unique(of.hits(of.ids(raw))[1])
                    total[np.searchsorted(of.hashes, seen)] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(of.hashes[some].view(np.int64)), pa.array(total[some])], ["seed", "n"])

        rows = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
        index.choose({r["seed"] & ((1 << 64) - 1): r["n"] for r in rows})
        shared.unpersist()
        yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, key: str = "item_id") -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): a row for each document and item with a score of `least` or more."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[key].dataType
    parts = []
    for index in indexes(docs, benchmark, key):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = shared.value
            for b in batches:
                rows, names, best = [], [], []
                for i, raw in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                    for k, found in alignments(of, of.ids(raw), least).items():
                        rows.append(i)
                        names.append(of.names[k])
                        best.append(found)
                cols = [pa.array([x[j] for x in best], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.int64() if item_kind.simpleString() == "bigint" else None), *cols], ["doc_id", key, "score", "first_word", "last_word"])

        schema = f"doc_id {kind}, {key} {item_kind.simpleString()}, score double, first_word long, last_word long"
        parts.append(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], f"doc_id {kind}, {key} {item_kind.simpleString()}, score double, first_word long, last_word long")
    rows = reduce(DataFrame.union, parts)
    best = F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("best")
    return rows.groupBy("doc_id", key).agg(best).select("doc_id", key, "best.score", (-F.col("best.col2")).alias("first_word"), "best.last_word")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, key: str = "item_id") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in indexes(docs, benchmark, key):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = shared.value
            for b in batches:
                yield b.filter(pa.array([not alignments(of, of.ids(raw), least) for raw in b.column(at).cast(pa.large_binary()).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
