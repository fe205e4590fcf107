"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct shingles of five words. One hash gives every shingle a 64-bit value; its top bits say
which of BINS bins it falls in, and the smallest value of each bin is the signature. An empty bin borrows the value of the
first filled bin that a universal hash of (bin, attempt) names. BANDS runs of ROWS values are bucket keys; a pair with
similarity s misses all buckets with probability (1 - s^ROWS)^BANDS: 4e-7 at 0.85, 5e-5 at 0.8 (ROWS = 5, BANDS = 25).

Documents with equal sets become one node first, so exact copies cost nothing further; a node is known by a number of its own, so rows
whose doc_ids are equal or null stay apart. In each bucket the smallest node
is the leader, and only leader and member are compared: as many candidates as bucket rows, whatever a group's
size. Candidates with too different set sizes or signatures are dropped, before any text moves; the others are confirmed
on the full sets, recomputed from the whole texts, and the links' components found. What stars can't tell are links between members of a bucket that
aren't linked with its leader. So in buckets whose members are still in several components these are compared with one another, by signatures and
then on the full sets, within a task: members are dealt to blocks of bounded number and length, each pair of blocks is a group, and a group
returns only links that join components, fewer than it has members. Every pair that shares a bucket is together or was compared, no pairs are written out and no group is gathered. A
large group of documents just below the threshold costs the square of its size in comparisons, not in rows.

Signatures drop a candidate that has eight standard deviations fewer equal bins than a pair at the threshold has on average: of 2,000
pairs at the threshold, with 5 to 2000 shingles together, none was dropped in the tests.

Null and empty texts, and texts of white space alone, have empty sets and link with nothing. Documents with less than
five words have one shingle, the sequence of all. Very long texts are read whole. Rows with equal or null doc_ids are each a document; component_id is the
smallest doc_id that isn't null among the rows reached, null if there is none, and a row with a null doc_id isn't kept. Of the other columns, whatever their
names, none is read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WordHashes, components, grams, materialize, mix64, tune, words

SHINGLE = 5
BINS, ROWS = 128, 5
BANDS = 25
#: Members of one bucket in a block of the last comparison, and about how many shingles they have together.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: For each empty bin the bins to borrow from, in order: attempts of a hash that all documents share.
ATTEMPTS = 4096


def least_equal(percent: int) -> int:
    """Equal bins without which a candidate goes without a look at its sets."""
    share = percent / 100
    return math.floor(BINS * share - 8 * math.sqrt(BINS * share * (1 - share)))


def shingles(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(grams(hashes(words(raw)), SHINGLE))


def _borrow() -> np.ndarray:
    with np.errstate(over="ignore"):
        n = np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(1)
        return (mix64(n * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, ATTEMPTS)


def signature(values: np.ndarray, borrow: np.ndarray) -> np.ndarray:
    """Smallest value per bin; sorted values have each bin's smallest first."""
    bins = (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = values[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[borrow[empty, :64]]
        at = hit.argmax(1)
        source = borrow[empty, at]
        for i in np.flatnonzero(~hit.any(1)):
            more = borrow[empty[i]]
            found = np.flatnonzero(full[more])
            source[i] = more[found[0]] if len(found) else bins[first[0]]
        out[empty] = out[source]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of a signature."""
    with np.errstate(over="ignore"):
        parts = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(ROWS):
            h = mix64(h ^ parts[:, j])
    return h.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, set_key, bands, low): digest is of the text, set_key a 128-bit one of the set, low the signature's lowest bytes; the last three are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, borrow = WordHashes(), _borrow()
        for b in batches:
            n, keys, found, low = [], [], [], []
            for raw in b.column(2).cast(pa.large_binary()).to_pylist():
                s = shingles(raw or b"", hashes)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s, borrow) if len(s) else None
                found.append(None if sig is None else bands(sig))
                low.append(None if sig is None else sig.astype(np.uint8).tobytes())
            arrays = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n_shingles", "set_key", "bands", "low"])

    tune(docs.sparkSession)
    return docs.select(*_identity(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest long, n_shingles long, set_key binary, bands array<long>, low binary")


def _identity() -> list[Column]:
    """What tells documents apart: doc_id, and a digest of the text where doc_ids repeat or are null."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest")]


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose set sizes and signatures allow the similarity. sets: (id, n_shingles, low)."""
    enough = least_equal(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= enough))

    of = lambda side, n, low: sets.select(F.col("id").alias(side), F.col("n_shingles").alias(n), F.col("low").alias(low))
    both = pairs.select("a", "b").join(of("a", "n_a", "low_a"), "a").join(of("b", "n_b", "low_b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union. texts: (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = WordHashes(), OrderedDict()

        def of(key: int, raw: bytes) -> np.ndarray:
            if key in recent:
                recent.move_to_end(key)
            else:
                recent[key] = shingles(raw, hashes)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[key]

        for b in batches:
            keep = []
            for a, c, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3)), strict=True):
                s, t = of(a, x), of(c, y)
                small, large = sorted((len(s), len(t)))
                both = 0
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(members: DataFrame, sets: DataFrame, texts: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within buckets: of each group of two blocks fewer than it has members."""
    enough = least_equal(percent)
    whose = found.select(F.col("id").alias("k"), F.col("component").alias("c"))
    at = members.select("bucket", "id").join(whose, F.col("id") == F.col("k"), "left").select("bucket", "id", F.coalesce("c", "id").alias("component"))
    at = materialize(at.join(sets.select("id", "n_shingles"), "id"), "placed")
    # of two members one is the leader, and compared
    sizes = at.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("component").alias("lowest"), F.max("component").alias("highest"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    mixed = materialize(sizes.where("n > 2 and lowest != highest").select("bucket", blocks.alias("blocks")), "mixed")
    rows = at.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.join(sets.select("id", "low"), "id").join(texts, "id").select("bucket", "i", "j", "own", "id", "component", "n_shingles", "low", "text")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, ids, whole, n = (table.column(c).to_numpy() for c in ("own", "id", "component", "n_shingles"))
        whole = whole.copy()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, BINS)
        hashes, known, a, b = WordHashes(), {}, [], []

        def of(k: int) -> np.ndarray:
            if k not in known:
                known[k] = shingles(table.column("text")[int(k)].as_py().encode(), hashes)
            return known[k]

        for x in np.flatnonzero(own == i):
            others = np.flatnonzero((own == j) & (whole != whole[x]))
            others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
            equal = (low[others] == low[x]).sum(1)
            others = others[equal >= enough]
            for y in others[np.argsort(-equal[equal >= enough], kind="stable")]:
                if whole[x] == whole[y]:  # joined meanwhile
                    continue
                both = len(np.intersect1d(of(x), of(y), assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    a.append(ids[x])
                    b.append(ids[y])
                    whole[whole == whole[y]] = whole[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """A written table (doc_id, digest, n_shingles, component) of every row; component is a node's number, null for empty sets."""
    all_rows = materialize(sketch(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    sets = all_rows.where("n_shingles > 0").groupBy("set_key").agg(first.alias("one"), *(F.first(c).alias(c) for c in ("bands", "low", "n_shingles")))
    # numbers are drawn once and written, so every reader has the same
    sets = materialize(sets.select("set_key", "one.doc_id", "one.digest", "bands", "low", "n_shingles", F.monotonically_increasing_id().alias("id")), "sets")
    buckets = sets.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1")
    members = materialize(buckets.join(shared.select("bucket", "leader"), "bucket"), "members")
    involved = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    texts = docs.select(*_identity(), F.col("text").cast("string").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    texts = materialize(texts.join(involved.hint("shuffle_hash"), same).select("id", "text"), "texts")
    if texts.count() > members.select("id").distinct().count():  # rows with equal doc_id and text
        texts = materialize(texts.dropDuplicates(["id"]), "texts")

    pairs = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(confirmed(materialize(plausible(pairs, sets, percent), "pairs"), texts, percent), "links")
    found = materialize(components(links), "components")
    found = _joined(found, materialize(across(members, sets, texts, found, percent), "across"))
    component = sets.select("id", "set_key").join(found.select("id", "component"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    component = materialize(component, "by_set")
    return materialize(all_rows.select("doc_id", "digest", "n_shingles", "set_key").join(component, "set_key", "left").drop("set_key"), "grouped")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those are drawn between components, so only what they join is followed, not all earlier links again."""
    if links.limit(1).count() == 0:
        return found
    of = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = materialize(components(between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))), "merged")
    new = merged.select(F.col("id").alias("component"), F.col("component").alias("now"))
    moved = found.join(new, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return materialize(moved.union(merged.join(found.select("id"), "id", "left_anti").select("id", "component")), "components")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = grouped(docs, percent)
    names = materialize(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "names")
    out = rows.join(names, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with all columns: that with the smallest doc_id, a null one being the largest, and of equal doc_ids that with
    the smallest digest. Of rows with equal doc_id and text one stays. Rows with equal or null doc_ids are documents of their own, so
    none goes without a copy that stays. Documents with empty sets all stay."""
    rows = grouped(docs, percent).where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    best = materialize(rows.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    name, digest = (_unused(docs, x) for x in ("_name", "_digest"))
    copies = rows.join(best, "component").select(F.col("doc_id").alias(name), F.col("digest").alias("d"), order.eqNullSafe(F.col("best")).alias("stays"))
    copies = materialize(copies.groupBy(name, "d").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"), "copies")
    marked = docs.withColumn(digest, F.xxhash64(F.col("text").cast("string")))

    def joined(listed: DataFrame, how: str) -> DataFrame:
        keys = listed.select(name, F.col("d").alias(f"{digest}2"))
        return marked.join(keys.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(f"{digest}2")), how)

    kept = joined(copies, "left_anti")
    if copies.where("stays").limit(1).count():
        kept = kept.union(joined(copies.where("stays"), "left_semi").dropDuplicates(["doc_id", digest]))
    return kept.select(docs.columns)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that no column of df begins with."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name
