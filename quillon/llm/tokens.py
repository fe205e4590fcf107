"""Token ids in Arrow IPC files: equal-length sequences and masks in fixed-size-list batches, read back without copying.

A shard is a pair of Arrow IPC files in the output folder:

* ``seq-NNNNN.arrow``: ``input_ids fixed_size_list<uint16 or uint32>[L]`` and ``mask fixed_size_list<bool>[L]``. The
  documents' ids follow one another in ascending doc_id order; every sequence has L ids, the last one of a shard is
  padded with 0 and masked. Batches aren't compressed, so a reader maps the file and slices any sequence in place.
* ``doc-NNNNN.arrow``: ``doc_id, start, n_tokens`` of the shard's documents; start counts within the shard.

Shards are ranges of doc_id, so start in the whole corpus is start in the shard plus the totals of earlier shards.

Null and empty texts give just the end id. Null doc_ids sort first. Rows with the same doc_id follow one another in
the order of their ids' bytes, so ties don't depend on the run. Very long texts are encoded whole, in batches bounded by bytes,
and may span any number of sequences. An empty table gives no shard and an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import filesystem, fresh, publish, rows_of, sweep, tune

#: Ids in a sequence, and sequences in a record batch of the files.
SEQUENCE = 2048
BATCH = 128
#: Distinct words whose ids a worker remembers at a time.
WORDS = 1_000_000
#: Texts, and about how many bytes of them, that are encoded at a time.
ROWS, BYTES = 2000, 8 << 20


class Encoder:
    """Ids of texts, put together from the ids of their words.

    A tokenizer that drops white space and never joins across it gives a text the ids of its words in order; words
    repeat, so remembering them is several times as fast as encoding texts. New words of
    letters a-z go to the tokenizer's model as they are, which doesn't lower-case; others are encoded many at a time, a special token between them.
    Whether that gives the same ids, whether A-Z may be lower-cased first, and whether a last comma or full stop is a token of
    its own, is tried out on the tokenizer. `whole` encodes texts as they are, for tokenizers of other kinds.
    """

    def __init__(self, path: str, end_id: int, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.kind = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        added = {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark = next(iter(sorted(added.items())), None)
        self.special = tuple(x.encode() for x in added.values())
        alike = lambda a, *b: self._ids(a) == [i for x in b for i in self._ids(x)]
        self.whole = whole or not self.mark or not alike("so \n\t9 it,\x0b\r is.", "so", "9", "it,", "is.")
        self.lower = alike("It Is SO", "it is so")
        probe = ["a", "it", "hello", "zqxjkvb", "internationalisation", "e" * 40]
        self.direct = self.lower and not self.whole and all([t.id for t in self.tokenizer.model.tokenize(w)] == self._ids(w) for w in probe)
        self.stops = b",." if alike("so, 9. it.", "so", ",", "9", ".", "it", ".") else b""

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, stops, plain, ended, kind = self.known, self.stops, [], [], self.kind.char
        tokenize = self.tokenizer.model.tokenize if self.direct else None
        for w in new:
            if tokenize and w.isalpha() and w.islower():
                known[w] = array(kind, [t.id for t in tokenize(w.decode())]).tobytes()
            elif w[-1] in stops and w[-2:-1].isalnum():
                ended.append(w)
            elif b"<" in w and any(x in w.lower() for x in self.special):
                known[w] = self._bytes(w.decode())
            else:
                plain.append(w)
        for w in {x for w in ended for x in (w[:-1], w[-1:]) if x not in known}:
            if tokenize and w.isalpha() and w.islower():
                known[w] = array(kind, [t.id for t in tokenize(w.decode())]).tobytes()
            elif b"<" in w and any(x in w.lower() for x in self.special):
                known[w] = self._bytes(w.decode())
            elif w not in new:
                plain.append(w)
        number, mark = self.mark
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(self._ids(mark.join([w.decode() for w in part])), self.kind)
            cuts = np.flatnonzero(ids == number)
            size, raw = self.kind.itemsize, ids.tobytes()
            known.update(zip(part, [raw[a:b] for a, b in zip([0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)], strict=True)], strict=True))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in ended)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text and the end id, as bytes; null: just the end id."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.whole:
            return [self._bytes(t) + self.end for t in texts.to_pylist()]
        if len(self.known) > WORDS:  # those that came first are mostly frequent
            self.known = dict(itertools.islice(self.known.items(), WORDS // 4))
        # words are split and told apart in Arrow; Python sees each distinct word of a batch once
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)) if self.lower else texts
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        distinct, which = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
        self.known[b""] = b""
        if new := {w for w in distinct if w not in self.known}:
            self._learn(new)
        ids = list(map(self.known.__getitem__, distinct))
        for w in new:
            if len(w) > 64:
                del self.known[w]
        size = self.kind.itemsize
        pool, sizes = np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // size
        begin = np.cumsum(sizes) - sizes
        per_word = sizes[which]
        stop = np.cumsum(per_word)
        total = int(stop[-1]) if len(stop) else 0
        flat = pool[np.repeat(begin[which] - (stop - per_word), per_word) + np.arange(total)].tobytes()
        ends = np.concatenate([[0], stop])[np.asarray(split.offsets) - split.offsets[0].as_py()] * size
        return [flat[a:b] + self.end for a, b in itertools.pairwise(ends.tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int, whole: bool) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, end_id, whole)


def gathered(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until they have that many rows or bytes."""
    held, n, weight = [], 0, 0
    for b in batches:
        held.append(b)
        n, weight = n + b.num_rows, weight + b.nbytes
        if n >= rows or weight >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, weight = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, whole: bool = False, bounds: list[int] | None = None) -> DataFrame:
    """(shard, doc_id, ids): little-endian ids of every text and the end id; shard is the range of `bounds` with doc_id."""
    tune(docs.sparkSession)
    edges = np.array(bounds or [], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer, end_id, whole)
        for b in gathered(batches, ROWS, BYTES):  # the more texts at a time, the fewer distinct words to look up
            ids = b.column(0)
            known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shard = pa.array(np.searchsorted(edges, known, side="left").astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, ids, pa.array(of(b.column(1)), pa.binary())], ["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "shard int, doc_id long, ids binary")


class _Shard:
    """Writes one shard's two files under temporary names."""

    def __init__(self, out: str, number: int, kind: np.dtype, length: int):
        self.fs, root = filesystem(out)
        self.root, self.number, self.kind, self.length = root, number, kind, length
        self.fs.create_dir(root, recursive=True)
        self.names = [f"{root}/.{uuid.uuid4().hex}.{x}" for x in ("seq", "doc")]
        value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.seq = pa.schema([("input_ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.doc = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(n) for n in self.names]
        self.seqs, self.docs = pa.ipc.new_file(self.files[0], self.seq), pa.ipc.new_file(self.files[1], self.doc)
        self.held, self.n_held, self.index, self.total, self.count = [], 0, [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        a = np.frombuffer(ids, self.kind)
        self.index.append((doc_id, self.total, len(a)))
        self.total += len(a)
        self.count += 1
        self.held.append(a)
        self.n_held += len(a)
        if self.n_held >= self.length * BATCH:
            self._flush(False)
        if len(self.index) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        a = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        n = -(-len(a) // self.length) if last else len(a) // (self.length * BATCH) * BATCH  # all batches but the last are full
        for i in range(0, n, BATCH):
            part = a[i * self.length : (i + BATCH) * self.length]
            k = -(-len(part) // self.length)
            mask = np.ones(k * self.length, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(k * self.length - len(part), self.kind)]) if len(part) < k * self.length else part
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, t.type.value_type), self.length) for x, t in ((part, self.seq.field(0)), (mask, self.seq.field(1)))]
            self.seqs.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.seq))
        rest = a[n * self.length :]
        self.held, self.n_held = [rest], len(rest)

    def _flush_index(self) -> None:
        if self.index:
            self.docs.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.index, strict=True)], schema=self.doc))
            self.index = []

    def close(self) -> tuple[int, int, int]:
        self._flush(True)
        self._flush_index()
        self.seqs.close()
        self.docs.close()
        for f, name, kind in zip(self.files, self.names, ("seq", "doc"), strict=True):
            f.close()
            publish(self.fs, name, f"{self.root}/{kind}-{self.number:05d}.arrow")
        return self.number, self.count, self.total


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, length: int = SEQUENCE, whole: bool = False, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write the shards; their manifest: (shard, documents, ids) in order. Its length is the number of shards, not of rows."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / shards for i in range(1, shards)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []))
    parts = len(bounds) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_shard, done = encoder(tokenizer, end_id, whole).kind, None, []
        for b in batches:
            for number, doc_id, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_shard is None or open_shard.number != number:
                    if open_shard is not None:
                        done.append(open_shard.close())
                    open_shard = _Shard(out, number, kind, length)
                open_shard.add(doc_id, ids)
        if open_shard is not None:
            done.append(open_shard.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["shard", "docs", "tokens"])

    dealt = encode(docs, tokenizer, end_id, whole, bounds).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    manifest = sorted(tuple(r) for r in dealt.mapInArrow(run, "shard int, docs long, tokens long").collect())
    sweep(out)
    return manifest


class Shard:
    """Random access to one written shard; a local file is mapped, and sequences and masks are slices of the map."""

    def __init__(self, out: str, number: int):
        fs, root = filesystem(out)
        local = fs.type_name == "local"
        seq, doc = (f"{root}/{kind}-{number:05d}.arrow" for kind in ("seq", "doc"))
        self._sources = [pa.memory_map(p) if local else fs.open_input_file(p) for p in (seq, doc)]
        self.seqs, self.docs = pa.ipc.open_file(self._sources[0]), pa.ipc.open_file(self._sources[1])
        self.length = self.seqs.schema.field("input_ids").type.list_size
        self._at, self._flat = -1, None

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        for s in self._sources:
            s.close()

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence i."""
        batch, row = self.seqs.get_batch(i // BATCH), i % BATCH
        return tuple(batch.column(c).values.slice(row * self.length, self.length) for c in (0, 1))

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._flat = k, self.seqs.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._flat

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard, across sequences."""
        size, out, end = self.length * BATCH, [], start + n
        while start < end:
            k, at = divmod(start, size)
            piece = self._batch(k)[at : min(size, at + end - start)]
            out.append(piece)
            start += len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read(spark: SparkSession, out: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    starts, total = [], 0
    for shard, _, tokens in manifest:
        starts.append((shard, total))
        total += tokens

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with Shard(out, number) as s:
                    for k in range(s.docs.num_record_batches):
                        d = s.docs.get_batch(k)
                        crc = [zlib.crc32(s.tokens(x, n).astype("<u4").tobytes()) for x, n in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([d.column(0), pa.array(d.column(1).to_numpy() + base), d.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    s._flat = None

    return rows_of(spark, starts, "shard int, base long", max(1, len(starts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Write all documents' ids to files in `out` (a new folder in the shared one by default) and read them back."""
    out = out or fresh(docs.sparkSession, "tokens")
    return read(docs.sparkSession, out, write(docs, out, tokenizer, end_id, length))
