import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import tokens
from quillon.llm.common import fresh
from quillon.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
ODD = ["Don't, l'eau. A<|startoftext|>B <|STARTOFTEXT|> x", "Á é́\x0b x y.\u0085z \x1c a", "..., ?!. 12.5, ǅ. İ. ΑΣ, ß.", "x" * 300 + ".", "", " \n", None, "word " * 5000]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip_equals_encoding_whole_texts(spark):
    rows = [(i * 7 % 50, t, "x") for i, t in enumerate(ODD * 3)] + [(None, "no id", "x"), (3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = tokens.token_output(docs, PATH, length=64).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out)
    assert sum(r[2] for r in got) == sum(len(whole(r[1])) for r in rows) and len(got) == len(rows)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [r[1] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    expected = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array(whole(r[1]), "<u4").tobytes())) for r in rows)
    assert sorted((-1 if d is None else d, c) for _, d, _, c in got) == expected


def test_files_give_sequences_and_masks_in_place(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox. " * (i + 1)) for i in range(40)], "doc_id long, text string")
    out = fresh(spark, "t")
    manifest = tokens.write(docs, out, PATH, length=32, shards=3)
    everything = [x for i in range(40) for x in whole("the quick brown fox. " * (i + 1))]
    seen = []
    for shard, _, n in manifest:
        with tokens.Shard(out, shard) as s:
            part = []
            for i in range(-(-n // 32)):
                ids, mask = s.sequence(i)
                assert len(ids) == len(mask) == 32
                part += [x for x, m in zip(ids.to_pylist(), mask.to_pylist(), strict=True) if m]
            assert len(part) == n
            assert s.tokens(5, 70).tolist() == part[5:75]
            s._flat = None
            seen += part
    assert seen == everything


def test_whole_mode_agrees(spark):
    fast, slow = tokens.Encoder(PATH, 2), tokens.Encoder(PATH, 2, whole=True)
    texts = pa.array(ODD)
    assert fast(texts) == slow(texts) and fast(texts[3:5]) == slow(texts[3:5]) and fast(texts[:0]) == []


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 8)
    e = tokens.Encoder(PATH, 2)
    texts = pa.array([f"w{i} again, and again. v{i * 3}" for i in range(60)])
    for _ in range(3):
        assert e(texts) == tokens.Encoder(PATH, 2, whole=True)(texts)


def test_empty_table(spark):
    assert tokens.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    with pytest.raises(Exception):
        tokens.Encoder("/nowhere.json", 2)


def test_capitals_beside_special_tokens_are_lower_cased():
    texts = pa.array(["Hello World <|endoftext|> The end.", "The End. Hello, <| F <|> X WORLD. world"])
    fast = tokens.Encoder(PATH, 2)(texts)
    assert fast == tokens.Encoder(PATH, 2, whole=True)(texts)
    assert np.frombuffer(fast[0], "<u2").tolist() == whole(texts[0].as_py())
