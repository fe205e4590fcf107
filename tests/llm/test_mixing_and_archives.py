import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, preferences, warc
from quillon.llm.common import fresh


def water(sizes, weights, share, cap):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / total > cap * sizes[n]]
        if not over:
            return target | {n: left * w[n] / total for n in free}
        for n in over:
            target[n] = cap * sizes[n]
        left -= sum(target[n] for n in over)
        free -= set(over)
    return target


def test_mix_reaches_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "B", None, "é", "a"])) for i in range(2500)] + [(9000, None, "zero"), (9001, "", "zero"), (9002, "x\x0b\ty\x0cz\x00\u00a0q", "a"), (3, "again", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, place int")
    out = mixing.decide(df).collect()
    words = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = water(sizes, (5, 2, 1), 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, words(t)) for i, t, _ in rows)
    assert sorted(map(str, mixing.decide(df.repartition(7)).collect())) == sorted(map(str, out))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.decide(df.where("false")).count() == 0


def test_rows_without_ids_and_of_one_id_are_drawn_each_for_itself(spark):
    rows = [(None, "w w w w w", "a")] * 200 + [(7, "v v v v", "b")] * 300 + [(i, "u u", "c") for i in range(100, 400)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, source string, number int, several int, _row int")
    for share in (0.3, 0.8, 1.5):
        out = mixing.decide(df, weights=(1, 2, 3), share=share).collect()
        sizes, taken, target = {}, {}, {}
        for r in out:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
            target[r.source] = r.target
        want = water(sizes, (1, 2, 3), share, 2.0)
        for source, t in want.items():
            assert abs(target[source] - t) < 1e-6 and abs(taken[source] - t) <= 2.5 + 1e-9
    assert mixing.mixed(df).columns == df.columns


def test_heavier_documents_come_first_more_often(spark):
    rows = [(i, "w w w w", "a" if i % 2 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.decide(df, weights=(1,), share=0.5, quality_weight=F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.25)).groupBy((F.col("doc_id") % 4 < 2).alias("heavy")).agg(F.sum("copies").alias("n")).collect()
    n = {r.heavy: r.n for r in out}
    assert n[True] > 1.6 * n[False] and abs(n[True] + n[False] - 2000) <= 4


def test_archives_round_trip(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://h/{i}?a b\n{i}", random.Random(i).choice([page, "short", f"<b>{i}é</b>" * 40])) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x", "y" * 300_000), (103, "http://x", "y" * 300_000), (None, "http://n", page), (104, "http://d", "z" * 99), (105, "http://d", "z" * 99)]
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, payload_digest string")
    out = fresh(spark, "w")
    got = warc.round_trip(df, out).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    by = {r.metadata.page_id: r for r in got}
    for i, _, h in rows:
        raw, r = (h or "").encode(), by[i]
        assert (r.metadata.payload_bytes, r.response.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = i is not None and first.get(h, i) != i
        assert r.response.type == ("revisit" if again else "response") and r.metadata.refers_to == (first[h] if again else None)
        assert r.request.id and (again or bytes(r.response.payload) == raw)
        assert not again or r.response.refers_to_id == by[first[h]].response.id
    assert warc.round_trip(df.where("false")).count() == 0


def test_rows_of_one_page_have_records_of_their_own(spark):
    page, other = "<p>" + "x" * 200 + "</p>", "<p>" + "y" * 200 + "</p>"
    rows = [(1, "http://a", page), (1, "http://a", page), (1, "http://b", page), (2, "http://c", other), (2, "http://c", "short"), (2, "http://c", "short"), (3, "http://d", other), (None, "http://n", page), (None, "http://n", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows) == len({r.capture for r in got}) == len({r.request.id for r in got}) == len({r.metadata.id for r in got})
    key = lambda i, u, n, kind, to: (i or 0, u, n, kind, to or 0)
    assert sorted(key(r.metadata.page_id, r.url, r.metadata.payload_bytes, r.response.type, r.metadata.refers_to) for r in got) == sorted(
        [key(1, "http://a", 207, "response", 0), key(1, "http://a", 207, "revisit", 1), key(1, "http://b", 207, "revisit", 1), key(2, "http://c", 207, "response", 0)]
        + [key(2, "http://c", 5, "response", 0)] * 2 + [key(3, "http://d", 207, "revisit", 2)] + [key(None, "http://n", 207, "response", 0)] * 2
    )
    first = {r.response.payload_digest: r.response.id for r in got if r.response.type == "response" and r.metadata.page_id is not None}
    assert all(r.response.refers_to_id == first[r.response.payload_digest] for r in got if r.response.type == "revisit")
    assert {r.capture for r in warc.round_trip(df).collect() if r.metadata.page_id} == {r.capture for r in got if r.metadata.page_id}


def test_archives_are_gzip_members(spark):
    import gzip
    import io

    data = warc.transaction(1, 0, "http://a/b", b"body" * 50, "00", None) + warc.transaction(2, 0, "", b"", "00", 1)
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 6
    assert [h["warc-type"] for h, _ in warc.parse(io.BytesIO(data))] == ["request", "response", "metadata", "request", "revisit", "metadata"]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(data[:-9])))


def test_preference_pairs(spark):
    a = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "so"), (0, 3, "assistant", "good")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (1, 3, "assistant", "bad"), (1, 4, "user", None)]
    same = [(c, t, r, x) for c in (2, 3) for _, t, r, x in a]
    odd = [(4, 0, None, None), (4, 0, None, None), (None, 0, "user", "x"), (6, None, "user", "x")] + [(8, t, "assistant", "long " * 2000) for t in range(130)] + [(9, t, "assistant", "long " * 2000) for t in range(129)]
    df = spark.createDataFrame([(*r, 5) for r in a + b + same + odd], "conv_id long, turn long, role string, text string, pair_id int")
    pairs = preferences.neighbours(df)
    out = {(r.pair_id, r.part): r for r in preferences.format_pairs(df, pairs).collect()}
    assert set(out) == {(0, 0), (1, 0), (2, 0), (4, 0)}
    r = out[0, 0]
    assert r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nso<|end|>\n" and r.prefix_turns == 3
    told = lambda text, mask: [text[m.start : m.start + m.length] for m in mask]
    assert told(r.chosen, r.chosen_mask) == ["good<|end|>\n"] and told(r.rejected, r.rejected_mask) == ["bad<|end|>\n"]
    assert r.rejected.endswith("<|user|>\n<|end|>\n")
    assert out[1, 0].chosen == out[1, 0].rejected == "" and out[1, 0].prefix_turns == 4
    assert out[2, 0].prompt == "" and out[2, 0].chosen == "<|user|>\n<|end|>\n" and out[2, 0].rejected == ""
    assert out[4, 0].prefix_turns == 129 and told(out[4, 0].chosen, out[4, 0].chosen_mask) == ["long " * 2000 + "<|end|>\n"]
    parts = sorted((r for r in preferences.format_pairs(df, pairs, most=100_000).collect() if r.pair_id == 4), key=lambda r: r.part)
    assert len(parts) > 20 and max(len(r.prompt) for r in parts) < 100_000
    assert "".join(r.prompt for r in parts) == out[4, 0].prompt and "".join(r.chosen for r in parts) == out[4, 0].chosen
    assert preferences.format_pairs(df.where("false"), preferences.neighbours(df.where("false"))).count() == 0


def test_preference_pairs_equal_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(60):
        shared = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "é😀", None, "a b"])) for _ in range(rng.randrange(6))]
        for side in (0, 1):
            own = shared + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é"])) for _ in range(rng.choice([0, 1, 3, 400 if pair == 5 else 2]))]
            rows += [(2 * pair + side, t, r, x) for t, (r, x) in enumerate(own) if rng.random() < 0.95]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    said = {}
    for c, t, r, x in rows:
        said.setdefault(c, {})[t] = (r or "user", x or "")
    want = {}
    for pair in range(60):
        a, b = said.get(2 * pair, {}), said.get(2 * pair + 1, {})
        if not a and not b:
            continue
        differ = [t for t in sorted(a.keys() | b.keys()) if a.get(t) != b.get(t)]
        cut = differ[0] if differ else float("inf")

        def rendered(turns):
            text, mask = "", []
            for role, x in turns:
                text += f"<|{role}|>\n"
                if role == "assistant":
                    mask.append((len(text), len(x) + len("<|end|>\n")))
                text += x + "<|end|>\n"
            return text, mask

        prompt = [x for t, x in sorted(a.items()) if t < cut]
        want[pair] = (len(prompt), rendered(prompt)[0], *rendered([x for t, x in sorted(a.items()) if t >= cut]), *rendered([x for t, x in sorted(b.items()) if t >= cut]))
    plain = lambda mask: [(m.start, m.length) for m in mask]
    got = {r.pair_id: (r.prefix_turns, r.prompt, r.chosen, plain(r.chosen_mask), r.rejected, plain(r.rejected_mask)) for r in preferences.format_pairs(df, preferences.neighbours(df)).collect()}
    assert got == want


def test_pipeline_equals_brute_force(spark):
    """Each stage again by plain means: all pairs of sets, all alignments without seeds, targets by filling, whole-text ids."""
    import zlib

    import numpy as np
    from test_near import expected
    from test_tokens import whole

    from quillon.llm import decontaminate, queries

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r for r in queries.table(spark, sf, "documents").collect()}
    toxic = {r.doc_id for r in queries.op3_toxicity(spark, sf).where("predicted = 1").collect()}
    left = {i: d for i, d in docs.items() if i not in toxic}
    near = expected([(i, d.text) for i, d in left.items()], 80)
    left = {i: d for i, d in left.items() if near[i][1] == i}
    items = [decontaminate.tokens((r.text or "").encode()) for r in queries.table(spark, sf, "benchmark").collect()]
    names = {w: n + 1 for n, w in enumerate({w for ws in items for w in ws})}
    coded = [np.array([names[w] for w in ws]) for ws in items if ws]
    clean = {}
    for i, d in left.items():
        ids = np.array([names.get(w, 0) for w in decontaminate.tokens((d.text or "").encode())], np.int64)
        if not any(decontaminate.align(x, ids)[0] >= 0.5 for x in coded):
            clean[i] = d
    assert len(docs) > len(clean) > len(docs) / 2
    words = lambda t: len((t or "").encode().split())
    sizes, copies = {}, {}
    for d in clean.values():
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    for r in out:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    largest = max(words(d.text) for d in clean.values())
    for source, target in water(sizes, (5, 2, 1), 1.5, 2.0).items():
        taken = sum(copies.get(i, 0) * words(d.text) for i, d in clean.items() if d.source == source)
        assert abs(taken - target) <= largest / 2 + 1e-6
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        ids = whole(docs[r.doc_id].text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(r.doc_id for r in out)


def test_stages_on_odd_rows(spark):
    """Null, empty and long texts, equal and null ids, clashing columns, and an empty table through every stage."""
    from quillon.llm.common import materialize

    sf = "/root/testdata/sf0.001"
    base, other, third = (" ".join(str(k + i) for i in range(60)) for k in (1000, 2000, 3000))
    rows = [(None, base, "a"), (None, base, "b"), (None, other, None), (None, other, "a"), (7, base, "a"), (7, third, "a"), (8, None, "a"), (9, "", None), (10, "long " * 50_000, "b"), (10, "long " * 50_000, "b"), (11, " \n", "c")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, component int, _digest int")
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf), name)
            assert docs.columns == df.columns
            if name == "near_duplicates" and docs.count():
                kept = [(r.doc_id, (r.text or "")[:9]) for r in docs.collect()]
                assert sorted(kept, key=str) == sorted([(None, other[:9]), (7, base[:9]), (7, third[:9]), (8, ""), (9, ""), (10, "long long"), (11, " \n")], key=str)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len(out) == docs.count()
