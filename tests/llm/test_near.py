import random

import numpy as np

from quillon.llm import neardup, vectors
from quillon.llm.common import WordHashes, components


def shingle_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append((n := n + 1, " ".join(w).upper() if rng.random() < 0.3 else " \t".join(w)))
    rows += [(n + 1, ""), (n + 2, None), (n + 3, " \n "), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "word " * 30_000), (n + 7, "word " * 29_999)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bands int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == expected(rows)


def by_row(rows, percent=85):
    """What near_duplicates returns for rows with equal and null ids: links between rows, the smallest id that isn't null of each component."""
    found = expected([(n, t) for n, (_, t) in enumerate(rows)], percent)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[found[n][1]] = min(least.get(found[n][1], i), i)
    out = [(i, found[n][0], least.get(found[n][1])) for n, (i, _) in enumerate(rows)]
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in out), key=str)


def test_rows_of_one_id_null_ids_and_empty_tables(spark):
    text = lambda n, *edits: " ".join(f"t{n}w{i}" if i not in edits else f"edit{i}" for i in range(60))
    rows = [(5, text(1)), (5, text(1)), (None, text(1)), (7, text(1)), (5, text(2)), (8, text(2, 59)), (None, text(3)), (None, text(4)), (3, text(4, 0)), (None, None), (1, text(6)), (1, text(7)), (2, text(7) + " one more"), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, id int")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert out == by_row(rows)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_drop_no_pair_at_the_threshold():
    rng, borrow = np.random.default_rng(5), neardup._borrow()
    for percent in (80, 85):
        for union in (5, 6, 7, 13, 20, 40, 127, 300, 1000, 2000):
            both = -(-union * percent // 100)
            for _ in range(100):
                values = rng.integers(0, 1 << 64, union, np.uint64)
                cut = both + rng.integers(0, union - both + 1)
                s, t = np.sort(values[:cut]), np.sort(np.concatenate([values[:both], values[cut:]]))
                equal = (neardup.signature(s, borrow) == neardup.signature(t, borrow)).sum()
                assert equal >= neardup.least_equal(percent), (percent, union)


def test_links_between_members_that_never_lead_are_found(spark, monkeypatch):
    rng = random.Random(8)
    ids, rows = list(range(120)), []
    rng.shuffle(ids)
    for c in range(4):  # chains: neighbours have a similarity of 0.86, others less than 0.75
        w = [f"c{c}w{i}" for i in range(400)]
        rows += [(ids.pop(), " ".join(w[7 * k : 7 * k + 100])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 3, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == expected(rows) and len({c for _, c in got.values()}) == 4


def test_keep_one_loses_no_other_text_of_an_id(spark):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(3)), (5, text(4)), (6, text(4) + " end"), (7, text(5)), (8, text(3)), (9, None), (9, ""), (10, text(6)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, 0, "d") for i, t in rows], "doc_id long, text string, _name int, _digest string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (7, text(5)), (9, None), (9, ""), (10, text(6))], key=str)
    plain = spark.createDataFrame([(1, text(1)), (2, text(1)), (3, text(1).replace("t1w39", "x y z u")), (4, text(2))], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(plain).collect()) == [1, 4]


def test_signature_estimates_similarity():
    h, borrow = WordHashes(), neardup._borrow()
    a = " ".join(f"w{i}" for i in range(300)).encode()
    b = " ".join(f"w{i}" for i in range(20, 320)).encode()
    s, t = neardup.shingles(a, h), neardup.shingles(b, h)
    true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((neardup.signature(s, borrow) == neardup.signature(t, borrow)).mean() - true) < 0.12
    for n in (1, 2, 7):
        assert len(neardup.bands(neardup.signature(s[:n], borrow))) == neardup.BANDS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200 and len(got) == 41 + 60 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(x, least=0.9):
    n = len(x)
    unit = [None if v is None or not all(c is not None and np.isfinite(c) for c in v) or not any(v) else np.array(v) / np.linalg.norm(v) for v in x]
    links = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= least] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
    return [len(v) for v in links], label


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = list(rng.normal(size=(60, 16)))
    x += [x[3] + rng.normal(size=16) * 0.15 for _ in range(25)] + [x[4] * 2.5, x[5].copy(), x[5].copy()]
    rows = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, key string")
    n, label = brute_vectors(rows)
    for block in (2048, 8):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
        assert got == {i: (n[i], label[i], label[i] == i) for i in range(len(rows))}
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clusterings_miss_few_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=(1000, 64))
    z -= (z * x[:1000]).sum(1)[:, None] * x[:1000]
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.905 * x[:1000] + np.sqrt(1 - 0.905**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, cell=100).collect()}
    assert sum(got.values()) >= 2 * 1000 * 0.99


def test_vectors_of_equal_and_null_ids_and_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(1, base[0]), (1, base[1]), (2, base[1] + 0.01), (None, base[0] * 3), (None, base[2]), (None, base[2] + 0.01), (4, base[3]), (4, base[3]), (6, base[4][:2]), (7, base[4][:2] + 0.001), (8, base[5][:3])] + [(20 + k, v) for k, v in enumerate(base[6:])]
    for kind in ("double", "float"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], f"vec_id long, embedding array<{kind}>")
        n, label = brute_vectors_of_lengths([v for _, v in rows])
        least = {}
        for (i, _), c in zip(rows, label, strict=True):
            if i is not None:
                least[c] = min(least.get(c, i), i)
        want = sorted(((i, n[k], least.get(label[k]), i is not None and least.get(label[k]) == i) for k, (i, _) in enumerate(rows)), key=str)
        got = vectors.near_vectors(df).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == want


def brute_vectors_of_lengths(x, least=0.9):
    unit = [v / np.linalg.norm(v) for v in x]
    links = [[j for j in range(len(x)) if i != j and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= least] for i in range(len(x))]
    label = list(range(len(x)))
    for _ in range(len(x)):
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(x))]
    return [len(v) for v in links], label


def test_clusterings_into_many_cells_miss_few_pairs(monkeypatch):
    """Random pairs just above the threshold; the two-step cells with a smaller first step, for time's sake."""
    rng = np.random.default_rng(11)
    unit = lambda v: (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    sample, x, z = (unit(rng.normal(size=(n, 64))) for n in (16_384, 10_000, 10_000))
    z = unit(z - (z * x).sum(1)[:, None] * x)
    y = (0.902 * x + np.sqrt(1 - 0.902**2) * z).astype(np.float32)
    for k, flat in ((4, 4096), (64, 4096), (512, 4096), (4096, 256)):
        monkeypatch.setattr(vectors, "FLAT", flat)
        missed = np.ones(len(x), bool)
        for t in range(vectors.clusterings(k)):
            c = vectors.Cells(sample, k, 2 * t)
            missed &= c(x) != c(y)
        assert missed.mean() < 1e-3, k
