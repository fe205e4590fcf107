import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import decontaminate, pii, toxicity, urls
from quillon.llm.queries import URL_RULES


def test_folding():
    assert toxicity.fold("ІDІ0T, l0s3r! Élan 2024 a-b") == " idiot loser elan 2024 a b "
    assert toxicity.fold("") == "  "


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ne", "tu", "ra"], k=3))
    rows, labels = [], []
    for i in range(900):
        w, toxic = [word() for _ in range(rng.choice([5, 60]))], rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["Zorgh", "zorgh!", "Z0RGH", "vexxo" + word()]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "la " * 40_000, "en", "s")], "doc_id long, text string, lang string, score string")
    known = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known, ~toxicity.held_out("doc_id"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in labels if i in held)
    assert max(got[1000], got[1001], got[1002]) < 0.3
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.3}
    nothing = toxicity.train(docs, known.where("toxic = 0"), F.lit(True))
    assert nothing.curve is None and 0 < nothing.base < 0.1
    assert toxicity.score(spark.createDataFrame([], docs.schema), model).count() == 0


def plain_features(model, text):
    """The lexicon without an automaton: every place of every term in the folded text."""
    folded = toxicity.fold(text)
    spared = [(i, i + len(x)) for x in model.exceptions for i in range(len(folded)) if folded.startswith(x, i)]
    best = {}
    for t, w in model.weights.items():
        for i in range(len(folded)):
            if folded.startswith(t, i) and not any(a <= i < b - 1 for a, b in spared):
                best[i] = max(best.get(i, 0.0), w)
    return sum(best.values()) / (folded.count(" ") + 20) ** 0.5, max(best.values(), default=0.0)


def test_scores_equal_plain_matching():
    rng = random.Random(12)
    words = ["trash", "trashy", "can", "bin", "you", "fool", "foolish", "F0OL", "idiot", "ok"]
    m = toxicity.Model({" trash ": 5.0, " tra": 2.0, " fool": 3.0, " fool ": 4.0, " idiot ": 6.0}, frozenset({" trash can ", " can fool ", " you fool "}), (-3.0, 1.0, 1.0))
    f = m.matcher()
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 12)))
        assert np.allclose(f(text)[1:], plain_features(m, text)), text


def test_exception_phrases():
    m = toxicity.Model({" trash ": 5.0}, frozenset({" trash can "}), (-3.0, 1.0, 1.0))
    f = m.matcher()
    assert f("put it in the trash can")[2] == 0 and f("you trash")[2] == 5


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] > 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(a))


def test_alignment_equals_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 30))
        assert abs(decontaminate.align(a, b)[0] - slow_align(a.tolist(), b.tolist())) < 1e-12


def test_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    common = ["the", "of", "and"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(30)] + [(30, None), (31, ""), (32, "lone item")]
    docs, truth = [], set()
    for d in range(300):
        w = text(rng.choice([50, 300]))
        if d % 3 == 0:
            k = 0 if d % 2 else rng.randrange(30)
            passage = items[k][1].split()
            if d % 9 == 0:
                for p in rng.sample(range(40), 5):
                    passage[p] = word()
                del passage[rng.randrange(len(passage))]
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in passage]
            truth.add((d, k))
        docs.append((d, " ".join(w), "s", d))
    docs += [(900, None, "s", 0), (901, "", "s", 0), (902, "the of and " * 20_000, "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == truth
    kept = decontaminate.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in truth}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0


def test_copies_with_every_fourth_or_fifth_word_replaced_are_found(spark):
    items, docs, truth = [], [], set()
    for step, first, m in [(s, f, m) for s in (4, 5) for f in range(s) for m in (15, 27, 38, 48, 59)]:
        n = len(items)
        words = [f"i{n}w{j}" for j in range(m)]
        copy = [f"edit{n}x{j}" if j % step == first else w for j, w in enumerate(words)]
        items.append((n, " ".join(words)))
        docs.append((n, " ".join([f"a{n}b{j}" for j in range(30)] + copy + [f"c{n}d{j}" for j in range(30)])))
        if decontaminate.align(np.arange(1, m + 1), np.array([0 if w.startswith("edit") else j + 1 for j, w in enumerate(copy)]))[0] >= 0.5:
            truth.add((n, n))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(truth) > 40
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == truth


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame([(i, f"item {i} has these words number w{i} x{i} y{i}") for i in range(5)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"before item {i} has these words number w{i} x{i} y{i} after") for i in range(5)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).where("score = 1").collect()} == {(i, i) for i in range(5)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum((k := int(c) * (1 + i % 2)) - 9 * (k > 9) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_personal_data_spans_equal_rules(spark):
    rng = random.Random(7)
    bits = ["a.b@c.de", "x@y", "_a@b.c_d@e.f", "😀", "é", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "00012.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0100", "+12", "+1 2", " ", "\n", "@", ".", "a@b.c@d.e", "12", "5", "-", "+49.30.1234567", "x=+1234567890123456"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(1, 14)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 20_000), (1003, "a" * 4000 + "@" + "b" * 4000), (1004, "+1" * 5000), (1005, "1.2.3.4 " * 1000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, t in rows:
        spans = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, t)
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
    assert pii.digest(df.where("false")).count() == 0


def test_boosting_separates_bits():
    rows = [(b, int(bool(b & 16) and not b & 32), 50) for b in range(64)]
    score = pii.boost(rows)
    assert all((score[b] > 0) == bool(label) for b, label, _ in rows)
    assert pii.thresholds(score, []) == {} and pii.boost([])[0] == 0


#: Written by hand, not by the recipe the trees learn from: text, and the spans that the method should add to the base ones.
PLANTED = [
    ("write to jane (at) firm (dot) org today", [("email", "jane (at) firm (dot) org")]),
    ("contact: bob[at]mail[dot]example[dot]com.", [("email", "bob[at]mail[dot]example[dot]com")]),
    ("my e-mail is ann.lee at posteo dot de, thanks", [("email", "ann.lee at posteo dot de")]),
    ("server 10[.]20[.]30[.]40 was down", [("ip", "10[.]20[.]30[.]40")]),
    ("host: 2001:0db8:85a3:0000:0000:8a2e:0370:7334 answered", [("ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]),
    ("card 4111.1111.1111.1111 please", [("card", "4111.1111.1111.1111")]),
    ("visa: 5500/0000/0000/0004, exp", [("card", "5500/0000/0000/0004")]),
    ("call (650) 555-0100 now", [("phone", "(650) 555-0100")]),
    ("Tel: 0049 30 1234 567", [("phone", "0049 30 1234 567")]),
    ("phone 020.794.60958 or later", [("phone", "020.794.60958")]),
    ("API key = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\"", [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]),
    ("token: ghp_16C7e42F292c6912E7710c838347Ae178B4a", [("secret", "ghp_16C7e42F292c6912E7710c838347Ae178B4a")]),
    ("IBAN DE89 3704 0044 0532 0130 00 is mine", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("konto: GB82WEST12345698765432", [("iban", "GB82WEST12345698765432")]),
    ("on 2024-01-05 and 05.01.2024 we met", []),
    ("version 12.34.56.7890 of 10:20:30", []),
    ("commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixed it", []),
    ("order 4111.1111.1111.1112 shipped", []),
    ("a list: 100,200,300,400 and 12-34-56", []),
    ("internationalisation_of_modules_2 and Donaudampfschifffahrt", []),
    ("we met at noon. dot matrix at home", []),
    ("IBAN DE89 3704 0044 0532 0130 01 is wrong", []),
]


def test_added_spans_of_hand_written_texts(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in PLANTED)), "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.digest(df).collect():
        text, want = PLANTED[r.doc_id]
        base = base_spans(text)
        added = {(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in filter(None, r.spans.split(",")) if s not in base}
        assert r.n_spans == len(added) + len(base)
        right, wrong, missed = right + len(added & set(want)), wrong + len(added - set(want)), missed + len(set(want) - added)
    assert right >= 0.85 * (right + missed) and right >= 0.85 * (right + wrong), (right, wrong, missed)


def test_examples_kept_apart_are_told_apart(spark):
    score, cut = pii.learned(spark)
    assert set(cut) == set(range(len(pii.ALL_KINDS)))
    fresh = pii.examples(20, seed=99)
    df = spark.createDataFrame([(x[0], x[1]) for x in fresh], "doc_id long, text string")
    truth = {x[0]: x for x in fresh}
    caught = clean = n_good = n_bad = 0
    for r in pii.digest(df).collect():
        _, _, start, stop, rank, label = truth[r.doc_id]
        spans = [s.split(":") for s in filter(None, r.spans.split(","))]
        hit = any(min(int(b), stop) - max(int(a), start) >= 0.8 * (stop - start) for _, a, b in spans)
        n_good, n_bad = n_good + label, n_bad + 1 - label
        caught, clean = caught + (label and hit), clean + (not label and not hit)
    assert caught >= 0.85 * n_good and clean >= 0.9 * n_bad, (caught, n_good, clean, n_bad)


def test_number_laden_texts_take_linear_time(spark):
    import time

    took = []
    for n in (2_000, 16_000):
        text = "tel (650) 555-0100, " * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.monotonic()
        assert pii.digest(df).first().n_spans == n
        took.append(time.monotonic() - began)
    assert took[1] < 3 * took[0] + 10


def url_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for kind, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, best


def test_url_rules_and_model(spark, monkeypatch):
    rng = random.Random(8)
    rows = [f"http://{rng.choice(['a', 'B', 'www.q'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99)}{rng.choice(['', '?q=1', '#x', '.html'])}" for _ in range(400)]
    rows += [None, "", "no scheme/en/", "http://", "HTTP://COM/en/", "x://com?/en/", "http://é.net/de/é", "http://net/de", "http://a.b/c://net/de/", "http://com/en/\nx", "http://" + "a/" * 30_000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, host string")
    for inline in (256, 0):
        monkeypatch.setattr(urls, "INLINE_RULES", inline)
        got = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
        assert len(got) == len(rows)
        for i, u in enumerate(rows):
            host, path, best = url_verdict(u)
            assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
            assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block")
    like = [r for r in got.values() if r.rule is None and r.host.endswith(".com") and r.path.startswith("/fr/")]
    assert like and urls.judge(df.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}
    scored = {r.page_id: r.score for r in urls.judge(df, []).collect()}
    assert all(scored[i] == 0 for i, u in enumerate(rows) if u is None or "://" not in u)


def brute_ratio(urls_of, order=5, strength=4.0, least=2):
    """Scores and threshold by dictionaries: urls_of is a list of (url, rule verdict or None)."""
    import math

    shape = lambda u: re.sub("[0-9]", "0", u.split("://", 1)[1].lower()) if u and "://" in u else ""
    held = lambda s: hashlib.md5(s.encode()).hexdigest()[0] < "4"
    kinds = ("allow", "block")
    count = {k: {} for k in kinds}
    seen = {}
    for u, v in urls_of:
        seen.setdefault(shape(u), []).append(v)

    def grams(s):
        t = "^" * (order - 1) + s + "$"
        return [t[i - n + 1 : i + 1] for i in range(order - 1, len(t)) for n in range(1, order + 1)]

    for s, vs in seen.items():
        for k in kinds:
            if n := vs.count(k) * (not held(s)):
                for g in grams(s):
                    count[k][g] = count[k].get(g, 0) + n
    every = set(count["allow"]) | set(count["block"])
    single = {g for g in every if len(g) == 1}
    context = {k: {} for k in kinds}
    for g in every:
        for k in kinds:
            c = (len(g), g[:-1])
            context[k][c] = context[k].get(c, 0) + count[k].get(g, 0)
    p = {k: {} for k in kinds}
    gain = {}
    for g in sorted(every, key=len):
        if len(g) > 1 and (sum(count[k].get(g, 0) for k in kinds) < least or g[1:] not in p["allow"]):
            continue
        lower = {k: p[k][g[1:]] if len(g) > 1 else 1 / len(single) for k in kinds}
        for k in kinds:
            p[k][g] = (count[k].get(g, 0) + strength * lower[k]) / (context[k][len(g), g[:-1]] + strength)
        gain[g] = math.log(p["allow"][g] / p["block"][g]) - math.log(lower["allow"] / lower["block"])
    score = {s: sum(gain.get(g, 0.0) for g in grams(s)) / (len(s) + 1) if s else 0.0 for s in seen}
    return shape, score, [(score[s], vs.count("allow"), vs.count("block")) for s, vs in seen.items() if held(s)]


def test_url_model_equals_dictionaries(spark):
    rng = random.Random(21)
    hosts = ["shop", "news", "win-now", "x.adult", "blog"]
    rows = [f"https://{rng.choice(hosts)}{rng.randrange(9)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr', 'it'])}/{''.join(rng.choices('abc0', k=rng.randrange(1, 6)))}" for _ in range(500)] + [None, "", "x", "http://"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    ruled = [(u, (best[0] if (best := url_verdict(u)[2]) else None)) for u in rows]
    shape, score, held = brute_ratio(ruled)
    got = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
    free = [i for i, (_, v) in enumerate(ruled) if v is None]
    assert len(free) > 100 and all(abs(got[i].score - score[shape(rows[i])]) < 1e-9 for i in free)
    allowed, blocked = [got[i].score for i in free if got[i].verdict == "allow"], [got[i].score for i in free if got[i].verdict == "block"]
    assert min(allowed) >= max(blocked)
    recalls = lambda cut: sum(a for s, a, _ in held if s >= cut) / sum(a for _, a, _ in held) + sum(b for s, _, b in held if s < cut) / sum(b for *_, b in held)
    assert recalls(min(allowed)) >= max(recalls(s) for s, *_ in held) - 0.05
