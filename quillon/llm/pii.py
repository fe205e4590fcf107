"""Personal data: rule-checked spans, and candidates that gradient-boosted trees select. DataFrame functions only.

Base spans of e-mail addresses, IP addresses, card and phone numbers are leftmost matches of one pattern per kind, in
order and without overlap, that pass a check (octets, Luhn, number of digits); a match that fails isn't tried again.
Positions are code points: the pieces between matches and the matches themselves give them by their lengths.

Further candidates come from generators that find nearly everything: addresses with spelled-out or bracketed signs, numbers without a plus or
with other separators, addresses of eight groups, keys and tokens (`secret`), account numbers (`iban`), and what the base rules tried and dropped. They
may overlap each other and base spans. Each has bits for its kind, format and context.

The trees learn from synthetic texts (`examples`), not from what the base rules say: each has one planted span, in a format and a
context drawn by a fixed seed, either personal data or something that looks like it (dates, versions, order numbers, digests of files). A quarter of them,
by hash, is kept apart; for each kind the threshold is the lowest score from which on at least PRECISION of that quarter's candidates are
right. Trees of depth two are fitted to counts of candidates by bits, on the driver; EACH bounds the examples whatever the input. They score the
patterns of bits that candidates have, at most 2^BITS rows. A selected candidate that touches no base span and
no selected candidate before it is added.

Patterns use possessive repeats, and a start only where a run begins or the previous match ended; both leave the matches as they
are and keep very long runs linear, as do matches taken in blocks and bytes read at their positions. Null and empty texts have no spans. Rows with the
same doc_id, or a null one, have their own results. Of spans that begin at one place the kind listed first comes first. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, scanned

#: Kinds with base rules, and those that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "iban")
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: pattern, and a cheap one without which it can't match.
BASE = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+"),
}
_AT, _DOT = r"(?:\x20?[(\[{]at[)\]}]\x20?|\x20?@\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
LOOSE = {
    "email": (rf"(?<![\w.%+-])[\w.%+-]{{1,64}}+{_AT}[\w-]{{1,64}}+(?:{_DOT}[\w-]{{2,24}}+){{1,6}}+", r"@|[(\[{]at[)\]}]|\x20at\x20[\w-]++(?:\.\w|\x20?[(\[{]dot|\x20dot\x20)"),
    "ip": (r"(?<![\w.:,])(?:[0-9]{1,4}+(?:(?:[.,:]|\[\.\]|\(\.\))[0-9]{1,4}+){3}+|(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+)(?![\w:])", r"[0-9](?:[.,:]|\[\.\]|\(\.\))[0-9]|:[0-9A-Fa-f]{0,4}:"),
    "card": (r"(?<!\w)[0-9]{4}+(?:[\x20._/-]{0,2}+[0-9]{2,6}+){2,4}+(?!\w)", r"[0-9]{4}"),
    "phone": (r"(?<![\w.+-])(?:(?:\(?[0-9]{2,5}+\)?[\x20./-]){2,5}[0-9]{2,5}+|0[0-9]{8,12}+)(?!\w)", r"[0-9]{2}\)?[\x20./-]|0[0-9]{8}"),
    "secret": (r"(?<![\w/+=.-])(?=[A-Za-z_/+=-]*+[0-9])[\w/+=-]{16,}+(?![\w/+=])", r"[0-9](?:[\w/+=-]{7}|(?<=[\w/+=-]{9}))"),
    "iban": (r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?!\w)", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
}
_LINK = r"(?:[\x20_-](?:is|at|me|us|on|to|number|no|id))?\W{0,4}$"
HINTS = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel)" + _LINK,
    "ip": r"(?i)(?:\bip|address|host|server|from|login)" + _LINK,
    "card": r"(?i)(?:card|visa|credit|mastercard|karte|tarjeta|carte)" + _LINK,
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|anruf|llama)" + _LINK,
    "secret": r"(?i)(?:token|key|secret|password|passwd|pwd|auth|bearer|credential)" + _LINK,
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte)" + _LINK,
}
OTHERS = r"(?i)(?:version|\bv|date|isbn|page|section|commit|sha-?1?|sha256|md5|checksum|digest|order|invoice|ticket|chapter|figure|serial|ratio|part|file)" + _LINK
BITS = 16
PRECISION = 0.95
ROUNDS, RATE = 60, 0.3
#: Texts of one format in the examples.
EACH = 60
FOUND = "array<struct<start:bigint,rank:int,stop:bigint>>"
SPANS = "array<struct<gap:int,start:bigint,stop:bigint,value:string,before:string,after:string>>"


def _text_literal(value: str) -> str:
    """A pattern as an SQL literal."""
    return "r'" + value.replace("'", r"\x27") + "'"


def _like(column: str, pattern: str) -> str:
    return f"{column} rlike {_text_literal(pattern)}"


def _located(at: str, x: str) -> tuple[str, str]:
    """A match x: its piece of text p before, its value m, and the piece q after; at is where p begins."""
    begin = f"{at} + length({x}.p)"
    span = f"named_struct('gap', length({x}.p), 'start', {begin}, 'stop', {begin} + length({x}.m), 'value', {x}.m, 'before', right({x}.p, 32), 'after', left(coalesce({x}.q, ''), 2))"
    return f"{begin} + length({x}.m)", f"array({span})"


def located(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Replaces `text` by a column of the matches of each pattern; start and stop in code points, stop exclusive; gap since the match before."""
    kept = [f"`{c}`" for c in rows.columns if c != "text"]
    nothing = "cast(array() as array<string>)"
    for_each = lambda f: [f(k, _text_literal(p), maybe) for k, (p, maybe) in patterns.items()]
    found = for_each(lambda k, p, maybe: f"CASE WHEN {_like('text', maybe)} THEN regexp_extract_all(text, {p}, 0) ELSE {nothing} END AS {k}_m")
    pieces = for_each(lambda k, p, maybe: f"CASE WHEN {_like('text', maybe)} THEN split(text, {p}, -1) ELSE {nothing} END AS {k}_p")
    rows = rows.selectExpr(*kept, *found, *pieces)
    both = "zip_with({k}_m, {k}_p, (m, p) -> named_struct('m', m, 'p', p))"
    zipped = f"zip_with({both}, slice({{k}}_p, 2, size({{k}}_p)), (x, q) -> named_struct('m', x.m, 'p', x.p, 'q', q))"
    rows = rows.selectExpr(*kept, *(f"filter({zipped.format(k=k)}, z -> z.m is not null) AS {k}_z" for k in patterns))
    return rows.selectExpr(*kept, *(f"{scanned(f'{k}_z', '0L', SPANS, _located)} AS {k}" for k in patterns))


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(v: str) -> str:
    """Whether the digits pass; false for values with more digits than a card has."""
    every = f"transform(filter(split(reverse({digits(v)}), ''), d -> d <> ''), (d, k) -> (1 + k % 2) * cast(d as int))"
    return f"(CASE WHEN length({digits(v)}) between 12 and 19 THEN aggregate({every}, 0, (t, d) -> t + CASE WHEN d > 9 THEN d - 9 ELSE d END) % 10 = 0 ELSE false END)"


def octets(v: str) -> str:
    parts = f"transform(split({v}, '[^0-9]+'), d -> regexp_replace(d, '^0+(?=.)', ''))"
    return f"forall({parts}, d -> CASE WHEN length(d) <= 3 THEN coalesce(try_cast(d as int), 0) <= 255 ELSE false END)"


def mod97(v: str) -> str:
    """Whether an account number's check digits are right."""
    plain = f"regexp_replace({v}, '[^0-9A-Z]', '')"
    numbers = f"transform(filter(split(concat(substr({plain}, 5), left({plain}, 4)), ''), d -> d <> ''), d -> CASE WHEN d <= '9' THEN ascii(d) - 48 ELSE ascii(d) - 55 END)"
    return f"(aggregate({numbers}, 0, (t, d) -> cast((t * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97 as int)) = 1)"


VALID = {
    "email": lambda v: "true",
    "ip": octets,
    "card": luhn,
    "phone": lambda v: f"length({digits(v)}) between 9 and 15",
}

#: Two conditions on a candidate's form for each kind.
FORM = {
    "email": lambda v: (_like(v, r"(?:\.|dot[)\]}]?\x20?)[A-Za-z]{2,24}$"), _like(v, r"@|[(\[{]at[)\]}]|\x20at\x20.*(?:\x20dot\x20|[(\[{]dot[)\]}])")),
    "ip": lambda v: (f"CASE WHEN contains({v}, ':') THEN size(split({v}, ':')) >= 6 and {_like(v, '[A-Fa-f]')} ELSE {octets(v)} END", _like(v, r"^[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}$|[A-Fa-f]")),
    "card": lambda v: (luhn(v), _like(v, "^[2-6]")),
    "phone": lambda v: (_like(v, r"^(?:\+|00|0|\()"), f"length({digits(v)}) between 9 and 14"),
    "secret": lambda v: (f"length({v}) >= 20 and length({digits(v)}) >= 3 and {_like(v, '[A-Za-z]')}", _like(v, "^[0-9a-f]+$|^[0-9A-F]+$|^(?=.*[a-z])(?=.*[A-Z])")),
    "iban": lambda v: (mod97(v), f"length(replace({v}, ' ', '')) between 15 and 34"),
}
DATE = r"^(?:19|20)[0-9]{2}[-/.\x20][01]?[0-9][-/.\x20][0-3]?[0-9]$|^[0-3]?[0-9][-/.\x20][01]?[0-9][-/.\x20](?:19|20)[0-9]{2}$"


def bits(kind: int, c: str) -> str:
    """What the trees see of a candidate."""
    v, name, n = f"{c}.value", ALL_KINDS[kind], f"length({digits(f'{c}.value')})"
    flags = [
        f"{n} >= 9",
        f"{n} >= 12",
        f"{n} >= 16",
        _like(v, r"[\x20-][^\x20-]+[\x20-]"),
        _like(v, r"[()\[\]{}]"),
        f"{c}.before = '' or {_like(f'{c}.before', r'[\s:(,;\x22\x27=]$')}",
        f"{c}.after = '' or {_like(f'{c}.after', r'^[\s),;\x22\x27]|^[.!?](?:\s|$)')}",
        _like(f"{c}.before", HINTS[name]),
        _like(f"{c}.before", OTHERS),
        *FORM[name](v),
        _like(f"{c}.before", r"[=:][\s\x22\x27]{0,2}$"),
        _like(v, DATE),
    ]
    return " + ".join([str(kind), *(f"CASE WHEN {f} THEN {8 << i} ELSE 0 END" for i, f in enumerate(flags))])


def _mask(kind: str) -> str:
    """A byte for each code point up to the last base match of the kind: b in a valid match, else a full stop."""
    return f"cast(array_join(transform(b_{kind}, c -> concat(repeat('.', c.gap), repeat(CASE WHEN {VALID[kind]('c.value')} THEN 'b' ELSE '.' END, cast(c.stop - c.start as int)))), '') as binary) AS m_{kind}"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed): base are array<struct<start, rank, stop>>, proposed, those that touch no base span, have bits too.

    Whether a candidate meets base matches is read off masks, so a text full of numbers costs no comparison of all pairs.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = located(rows, {f"{p}_{k}": x for p, patterns in (("b", BASE), ("l", LOOSE)) for k, x in patterns.items()})
    span = "'start', c.start, 'rank', {}, 'stop', c.stop"
    checked = [f"transform(filter(b_{k}, c -> {VALID[k]('c.value')}), c -> named_struct({span.format(i)}))" for i, k in enumerate(KINDS)]
    rows = rows.selectExpr("*", f"array_sort(concat({', '.join(checked)})) AS base", *map(_mask, KINDS))
    free = " and ".join(f"not contains(substring(m_{k}, cast(c.start + 1 as int), cast(c.stop - c.start as int)), X'62')" for k in KINDS)
    # what the base rules tried and dropped is a candidate as well
    sources = [(i, k, f"{p}_{k}") for i, k in enumerate(ALL_KINDS) for p in "bl" if p == "l" or k in KINDS]
    proposed = [f"transform(filter({source}, c -> {free}), c -> named_struct({span.format(i)}, 'bits', {bits(i, 'c')}))" for i, k, source in sources]
    return rows.selectExpr("doc_id", "base", f"array_sort(concat({', '.join(proposed)})) AS proposed")


def _luhn_digit(d: str) -> str:
    total = sum((k := int(c) * (2 - i % 2)) - 9 * (k > 9) for i, c in enumerate(reversed(d)))
    return str(-total % 10)


def _iban(r: random.Random) -> str:
    bank = "".join(r.choices(string.digits, k=18))
    country = r.choice(["DE", "FR", "ES", "GB", "NL"])
    number = "".join(str(int(c, 36)) for c in f"{bank}{country}00")
    return f"{country}{98 - int(number) % 97:02d}{bank}"


def examples(each: int = EACH, seed: int = 7) -> list[tuple[int, str, int, int, int, int]]:
    """(id, text, start, stop, rank, label): `each` texts of every format, with one planted span. label 1: personal data; 0: only looks like it."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choices(string.digits, k=n))
    word = lambda a=3, b=9: "".join(r.choices(string.ascii_lowercase, k=r.randint(a, b)))
    hexa = lambda n: "".join(r.choices("0123456789abcdef", k=n - 4)) + "1a2b"
    mixed = lambda n: "aB3" + "".join(r.choices(string.ascii_letters + string.digits, k=n - 3))
    octet = lambda: str(r.randint(1, 254))
    card = lambda: (d := r.choice("3456") + num(14)) + _luhn_digit(d)
    grouped = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    wrong = lambda d: d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)
    top = lambda: r.choice(["com", "org", "net", "de", "fr", "io"])
    good = {
        "email": [lambda: f"{word()} (at) {word()} (dot) {top()}", lambda: f"{word()}[at]{word()}[dot]{top()}", lambda: f"{word()}.{word()} at {word()} dot {top()}", lambda: f"{word()} @ {word()}.{top()}", lambda: f"{word()}é{num(2)}@{word()}.{top()}"],
        "ip": [lambda: "[.]".join(octet() for _ in range(4)), lambda: "(.)".join(octet() for _ in range(4)), lambda: ":".join(hexa(5)[:4] for _ in range(8)), lambda: f"2001:db8:{hexa(5)[:3]}:{hexa(5)[:4]}::{hexa(5)[:4]}"],
        "card": [lambda: grouped(card(), "."), lambda: grouped(card(), "/"), lambda: grouped(card(), "_"), lambda: grouped(card(), "  "), lambda: grouped(card(), " - ").replace(" - ", "- ")],
        "phone": [lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"0{num(3)}-{num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(4)} {num(2)}", lambda: f"0{num(2)}.{num(3)}.{num(4)}", lambda: f"0{num(9)}"],
        "secret": [lambda: hexa(40), lambda: hexa(32), lambda: mixed(40), lambda: "sk-" + mixed(32), lambda: "AKIA" + mixed(16).upper(), lambda: "ghp_" + mixed(36)],
        "iban": [lambda: _iban(r), lambda: grouped(_iban(r), " ")],
    }
    bad = {
        "email": [lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} @ {num(1)}.{num(2)}", lambda: f"{word()} (at) {word()}", lambda: f"{word()}@{word()}", lambda: f"{word()} at {num(2)}.{num(2)}"],
        "ip": [lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: ",".join(num(3) for _ in range(4)), lambda: f"{num(4)}.{num(3)}.{num(4)}.{num(4)}", lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", lambda: f"9{num(2)}[.]7{num(2)}[.]{num(2)}[.]{num(2)}"],
        "card": [lambda: wrong(card()), lambda: grouped(wrong(card()), "."), lambda: grouped(wrong(card()), " "), lambda: f"20{num(12)}", lambda: grouped(wrong(card()), "/")],
        "phone": [lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1950, 2030)}", lambda: f"{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"1{num(8)}", lambda: f"{num(5)}/{num(2)}/{num(3)}"],
        "secret": [lambda: f"{word(8, 12)}_{word(8, 12)}_{num(1)}", lambda: num(18), lambda: f"{word(5, 8)}-{word(5, 8)}-{word(5, 8)}-{num(2)}", lambda: f"{word(5, 8)}/{word(5, 8)}/{word(4, 6)}{num(2)}"],
        "iban": [lambda: wrong(_iban(r)), lambda: f"{word(2, 2).upper()}{num(2)} {num(4)} {num(4)}"],
    }
    hints = {"email": "email contact mail write", "ip": "ip address server host", "card": "card visa credit", "phone": "phone tel call fax mobile", "secret": "token key secret password", "iban": "iban account"}
    others = "version date isbn page section commit sha order invoice ticket chapter serial file".split()
    out = []
    for rank, kind in enumerate(ALL_KINDS):
        plain_hints = hints[kind].split()
        for label, formats in ((1, good[kind]), (0, bad[kind])):
            for form in formats:
                for _ in range(each):
                    # numbers alone say little: those without a check need a hint to count
                    needy = label and (kind == "secret" or form is good["phone"][-1])
                    hinted = r.random() < (1.0 if needy else 0.5 if label else 0.2)
                    lead = r.choice(plain_hints) if hinted else (r.choice(others) if not label and r.random() < 0.5 else word())
                    link = r.choice([": ", " ", " = ", ' = "', "=", " is "]) if hinted or r.random() < 0.3 else " "
                    front = " ".join([word() for _ in range(r.randint(0, 4))] + [lead]) + link
                    value = form()
                    tail = ('"' if link.endswith('"') else "") + r.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(r.randint(0, 4)))
                    out.append((len(out), front + value + tail, len(front), len(front) + len(value), rank, label))
        if kind == "secret":  # what looks the same and isn't: digests named as such, or without any name
            for _ in range(4 * each):
                front = f"{word()} {r.choice(['commit', 'sha', 'checksum', 'digest', 'md5', word()])}{r.choice([' ', ': ', '='])}"
                value = hexa(r.choice([32, 40]))
                out.append((len(out), f"{front}{value} {word()}", len(front), len(front) + len(value), rank, 0))
    return out


def learned(spark: SparkSession, each: int = EACH) -> tuple[Trees, dict[int, float]]:
    """Scores by bits and thresholds by kind, from the examples."""
    fields = ("doc_id", "text", "start", "stop", "rank", "label")
    data = json.dumps([dict(zip(fields, x, strict=True)) for x in examples(each)])
    kind = "array<struct<doc_id:long,text:string,start:long,stop:long,rank:int,label:int>>"
    texts = materialize(spark.range(1).select(F.explode(F.from_json(F.lit(data), kind)).alias("x")).select("x.*").repartition(8), "examples")
    found = materialize(candidates(texts), "examples_found").select("doc_id", F.explode("proposed").alias("c")).join(texts.drop("text").withColumnRenamed("rank", "planted"), "doc_id")
    both = F.least("c.stop", "stop") - F.greatest("c.start", "start")
    covers = (both >= 0.8 * (F.col("stop") - F.col("start"))) & (both >= 0.8 * (F.col("c.stop") - F.col("c.start")))
    right = (F.col("label") == 1) & (F.col("c.rank") == F.col("planted")) & covers
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    counts = found.groupBy(held.alias("held"), "c.bits", right.cast("int").alias("right")).count().orderBy("held", "bits", "right").collect()
    score = boost([(r["bits"], r["right"], r["count"]) for r in counts if not r["held"]])
    return score, thresholds(score, [(r["bits"], r["right"], r["count"]) for r in counts if r["held"]])


class Trees:
    """Boosted trees of depth two over bits: the log-odds of a pattern by index."""

    def __init__(self, first: float):
        self.first, self.trees = first, []

    def __getitem__(self, bits: int) -> float:
        return self.first + sum(leaves[bits >> root & 1][bits >> below[bits >> root & 1] & 1] for root, below, leaves in self.trees)


def boost(rows: list[tuple[int, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Trees from (bits, label, count), on the logistic loss."""
    cells: dict[int, list[float]] = {}
    for b, label, n in rows:
        cells.setdefault(b, [0.0, 0.0])[label] += n
    pos, neg = (sum(c[i] for c in cells.values()) for i in (1, 0))
    out = Trees(math.log((pos + 0.5) / (neg + 0.5)))
    score = dict.fromkeys(cells, out.first)

    def leaf(part: list[int]) -> tuple[float, float]:
        g = h = 0.0
        for b in part:
            g, h = g + slope[b][0], h + slope[b][1]
        return g * g / (h + 1.0), g / (h + 1.0)

    def best(part: list[int]) -> int | None:
        gain, at = leaf(part)[0] + 1e-9, None
        for bit in range(BITS):
            a, b = [x for x in part if x >> bit & 1], [x for x in part if not x >> bit & 1]
            if a and b and (new := leaf(a)[0] + leaf(b)[0]) > gain:
                gain, at = new, bit
        return at

    for _ in range(rounds):
        chance = {b: 1 / (1 + math.exp(-x)) for b, x in score.items()}
        slope = {b: (cells[b][1] - sum(cells[b]) * p, sum(cells[b]) * p * (1 - p)) for b, p in chance.items()}
        root = best(list(cells))
        if root is None:
            break
        below, leaves = [], []
        for side in (0, 1):
            part = [b for b in cells if b >> root & 1 == side]
            bit = best(part)
            below.append(root if bit is None else bit)
            leaves.append([rate * leaf([b for b in part if bit is None or b >> bit & 1 == s])[1] for s in (0, 1)])
        out.trees.append((root, below, leaves))
        for b in score:
            side = b >> root & 1
            score[b] += leaves[side][b >> below[side] & 1]
    return out


def thresholds(score: Trees, held: list[tuple[int, int, int]], precision: float = PRECISION) -> dict[int, float]:
    """Per kind the lowest score from which on at least `precision` of the candidates kept apart are right."""
    out = {}
    for kind in range(len(ALL_KINDS)):
        own = sorted(((score[b], label, n) for b, label, n in held if b & 7 == kind), reverse=True)
        right = wrong = 0
        for i, (s, label, n) in enumerate(own):
            right, wrong = right + n * label, wrong + n * (1 - label)
            if (i + 1 == len(own) or own[i + 1][0] < s) and right >= precision * (right + wrong):
                out[kind] = s
    return out


def selected(found: DataFrame) -> list[int]:
    """Bit patterns, of those that candidates have, that are redacted."""
    score, cut = learned(found.sparkSession)
    seen = found.select(F.explode("proposed").alias("c")).select("c.bits").distinct().collect()
    return sorted(r["bits"] for r in seen if r["bits"] & 7 in cut and score[r["bits"]] >= max(cut[r["bits"] & 7], 0.0))


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.rank + 1), cast(s.start as string), cast(s.stop as string))), ',')"


def _take(at: str, c: str) -> tuple[str, str]:
    span = f"array(named_struct('start', {c}.start, 'rank', {c}.rank, 'stop', {c}.stop))"
    return f"greatest({at}, {c}.stop)", f"CASE WHEN {at} <= {c}.start THEN {span} ELSE cast(array() as {FOUND}) END"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): sorted arrays of struct<start, rank, stop>; rank is the kind's place in ALL_KINDS."""
    found = materialize(candidates(docs), "candidates")
    patterns = ", ".join(map(str, selected(found) or [-1]))
    added = found.selectExpr("doc_id", "base", f"filter(proposed, c -> c.bits in ({patterns})) AS added")
    return added.selectExpr("doc_id", "base", f"array_sort(concat(base, {scanned('added', '0L', FOUND, _take)})) AS spans")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans as text, and how many those are."""
    counts = [f"cast(size(filter(base, s -> s.rank = {i})) as bigint) AS n_{k}" for i, k in enumerate(KINDS)]
    return find(docs).selectExpr("doc_id", *counts, f"sha2(cast({_text('base')} as binary), 256) AS base_sha256", f"{_text('spans')} AS spans", "cast(size(spans) as bigint) AS n_spans")
