"""Hand-computed results and invariants of the operators."""

import hashlib
import hmac
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import catalog, tables
from quillon.functions import bands, ids, text
from quillon.operators import concentration, joins, panel, records, registry, suppress, survival
from quillon.stats import hypothesis_tests, models, special


def one(df):
    return df.first()


def test_bands_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.1, 2.0, 2.1, 5.0, 10.0, 10.5)], "x double")
    got = [r[0] for r in rows.select(bands.age_band(F.col("x"))).collect()]
    assert got == [None, None, None, "0-2", "0-2", "2-5", "2-5", "5-10", ">10"]


def test_month_arithmetic(spark):
    r = one(spark.range(1).select(bands.month_shift(F.lit(202411), 3), bands.month_shift(F.lit(202401), -1), bands.months_between_boundaries(F.lit("2024-01-31").cast("date"), F.lit("2024-03-01").cast("date")), bands.week_ending_sunday(F.lit("2024-01-03").cast("date")).cast("string")))
    assert list(r) == [202502, 202312, 2, "2024-01-07"]


def test_identifiers(spark):
    rows = spark.createDataFrame([("11.222.333/0001-81",), ("11222333000181",), ("1222333000181",), ("11111111111111",), ("12ABC34501DE35",), ("short",), (None,)], "raw string")
    got = [(r[0], r[1]) for r in rows.select(ids.normalize_id(F.col("raw")).alias("i")).select("i", ids.firm_id_ok(F.col("i"))).collect()]
    assert got[0] == got[1] == ("11222333000181", True)
    assert got[2][0] == "01222333000181" and got[3] == ("11111111111111", False) and got[4] == ("12ABC34501DE35", True)
    assert got[5] == got[6] == (None, None)
    p = spark.createDataFrame([("52998224725",), ("52998224724",), ("00000000000",)], "p string").select(ids.person_id_ok(F.col("p"))).collect()
    assert [r[0] for r in p] == [True, False, False]


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long key " * 20])
def test_hmac(spark, key):
    for message in ("", "a", "é" * 100):
        assert one(spark.createDataFrame([(message,)], "m string").select(ids.hmac_sha256(F.col("m"), key)))[0] == hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def test_codes_and_masks(spark):
    r = one(spark.range(1).select(ids.code(F.lit(" 007 ")), ids.code(F.lit("000")), ids.code(F.lit("000"), False), ids.code(F.lit(" ")), ids.case_mask(F.lit("1234567-89.2020.8.26.0100")), ids.case_mask(F.lit("1"))))
    assert list(r) == ["007", None, "000", None, "1234567-89.2020.8.26.0100", "0000000-00.0000.0.00.0001"]


def test_text_functions(spark):
    r = one(
        spark.range(1).select(
            text.fold_accents(F.lit("Ação é")), text.first_line(F.lit("\n  one \ntwo")), text.snippet(F.lit("a" * 300 + " x  y needle z"), "needle", 6), text.chunks(F.lit("1. a\n2. b\n3. a\n")), text.parties(F.lit("A, -, B ,")),
            text.natural_person(F.lit("Foo Ltda")), text.natural_person(F.lit("Ana Mello")), text.currency(F.lit("R$ 1.234,56")), text.currency(F.lit("abc")), text.normalize_place(F.lit("Forum of Sto. Ângelo (2nd)")), text.token_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))),
            text.json_strings(F.lit("not json")), text.unescape_html(F.lit("a &amp; &eacute;")), text.fold_nfkd(F.lit("ﬁn é")),
        )
    )
    assert list(r) == ["Acao e", "one", "x y needle z", ["a", "b"], ["A", "B"], False, True, 1234.56, None, "saint angelo", 0.5, [], "a & é", "fin e"]


def test_suppression_pools_from_rows(spark):
    rows = [("a", "x", f"f{i}", 1) for i in range(9)] + [("a", "y", f"f{i}", 1) for i in range(3)] + [("a", "z", f"f{i}", 1) for i in (1, 2, 3, 8)] + [("b", "x", "g", 1), ("b", None, "h", 1)]
    df = spark.createDataFrame(rows, "k string, s string, firm string, v int")
    got = {(r.k, r.s): (r.units, r.v, r.suppressed) for r in suppress.suppress(df, ["k", "s"], "firm", {"v": F.sum("v")}).collect()}
    # y has f0-f2, z has f1-f3 and f8: five distinct firms in the pool, not seven
    assert got == {("a", "x"): (9, 9, False), ("a", "(pooled)"): (5, 7, False), ("b", "(pooled)"): (None, None, True)}
    whole = {(r.k, r.s) for r in suppress.suppress(df, ["k", "s"], "firm", {"v": F.sum("v")}, whole=True).collect()}
    assert whole == {("a", "(pooled)"), ("b", "(pooled)")}


def test_publication_guard(spark):
    df = spark.createDataFrame([(1, "x")], "id long, email string")
    with pytest.raises(suppress.PublishError):
        suppress.assert_public(df.select("id", F.struct("email").alias("inner")))
    assert suppress.assert_public(df.select("id")).columns == ["id"]


def test_kaplan_meier_by_hand(spark):
    rows = spark.createDataFrame([(1, True), (1, False), (2, True), (3, True), (3, True), (-1, True), (None, True)], "t int, e boolean")
    got = {r.t: (r.d, r.c, r.n, round(r.incidence, 9)) for r in survival.kaplan_meier(survival.event_table(rows, "t", "e"), least=1).collect()}
    assert got == {1: (1, 1, 5, 0.2), 2: (1, 0, 3, round(1 - 0.8 * 2 / 3, 9)), 3: (2, 0, 2, 1.0)}
    few = survival.kaplan_meier(survival.event_table(rows, "t", "e"), least=3).collect()
    assert [r.incidence is None for r in sorted(few)] == [False, False, True]


def test_gini_forms_agree(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([1, 1, 2, 5, 11])], "g string, u int, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    exact = sum(abs(a - b) for a in (1, 1, 2, 5, 11) for b in (1, 1, 2, 5, 11)) / (2 * 5 * 20)
    a = one(concentration.gini(rows, "v", ["g"], "u")).gini
    b = one(concentration.gini_by_value(rows, "v", ["g"])).gini
    c = one(concentration.gini_trapezoid(rows, "v", ["g"], "u")).gini_trapezoid
    assert abs(a - exact) < 1e-12 and abs(b - exact) < 1e-12 and abs(c - exact - 1 / 20 / 5) < 1e-12
    assert one(concentration.top_share(rows, "v", ["g"], "u", 0.01)).top_share == 11 / 20
    assert one(concentration.units_for(rows, "v", ["g"], "u")).units_needed == 1


def test_contiguous_lag(spark):
    rows = spark.createDataFrame([(1, 2000, 1), (1, 2001, 2), (1, 2003, 3)], "id int, year int, v int")
    assert [r[0] for r in rows.select("year", panel.contiguous_lag("v", "id", "year").alias("x")).orderBy("year").select("x").collect()] == [None, 1, None]


def test_soft_link_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    day = lambda: f"2024-01-{rng.randrange(1, 29):02d}"
    left, right = [(i, rng.choice("ab"), day()) for i in range(40)], [(rng.choice("abc"), day()) for _ in range(15)]
    got = {r.days: (r.unique_links, r.ambiguous, r.none) for r in joins.soft_link(spark.createDataFrame(left, "k int, p string, d string").withColumn("d", F.to_date("d")), spark.createDataFrame(right, "p string, e string").withColumn("e", F.to_date("e")), "k", "p", "d", "e", (0, 3, 9)).collect()}
    for n in (0, 3, 9):
        blocks = [sum(p == q and abs(int(d[-2:]) - int(e[-2:])) <= n for q, e in right) for _, p, d in left]
        assert got[n] == (blocks.count(1), sum(b > 1 for b in blocks), blocks.count(0))


def rows_joined(node):
    """Rows that the joins of a plan made when it ran."""
    kind = node.getClass().getSimpleName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return sum(map(rows_joined, below)) + (node.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0)


def test_soft_link_makes_no_pairs(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("p").alias("p"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("d"))
    out = joins.soft_link(rows, rows.select("p", F.col("d").alias("e")), "k", "p", "d", "e", (0, 3))
    assert sorted(map(tuple, out.collect())) == [(0, 0, 1000, 0), (3, 0, 1000, 0)]
    assert rows_joined(out._jdf.queryExecution().executedPlan()) == 1000


def test_softlink_blocks_equals_sql_on_odd_rows(spark, tmp_path):
    """Ids that repeat or are missing, no date, no segment, no firm, firms below 0, days at the ends of the calendar."""
    import datetime
    import random

    rng = random.Random(2)
    days = [None, datetime.datetime(1, 1, 1), datetime.datetime(9999, 12, 31, 23, 59), *(datetime.datetime(2024, 2, 1) + datetime.timedelta(hours=h) for h in range(0, 4000, 37))]
    orders = [(rng.choice([None, *range(150)]), rng.choice([None, *range(-6, 7)]), "O", 1.0, rng.choice(days), rng.choice([None, "", *"abcdefgh"])) for _ in range(200)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    lonely = [(1, 1, "O", 1.0, days[9], "a"), (2, 1, "O", 1.0, days[9], "b"), (None, 2, "O", 1.0, days[9], "a"), (3, 2, "O", 1.0, days[9], "b")]
    for name, rows in (("odd", orders), ("lonely", lonely), ("left", lonely[:2]), ("right", lonely[2:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        duck = duckdb.connect()
        for t in tables.NAMES:
            at = f"{tmp_path}/{name}/orders.parquet/*.parquet" if t == "orders" else f"/root/testdata/sf0.001/{t}.parquet"
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
        want = duck.sql(catalog.oracles()["softlink_blocks"])
        got = catalog.queries()["softlink_blocks"](spark, f"{tmp_path}/{name}").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name


def test_redaction_settles_overlaps(spark):
    assert records.resolve_spans([(0, 3, 1, "a"), (0, 5, 2, "b"), (4, 9, 0, "c"), (5, 6, 0, "d")]) == [(0, 5, 2, "b"), (5, 6, 0, "d")]
    df = spark.createDataFrame([(1, "Ana Lima, id 12345678901, of Lima Motors Ltda", ["Ana Lima", "Lima"]), (2, None, None)], "id int, t string, names array<string>")
    out = {r.id: (r.t, r.n_redacted) for r in records.redact_spans(df, "t", [(r"\b\d{11}\b", "[ID]")], "names", r"\w+ Motors Ltda").collect()}
    assert out == {1: ("[NAME], id [ID], of Lima Motors Ltda", 2), 2: (None, 0)}


def test_mentions(spark):
    good, other = "11.222.333/0001-81", "11444777000161"
    df = spark.createDataFrame([(1, f"suit against Acme Works, {good}."), (2, f"certificates {good}, {other}, {good}"), (3, "number 11.222.333/0001-82"), (4, None)], "id int, t string")
    got = [(r.id, r.firm, r.rule) for r in records.extract_mentions(df, "id", "t").collect()]
    assert got == [(1, "11222333000181", "opponent")]


def test_moves_keep_parents_without_any(spark):
    df = spark.createDataFrame([(1, '[{"d":"x","k":"a"},{"d":"y","k":"b"}]'), (2, "[]"), (3, "broken"), (4, None)], "id int, m string")
    got = sorted((r.id, r.d, r.k) for r in records.explode_moves(df, "id", "m", "d string, k string").select("id", F.coalesce("d", F.lit("")).alias("d"), F.coalesce("k", F.lit("")).alias("k")).collect())
    assert got == [(1, "x", "a"), (1, "y", "b"), (2, "", ""), (3, "", ""), (4, "", "")]


def test_export_policies(spark):
    df = spark.createDataFrame([(i, "p" if i < 6 else "q", "n") for i in range(8)], "id int, place string, name string")
    out = registry.export(df, {"id": "hash", "place": "k", "name": "suppress"}, b"k", ["place"], 3)
    assert sorted(r.place or "" for r in out.collect()) == ["", ""] + ["p"] * 6 and {r.name for r in out.collect()} == {None}
    edges = registry.partner_edges(spark.createDataFrame([("f", "entity", "11.222.333/0001-81", "x"), ("f", "person", "***1", " ana ")], "firm string, kind string, document string, name string"))
    assert {(r.target, r.approximate_key) for r in edges.collect()} == {("11222333000181", False), ("***1|ANA", True)}
    with pytest.raises(ValueError):
        registry.aggregate(df, [], "median:id")


def test_tails():
    assert abs(special.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10 and abs(special.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-10
    assert abs(special.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-10 and abs(special.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-10
    assert [special.stars(p) for p in (None, 0.0001, 0.005, 0.02, 0.5)] == ["", "***", "**", "*", ""]


def test_benjamini_hochberg_monotone(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    got = {r.p: r.adjusted for r in hypothesis_tests.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert got[None] is None and all(abs(got[k] - v) < 1e-12 for k, v in {0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04}.items())


def test_fisher_and_guards(spark):
    assert abs(hypothesis_tests.fisher_exact(8, 2, 1, 5) - 0.03496503496503495) < 1e-10
    flat = spark.createDataFrame([(1.0, 2.0)] * 6, "x double, y double")
    assert one(hypothesis_tests.correlation(flat, "x", "y")).r is None
    assert hypothesis_tests.kruskal_wallis(flat.withColumn("g", F.lit("a")), "x", "g").count() == 0


def test_regressions_recover_slopes(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x = rng.gauss(0, 1)
        rows.append((x, 2 + 3 * x + rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-(0.5 + x)))), i % 30))
    df = spark.createDataFrame(rows, "x double, y double, z int, g int")
    o = {r.term: r for r in models.ols(df, "y", ["x"], cluster="g").collect()}
    assert abs(o["x"].estimate - 3) < 0.1 and abs(o["(intercept)"].estimate - 2) < 0.1 and o["x"].p < 1e-6
    g = {r.term: r for r in models.logit(df, "z", ["x"]).collect()}
    assert abs(g["x"].estimate - 1) < 0.2 and abs(g["(intercept)"].estimate - 0.5) < 0.2
    assert one(models.icc(df, "y", "g")).icc < 0.05
    assert {r.term: round(r.vif, 1) for r in models.vif(df.withColumn("w", F.rand(1)), ["x", "w"]).collect()} == {"x": 1.0, "w": 1.0}


def test_confidence_set_drops_the_worse_model(spark):
    import random

    rng = random.Random(4)
    rows = [(m, t, abs(rng.gauss(0, 1)) + (3 if m == "bad" else 0)) for t in range(60) for m in ("a", "b", "bad")]
    got = {r.model: r.kept for r in models.confidence_set(spark.createDataFrame(rows, "m string, t int, l double"), "m", "t", "l").collect()}
    assert got["bad"] is False and (got["a"] or got["b"])
