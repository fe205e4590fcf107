"""Files that need care, tables that survive crashes, streams that may be run again."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import files, store
from quillon.streaming import ingest


def test_csv_counts_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("1;\"café; € bar\"\n2;x;extra\n3;y\n".encode("cp1252"))
    rows, rejects = files.csv(spark, str(tmp_path / "a.csv"), ["id", "name"])
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "café; € bar"), ("3", "y")]
    assert [r.line for r in rejects.collect()] == ["2;x;extra"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "1;a\n2;€é\n".encode("cp1252"))
        z.writestr("readme.txt", "no")
    lines = files.zip_members(spark, str(tmp_path / "*.zip"))
    got = files.split_lines(lines, ["id", "name"]).orderBy("number").collect()
    assert [(r.archive, r.member, r.number, r.id, r.name) for r in got] == [("a.zip", "x.csv", 1, "1", "a"), ("a.zip", "x.csv", 2, "2", "€é")]
    with pytest.raises(Exception, match="unpacks"):
        files.zip_members(spark, str(tmp_path / "*.zip"), limit=3).collect()


def test_transcode_counts(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"a\x80\x81\xe9\x9d\x9f")
    r = files.transcode(spark, str(tmp_path / "t.bin")).first()
    assert (r.text, r.mapped, r.replaced) == ("a€�é�Ÿ", 2, 2)


def test_json_items_and_newest_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1, "d": "x"}, {"id": 2, "d": "y"}]}')
    assert {(r.id, r.d) for r in files.json_items(spark, str(tmp_path / "a.json"), "items", "id:int,d:string").collect()} == {(1, "x"), (2, "y")}
    for name, day, v in (("a", "2024-01-01", "old"), ("b", "2024-01-02", "new"), ("c", "2024-01-02", "tie")):
        spark.createDataFrame([(1, day, v)], "id int, d string, v string").coalesce(1).write.parquet(str(tmp_path / f"p/{name}"))
    rows = spark.read.parquet(*(str(tmp_path / f"p/{n}") for n in "abc"))
    assert files.newest_file_wins(rows, ["id"], "d").count() == 1 and files.newest_file_wins(rows, ["id"], "d").first().v in ("new", "tie")
    wide = files.parquet(spark, str(tmp_path / "p/a"), by_name=True)
    assert files.catalog_overview(spark, {"a": wide}).first().rows == 1


def test_hierarchy(spark):
    df = spark.createDataFrame(list(enumerate(["A", "01", "011", "0111", "02", "021"])), "o int, code string")
    out = files.code_hierarchy(df, "code", "o", {1: "section", 2: "division", 3: "group"}).orderBy("o").collect()
    assert [(r.section, r.division, r.group) for r in out] == [("A", None, None), ("A", "01", None), ("A", "01", "011"), ("A", "01", "011"), ("A", "02", None), ("A", "02", "021")]


def test_table_survives_crashes_and_upserts(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    df = lambda *rows: spark.createDataFrame(list(rows), "id int, v string, at int")
    t.replace(df((1, "a", 1), (2, "b", 1)))

    def crash(at):
        def fail(step):
            if step == at:
                raise RuntimeError(at)

        return fail

    for step, expected in (("written", {(1, "a"), (2, "b")}), ("moved", {(9, "z")})):
        with pytest.raises(RuntimeError):
            t.replace(df((9, "z", 1)), fail=crash(step))
        assert {(r.id, r.v) for r in t.read().collect()} == expected
    t.replace(df((1, "a", 1), (2, "b", 1)))
    for _ in range(2):  # twice the same
        t.upsert(df((2, "c", 2), (3, "d", 1), (2, "old", 0)), ["id"], [F.desc("at")])
        assert {(r.id, r.v) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert t.upsert_changed(df((2, "c", 2), (3, "e", 1), (4, "n", 1)), ["id"]) == 2
    assert t.upsert_changed(df((2, "c", 2)), ["id"]) == 0
    t.update(F.col("id") == 1, {"v": F.lit("A")})
    t.add_column("extra", "string")
    assert {(r.id, r.v, r.extra) for r in t.read().collect()} == {(1, "A", None), (2, "c", None), (3, "e", None), (4, "n", None)}
    t.replace_sources(spark.createDataFrame([(7, "q", 2)], "id int, v string, at int"), "at")
    assert {r.id for r in t.read().collect()} == {1, 3, 4, 7}
    t.append(df((8, "w", 1)).withColumn("extra", F.lit(None).cast("string")))
    before, after = t.compact(sort_by=["id"])
    assert before >= after == 1


def test_partitions_pending_manifest_cache(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "p"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string")
    t.overwrite_partitions(a, ["k"])
    t.overwrite_partitions(spark.createDataFrame([(5, "y")], "v int, k string"), ["k"])
    assert {(r.v, r.k) for r in t.read().collect()} == {(1, "x"), (5, "y")}
    assert [r.v for r in store.pending(a, a.where("v = 1"), ["v"]).collect()] == [2]
    m = store.manifest({"a": a, "same": a.orderBy(F.desc("v"))}, version="1").collect()
    assert m[0].digest == m[1].digest and m[0].rows == 2
    assert a.select(store.row_hash(["v", "k"]).alias("h")).distinct().count() == 2
    cache, built = store.Cache(spark, str(tmp_path / "c")), []

    def build():
        built.append(1)
        return a

    assert cache.get("s", build, {"n": 1}).count() == cache.get("s", build, {"n": 1}).count() == 2 and len(built) == 1
    cache.get("s", build, {"n": 2})
    assert len(built) == 2 and cache.status({"s": cache.path("s", {"n": 1})}).first().ready
    assert "IS DISTINCT FROM" in store.load_statements(a, "t", ["k"])[1] and "REPLACE" in store.load_statements(a, "t", ["k"], "duckdb")[1]


def test_streamed_upsert_is_idempotent(spark, tmp_path):
    src, t = str(tmp_path / "in"), store.Table(spark, str(tmp_path / "out"))
    write = lambda rows: spark.createDataFrame(rows, "id int, at int, v string").coalesce(1).write.mode("append").parquet(src)
    write([(1, 1, "a"), (2, 1, "b")])
    schema = spark.read.parquet(src).schema

    def run(checkpoint):
        ingest.upsert_into(ingest.files(spark, src, schema), t, ["id"], [F.desc("at")], str(tmp_path / checkpoint)).awaitTermination()
        return {(r.id, r.v) for r in t.read().collect()}

    assert run("c1") == {(1, "a"), (2, "b")}
    write([(2, 2, "c"), (1, 0, "older")])
    assert run("c1") == run("c1") == run("c2") == {(1, "a"), (2, "c")}
    ingest.append_once(ingest.files(spark, src, schema), str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_stream_forgets_duplicates(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id int, t string").withColumn("t", F.to_timestamp("t")).write.parquet(src)
    stream = ingest.deduplicated(ingest.files(spark, src, spark.read.parquet(src).schema), ["id"], "t", "10 minutes")
    q = stream.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 2
