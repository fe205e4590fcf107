"""Reading files that need care: CSV with a reject count, zip members, cp1252 bytes, big JSON arrays, newest file wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.panel import keep_latest

#: cp1252 code points of the bytes 0x80 to 0x9F that have one.
CP1252_GAPS = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def parquet(spark: SparkSession, *paths: str, by_name: bool = False, base: str | None = None) -> DataFrame:
    """One or several files, folders or globs; folders named key=value become columns; by_name aligns differing schemas."""
    reader = spark.read.option("mergeSchema", str(by_name).lower())
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def file_name() -> Column:
    """The base name of the file that a row comes from."""
    return F.substring_index("_metadata.file_path", "/", -1)


def csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", encoding: str = "iso-8859-1", header: bool = False, cp1252: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): all columns as text by position; lines with another number of fields are rejects, whole.

    With cp1252 the control characters that ISO 8859-1 gives bytes 0x80-0x9F become what cp1252 means by them.
    Rejects are kept, not just dropped, so that they can be counted and read. Multi-line fields are not allowed: files can be split.
    """
    reader = spark.read.schema("line string").option("sep", "\x01").option("quote", "").option("encoding", encoding).option("header", header)
    line = F.col("line")
    if cp1252:
        controls = range(0x80, 0xA0)
        line = F.translate(line, "".join(map(chr, controls)), "".join("\ufffd" if i in CP1252_GAPS else bytes([i]).decode("cp1252") for i in controls))
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_line", T.StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    parsed = reader.csv(path).select(line.alias("line"), F.from_csv(line, schema.toDDL(), options).alias("_f"))
    bad = F.col("_f._line").isNotNull()
    return parsed.where(~bad).select(*(F.col(f"_f.{c}").alias(c) for c in columns)), parsed.where(bad).select("line")


def write_csv(df: DataFrame, path: str, sep: str = ";", compression: str = "gzip", header: bool = False) -> None:
    """A folder of CSV files in UTF-8, every field quoted, quotes doubled; null is an empty field without quotes."""
    df.write.option("sep", sep).option("quote", '"').option("escape", '"').option("quoteAll", "true").option("emptyValue", '""').option("compression", compression).option("header", header).csv(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".csv", encoding: str = "cp1252", limit: int = 1 << 31) -> DataFrame:
    """(archive, member, number, line) of all text members of zip archives; one task holds an archive's compressed bytes (2 GB at most) and unpacks a line at a time.

    A member whose stated size exceeds `limit` is refused, so an archive can't unpack without bound.
    """
    schema = "archive string, member string, number long, line string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(suffix):
                            continue
                        if info.file_size > limit:
                            raise ValueError(f"{info.filename} unpacks to {info.file_size} bytes")
                        rows, n = [], 0
                        with z.open(info) as f:
                            for n, line in enumerate(io.TextIOWrapper(f, encoding, errors="replace", newline=""), 1):
                                rows.append((name.rsplit("/", 1)[-1], info.filename, n, line.rstrip("\r\n")))
                                if len(rows) >= 20_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "number", "line"])
                                    rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["archive", "member", "number", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def split_lines(lines: DataFrame, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Fields of lines by position with from_csv: the same rules as `csv` for lines that came another way."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return lines.withColumn("_f", F.from_csv("line", schema, {"sep": sep, "quote": '"', "escape": '"'})).select(*(c for c in lines.columns if c != "line"), "_f.*")


def transcode(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, mapped, replaced): bytes 0x80-0x9F read as cp1252, those without a character as U+FFFD, both counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gaps = bytes(CP1252_GAPS)
        for b in batches:
            out = []
            for name, content in zip(b["path"], b["content"], strict=True):
                replaced = sum(content.count(bytes([g])) for g in gaps)
                c1 = sum(0x80 <= x <= 0x9F for x in content)
                table = {g: "�" for g in CP1252_GAPS}
                text = "".join(table.get(x) or bytes([x]).decode("cp1252") if 0x80 <= x <= 0x9F else chr(x) for x in content)
                out.append((name, text, c1 - replaced, replaced))
            yield pd.DataFrame(out, columns=["path", "text", "mapped", "replaced"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, mapped long, replaced long")


def json_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """A row per element of an array field of JSON documents, with the given element schema."""
    whole = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", "true").json(path)
    return whole.select(F.explode(field).alias("x")).select("x.*")


def newest_file_wins(rows: DataFrame, keys: Sequence[str], dated: str) -> DataFrame:
    """One row per key: the latest date, then the largest file name; rows need `_metadata`, so use it right on a scan."""
    return keep_latest(rows.withColumn("_file", file_name()), keys, [F.desc_nulls_last(dated), F.desc("_file")]).drop("_file")


def catalog_overview(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, columns, types, rows) of tables; rows are counted from file footers where the source has them."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), F.lit(len(df.columns)).alias("columns"), F.lit(", ".join(t for _, t in df.dtypes)).alias("types"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def code_hierarchy(rows: DataFrame, code: str, order: str, levels: dict[int, str]) -> DataFrame:
    """Fill each level's code down a listing in which the length of a code tells its level (2 division, 3 group, ...)."""
    from pyspark.sql import Window

    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {name: F.last(F.when(F.length(code) == n, F.col(code)), ignorenulls=True).over(w) for n, name in levels.items()}
    deeper = {name: F.when(F.length(code) >= n, c) for (n, name), c in zip(levels.items(), filled.values(), strict=True)}
    return rows.withColumns(deeper)
