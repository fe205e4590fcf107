"""WARC archives: write captures as transactions of records, read them back, and assemble one nested row per capture.

Each capture is three records that follow one another: a request; a response, or a revisit if an earlier capture has an
equal payload; and metadata. Request and metadata name the response or revisit in WARC-Concurrent-To; a revisit names the
response whose payload it shares in WARC-Refers-To and has no payload itself. Every record is a gzip member of its own
(WARC/1.1), so archives can be read from any record on.

Payload groups are found from digests alone, by an aggregate that combines before the shuffle and a join by digest, which
AQE splits where one payload has very many captures. Each task writes its archives under temporary names and renames
them, so a retried task replaces its own files. Assembly joins the three kinds of records by the identifier that
they share; each identifier has one record of each kind.

Null payloads are empty. Payloads below `least` bytes are always responses. Of equal payloads the smallest page_id is the
response; rows with a null page_id are responses. Rows with the same page_id are numbered in the order of their payload
digests and other columns, so a retry repeats the numbers, and each have their own records; of those with equal payloads the
first is the response. Only rows of repeated page_ids move for that, all of one page_id to one task. Very long payloads are
written and read whole, a record at a time; a batch of records read ends after 8 MB. Of the other columns only `url` is written, whatever names
the others have. Records with a missing partner give nulls there. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import filesystem, fresh, materialize, publish, rows_of, sweep, tune

LEAST = 100
LEVEL = 1
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def classify(pages: DataFrame, payload: str = "html", least: int = LEAST) -> DataFrame:
    """pages with payload_bytes, payload_digest, row_in_page, record_type, refers_to and refers_to_row."""
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha2(body, 256))
    repeated = materialize(rows.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id"), "repeated")
    if repeated.limit(1).count():
        order = ["payload_digest", *(c for c in pages.columns if c not in ("page_id", payload, "payload_digest"))]
        several = rows.join(repeated, "page_id", "left_semi").withColumn("row_in_page", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)) - 1)
        rows = rows.join(repeated, "page_id", "left_anti").withColumn("row_in_page", F.lit(0)).union(several)
    else:
        rows = rows.withColumn("row_in_page", F.lit(0))
    firsts = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "row_in_page")).alias("first"), F.count("*").alias("captures")).where("captures > 1")
    firsts = materialize(firsts.select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.row_in_page").alias("first_row")), "firsts")
    out = rows.join(firsts, "payload_digest", "left")
    other = (F.col("page_id") != F.col("first_id")) | (F.col("row_in_page") != F.col("first_row"))
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & other & (F.col("payload_bytes") >= least)
    out = out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    return out.withColumns({"refers_to": F.when(revisit, F.col("first_id")), "refers_to_row": F.when(revisit, F.col("first_row"))}).drop("first_id", "first_row")


def record_id(kind: str, page_id: object, number: int = 0) -> str:
    """The same for the same record in every attempt."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}/{page_id}/{number}')}>"


def record(kind: str, identity: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {identity}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def _header_value(text: str) -> str:
    """A URL as one header line: what would break it is percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def transaction(page_id: object, number: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_to_row: int = 0) -> bytes:
    """A capture's three records."""
    kind = "response" if refers_to is None else "revisit"
    own = record_id("capture", page_id, number)
    target = {"WARC-Target-URI": _header_value(url)} if url else {}
    common = {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        main = record(kind, own, target | common, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload)
    else:
        main = record(kind, own, target | common | {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id("capture", refers_to, refers_to_row)}, b"HTTP/1.1 200 OK\r\n\r\n")
    beside = {"WARC-Concurrent-To": own}
    get = record("request", record_id("request", page_id, number), target | beside | {"Content-Type": "application/http; msgtype=request"}, f"GET {_header_value(url) or '/'} HTTP/1.1\r\n\r\n".encode())
    fields = [f"page-id: {'' if page_id is None else page_id}", f"payload-length: {len(payload)}", f"refers-to-page: {'' if refers_to is None else refers_to}"]
    about = record("metadata", record_id("metadata", page_id, number), target | beside | {"Content-Type": "application/warc-fields"}, ("\r\n".join(fields) + "\r\n").encode())
    return get + main + about


def write(pages: DataFrame, out: str, url: str = "url", payload: str = "html", least: int = LEAST) -> list[str]:
    """Write all pages as archives in `out`; the archives' names. Row numbers tell rows of one page_id apart."""
    tune(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("html"))
    rows = classify(slim, "html", least)
    rows = rows.select("page_id", "url", "html", "payload_digest", "refers_to", "row_in_page", "refers_to_row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        part, stream, temporary, held, names = TaskContext.get().partitionId(), None, "", 0, []

        def close() -> None:
            stream.close()
            names.append(f"captures-{part:05d}-{len(names):03d}.warc.gz")
            publish(fs, temporary, f"{root}/{names[-1]}")

        number = 0
        for b in batches:
            ids, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            html = b.column(2).cast(pa.large_binary()).to_pylist()
            for page_id, address, body, digest, refers, row, refers_row in zip(ids, urls, html, *(b.column(i).to_pylist() for i in range(3, 7)), strict=True):
                if stream is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    stream, held = fs.open_output_stream(temporary), 0
                stream.write(transaction(page_id, row if page_id is not None else f"{part}.{(number := number + 1)}", address or "", body or b"", digest, refers, refers_row or 0))
                held += len(body or b"")
                if held >= ARCHIVE_BYTES:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    names = sorted(r["name"] for r in rows.mapInArrow(run, "name string").collect())
    sweep(out)
    return names


def parse(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive; gzip members follow one another."""
    held, inflate = b"", zlib.decompressobj(31)
    plain = bytearray()
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                break
        plain += inflate.decompress(held)
        held = inflate.unused_data
        if inflate.eof:
            head, _, rest = bytes(plain).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            yield headers, rest[: int(headers["content-length"])]
            inflate, plain = zlib.decompressobj(31), bytearray()
    if plain:
        raise ValueError("an archive ends within a record")


_RECORD = "kind string, id string, capture string, url string, refers_to_id string, digest string, stored_digest string, payload_bytes long, page_id long, refers_to long, payload binary"


def records(spark: SparkSession, out: str, names: list[str], with_payload: bool = True) -> DataFrame:
    """A row per record of the archives. `digest` is of the payload as read; `capture` is what the three records share."""
    kept = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _RECORD.split(", ")])

    def one(h: dict[str, str], block: bytes) -> tuple:
        kind, page, refers, size, digest, payload = h["warc-type"], None, None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        elif kind == "metadata":
            fields = dict(x.partition(": ")[::2] for x in block.decode().split("\r\n") if x)
            page, size, refers = (int(fields[k]) if fields[k] else None for k in ("page-id", "payload-length", "refers-to-page"))
        stored = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if digest is not None and digest != stored:
            raise ValueError(f"payload digest of {h['warc-record-id']} differs")
        return kind, h["warc-record-id"], h.get("warc-concurrent-to", h["warc-record-id"]), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, stored, size, page, refers, payload if with_payload else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in parse(stream):
                        rows.append(one(h, block))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kept, strict=True)], schema=kept)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kept, strict=True)], schema=kept)

    return rows_of(spark, [(n,) for n in names], "name string", max(1, len(names))).mapInArrow(run, _RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """A nested row per capture: (capture, url, request, response, metadata), joined by the identifier they share."""
    rows = materialize(rows, "records")
    main = rows.where(F.col("kind").isin("response", "revisit")).select("capture", "url", F.struct("id", F.col("kind").alias("type"), "refers_to_id", F.coalesce("digest", "stored_digest").alias("payload_digest"), "payload_bytes", "payload").alias("response"))
    request = rows.where("kind = 'request'").select("capture", F.struct("id").alias("request"))
    about = rows.where("kind = 'metadata'").select("capture", F.struct("id", "page_id", "payload_bytes", "refers_to").alias("metadata"))
    return main.join(request, "capture", "left").join(about, "capture", "left").select("capture", "url", "request", "response", "metadata")


def round_trip(pages: DataFrame, out: str | None = None, url: str = "url", payload: str = "html", least: int = LEAST, with_payload: bool = True) -> DataFrame:
    """Write pages to archives, read these back, and assemble the captures."""
    spark = pages.sparkSession
    out = out or fresh(spark, "warc")
    return assemble(records(spark, out, write(pages, out, url, payload, least), with_payload))
