"""WARC archives: writing, reading, and resolving equal payloads into revisit records.

Archives are written through Spark's text sink, so they may lie in any store that Spark
reaches, and a task that is lost is simply run again.  A record ends with CR LF CR LF;
that is the sink's line separator, so each file is a plain (gzip-compressed) WARC file.
Reading goes by ``Content-Length``, never by separators, so payloads may hold anything.

Every record has an id of its own, and decisions are about records, so rows that share a
page_id keep their payloads.  Payloads are equal if length, SHA-1 and SHA-256 are.

A file holds at most ``RECORDS_PER_FILE`` records of up to ``LARGE_BYTES``; larger ones lie
in files of their own kind, one for each eightfold size, of so few records that they too stay
within ``FILE_BYTES`` (or hold one).  So the file that a task holds in memory is bounded in
bytes, whatever a page is, and a large page makes no small files of the others.  Files come to a
task in Arrow batches that Spark bounds in bytes, and are unpacked one after the other.

Defined results: a null html is the empty payload; a null or empty url has no
``WARC-Target-URI``; rows without page_id are left out, as no record could be named;
rows that repeat a page_id give a record each, and of equal payloads with the largest
page_id one record is the response, which the others revisit; payloads shorter than
``least_bytes`` are never revisits; an empty table gives an archive without records; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, new_path, small_batches, stored  # noqa: F401

END = "\r\n\r\n"
#: Records in one archive file, payloads that lie apart, and what a file of those may hold.
RECORDS_PER_FILE, LARGE_BYTES, FILE_BYTES = 500, 128 << 10, 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, object]], block: str) -> str:
    headers = [*headers, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v not in (None, "")) + "\r\n" + block


def _clean(url: str | None) -> str | None:
    return url and "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def fresh_id(record_id: str, date: str) -> str:
    """The id of the record that is written anew from ``record_id``; as unique as that."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{record_id} {date}')}>"


def _name(record_id: str, page_id: int, url: str | None, digest: str, strong: str, date: str, kind: str) -> list[tuple[str, object]]:
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Payload-SHA256", strong),
        ("Page-Id", page_id),
        ("Content-Type", "application/http;msgtype=response"),
    ]


def response_record(record_id: str, page_id: int, url: str | None, html: str, digest: str, strong: str, date: str) -> str:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}{END}{html}"
    return _record(_name(record_id, page_id, url, digest, strong, date, "response"), block)


def revisit_record(record_id: str, page_id: int, url: str | None, digest: str, strong: str, size: int, date: str, original: dict) -> str:
    """``original``: page_id, url, record_id and date of the response that is revisited."""
    refers = [
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", original["record_id"]),
        ("WARC-Refers-To-Target-URI", _clean(original["url"])),
        ("WARC-Refers-To-Date", original["date"]),
        ("Refers-To-Page-Id", original["page_id"]),
        ("Payload-Length", size),
    ]
    return _record(_name(record_id, page_id, url, digest, strong, date, "revisit") + refers, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:  # one gzip member or several
            z = zlib.decompressobj(31)
            out.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, data[start:stop]
        at = stop + 4


def write_records(records: DataFrame, path: str, most: int = RECORDS_PER_FILE) -> None:
    """Write a column of record texts as archive files below ``path``, ``most`` records to a file."""
    writer = records.write.option("lineSep", END).option("maxRecordsPerFile", most)
    writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _kinds() -> list[tuple[str, int]]:
    """Kinds of payloads with the largest size of each, the last without one that counts."""
    found = [("usual", LARGE_BYTES)]
    while found[-1][1] < FILE_BYTES:
        found.append(("large" if len(found) == 1 else f"large-{len(found)}", found[-1][1] * 8))
    return [*found, ("huge", 1 << 62)]


def _records_per_file(largest: int) -> int:
    """The records of a kind with payloads up to ``largest`` that a file may hold."""
    return max(1, min(RECORDS_PER_FILE, FILE_BYTES // largest))


def write_responses(pages: DataFrame, path: str, date: str) -> dict[str, int]:
    """One response record per page, below ``path``/kind; returns the records to a file of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = html.encode()
                out.append(response_record(f"<{uuid.uuid4().urn}>", page_id, url, html, payload_digest(data), hashlib.sha256(data).hexdigest(), date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    small_batches(pages.sparkSession)
    rows = pages.where("page_id is not null").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html")
    kinds, most, above = _kinds(), {}, -1
    counts = rows.agg(*(F.count_if((size > low) & (size <= high)).alias(kind) for (kind, high), low in zip(kinds, [-1, *(x for _, x in kinds)], strict=False))).first()
    for kind, largest in kinds:
        if counts[kind] or kind == "usual":
            most[kind] = _records_per_file(largest)
            write_records(rows.where((size > above) & (size <= largest)).mapInArrow(run, "value string"), f"{path}/{kind}", most[kind])
        above = largest
    return most


_HEADER = "file string, page_id long, url string, record_id string, record_type string, payload_digest string, strong string, date string, payload_bytes long, refers_to long"
_HEADER_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("strong", pa.string()),
        ("date", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()),
    ]
)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archive files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[list] = [[] for _ in _HEADER_ARROW]
                for h, block in parse_archive(data):
                    if h["WARC-Type"] == "response":
                        size = len(block) - block.index(b"\r\n\r\n") - 4
                    else:
                        size = int(h["Payload-Length"])
                    row = (
                        file,
                        int(h["Page-Id"]),
                        h.get("WARC-Target-URI"),
                        h["WARC-Record-ID"],
                        h["WARC-Type"],
                        h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        h["Payload-SHA256"],
                        h["WARC-Date"],
                        size,
                        int(h["Refers-To-Page-Id"]) if "Refers-To-Page-Id" in h else None,
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _HEADER_ARROW.types, strict=True)], schema=_HEADER_ARROW)

    return archive_files(spark, path).mapInArrow(run, _HEADER)


def resolve_revisits(spark: SparkSession, source: str, target: str, date: str, most: dict[str, int], least_bytes: int = 0) -> None:
    """Rewrite the archives of ``source`` into ``target``: equal payloads are held once.

    Only headers are shuffled by digest and length.  The side with the original of each
    digest holds a digest once, from a partial aggregation, and is stored; the other side may
    be skewed and is joined with splitting.  The decisions then meet the compressed files
    that they are about: at most ``RECORDS_PER_FILE`` to a file.
    """
    headers = stored(read_headers(spark, source), "warc-headers")
    key = ["payload_digest", "strong", "payload_bytes"]
    originals = stored(
        headers.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(*key)
        .agg(F.max(F.struct("page_id", "record_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "warc-originals",
    )
    revisits = (
        headers.join(originals, key)
        .where("record_id <> first.record_id")
        .groupBy("file")
        .agg(F.collect_list(F.struct("record_id", F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), F.col("first.record_id").alias("first_id"))).alias("revisits"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, decided in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known = {r["record_id"]: {"record_id": fresh_id(r["first_id"], date), "page_id": r["page_id"], "url": r["url"], "date": date} for r in decided or []}
                out: list[str] = []
                for h, block in parse_archive(data):
                    record_id = fresh_id(h["WARC-Record-ID"], date)
                    name = (record_id, int(h["Page-Id"]), h.get("WARC-Target-URI"))
                    digests = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["Payload-SHA256"]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    original = known.get(h["WARC-Record-ID"])
                    if original is None:
                        out.append(response_record(*name, payload.decode(), *digests, date))
                    else:
                        out.append(revisit_record(*name, *digests, len(payload), date, original))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    for kind in most:
        files = archive_files(spark, f"{source}/{kind}").join(revisits, F.col("path") == F.col("file"), "left")
        write_records(files.select("content", "revisits").mapInArrow(run, "value string"), f"{target}/{kind}", most[kind])


def deduplicate_pages(pages: DataFrame, least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, resolve revisits, and read the headers of the result."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    source, target = new_path(spark, "warc-source"), new_path(spark, "warc")
    most = write_responses(pages, source, date)
    resolve_revisits(spark, source, target, date, most, least_bytes)
    return read_headers(spark, target)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    found = deduplicate_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
#: DuckDB has no base32; a test compares payload_digest with the standard library.
ORACLE: dict[str, str] = {}
