"""Content-addressed WARC archive: payloads stored once, exact record headers apart.

An archive is a folder of two tables. ``payloads`` holds the bytes of each distinct payload
under its SHA-256; ``headers`` holds, for each record, its header block byte for byte and the
SHA-256 of its payload. Joining the two gives the original records back. Writing groups
payloads by digest and bytes, copies of a task first; reading hashes the stored bytes again
and holds them against both their SHA-256 and the SHA-1 in the record's header.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.llm.shared import column, new_path, spread_join, stored

#: Equal payloads of at least so many bytes are stored as revisits of one response.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def _record_id(page_id: Column, row: Column) -> Column:
    """A record's name; row tells records of one page_id apart."""
    h = F.sha1(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(_CRLF)))


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF + "Content-Type: text/html; charset=utf-8" + _CRLF + "Content-Length: "), length.cast("string"), F.lit(_CRLF + _CRLF))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Write one record for each row of pages below path.

    Of records with equal payloads of at least revisit_bytes, the one of the largest page_id is
    a response and the others revisit it; shorter ones are all responses. Rows that repeat the
    largest page_id with its payload are responses too; null page_ids come before all others.
    """
    spark = pages.sparkSession
    raw = F.coalesce(column(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(column(page_id).cast("long").alias("page_id"), column(url).cast("string").alias("url"), raw.alias("payload"))
    # one row for each distinct payload of a task leaves it, however many copies there are
    payloads = rows.groupBy(F.sha2("payload", 256).alias("digest"), "payload").agg(F.count("*").alias("copies"))
    payloads.select("digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), "copies", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    records, _ = stored(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "records")
    last = records.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("last"))
    store, _ = stored(spark.read.parquet(f"{path}/payloads").select("digest", "sha1", "bytes", "copies").join(last, "digest"), "store")
    facts = spread_join(records, store, ["digest"], "copies")
    revisit = (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    facts = facts.withColumn("revisit", revisit)
    http = _http(F.col("bytes"))
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("last.page_id"), F.col("last.row")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit(_CRLF),
        http,
    )
    facts.select("page_id", "digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(header: Column, name: str) -> Column:
    """The value of a line of a record's header block; null if there is none."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, header, payload (the full one, of revisits too), verified, refers_to, sha1.

    verified: the stored bytes hash to the digest they are filed under, and the digest in the
    record's own header is theirs. refers_to: the page_id of the record that WARC-Refers-To in
    the header names, found by that record's own WARC-Record-ID.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "copies", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("sound"), F.sha1("payload").alias("sha1"))
    records = headers.withColumn("refers", _field(F.col("header"), "WARC-Refers-To"))
    named = records.where("refers is not null").groupBy("refers").agg(F.count("*").alias("n"))
    targets = headers.select(_field(F.col("header"), "WARC-Record-ID").alias("refers"), F.col("page_id").alias("refers_to"))
    targets, _ = stored(named.join(targets, "refers"), "targets")
    revisits = spread_join(records.where("refers is not null"), targets, ["refers"], "n", "left").select("page_id", "digest", "header", "refers_to")
    records = records.where("refers is null").select("page_id", "digest", "header", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
    digest = _field(F.col("header"), "WARC-Payload-Digest")
    total = headers.count()
    return spread_join(records, payloads, ["digest"], "copies", total=total).select("page_id", "header", "payload", (F.col("sound") & (digest == F.concat(F.lit("sha1:"), "sha1"))).alias("verified"), "refers_to", "sha1")


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the original record, byte for byte, of what read_archive() gives: a revisit has no payload of its own."""
    head = F.col("header").cast("string")
    body = F.when(head.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def export_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the original records as .warc text, the records of a task in one file, for other programs to read."""
    # a record ends in two line ends, so as separator they complete the file
    end = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    record_bytes(records).select(end.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc files below path: record_id, type, target, digest, refers_to (a record_id), header, payload.

    header is the record's header block with the one of its HTTP message, payload what follows.
    A task reads whole files, plain or compressed by gzip, one after the other; a record that
    ends early raises an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                at = 0
                while at < len(raw):
                    end = raw.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(": ", 1) for line in raw[at : end - 4].decode().split("\r\n")[1:])
                    stop = end + int(fields["Content-Length"])
                    if not raw.startswith(b"WARC/", at) or raw[stop : stop + 4] != b"\r\n\r\n":
                        raise ValueError(f"no whole record at byte {at}")
                    body = raw.find(b"\r\n\r\n", end, stop) + 4
                    values = [fields.get(n) for n in ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To")]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in values), pa.array([raw[at:body]], pa.binary()), pa.array([raw[body:stop]], pa.binary())], ["record_id", "type", "target", "digest", "refers_to", "header", "payload"])
                    at = stop + 4

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, type string, target string, digest string, refers_to string, header binary, payload binary")


def roundtrip(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as an archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of pages. Bytes and digest (SHA-1, hex) are of the full payload as
    read back; the type is read off the record's header. A null html is an empty payload; a
    null url leaves its line out; an empty table gives an empty archive. A payload that doesn't
    verify raises an error. Other columns are not stored.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write_archive(pages, path, page_id, url, html)
    records = read_archive(pages.sparkSession, path)
    head = F.col("header").cast("string")
    digest = F.when(F.col("verified"), F.col("sha1")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.regexp_extract(head, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"), "refers_to")
