"""WARC archives: written with an index first, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import new_dir, only, skew_lookup, staged, table

INDEX = "page_id long, url string, file string, offset long, length long, digest string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
CRLF = b"\r\n"


def _open(uri: str):
    """The file system and path of ``uri``: any that pyarrow knows (file, s3, gs, hdfs), s3 also by its names in Hadoop."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _clean(url: str) -> str:
    """A header's value stays on one line: control characters and blanks become percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str, level: int) -> bytes:
    """One gzip member with one WARC/1.1 record.  A revisit has the payload's digest and length, not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(CRLF.join(x.encode() for x in head) + CRLF * 2 + block + CRLF * 2) + z.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a gzip member; raises where lengths or digests do not hold."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    fields["http-length"] = next(x[16:] for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))
    if fields["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"]:
        raise ValueError("a payload does not have its digest")
    return fields, payload


def decided(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, n, refers_to (null: a response)."""
    x = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    x = x.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html"), 256))
    first = x.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    x = skew_lookup(x, first, "digest", "copies", pages.count(), F.col("page_id"))
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    return x.select("page_id", "url", "html", "digest", "n", F.when(~own, F.col("first_id")).alias("refers_to"))


def write_archive(pages: DataFrame, out: str, *, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes ``pages`` as WARC files under the URI ``out`` (one file a task) and returns the index.

    The index is a staged table with offset, length, URL and payload digest of each record; it names only files of
    tasks that ended well, so files that lost attempts leave behind are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(out)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        sink, at = None, 0
        for b in batches:
            rows = []
            for page_id, url, html, digest, _, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                member = encode_record(page_id, url, html.encode(), digest, refers_to, refers_to is not None, date, level)
                sink = sink or system.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(member)
                rows.append((page_id, url, f"{out}/{name}", at, len(member), digest))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "url", "file", "offset", "length", "digest"])
        if sink:
            sink.close()

    return staged(decided(pages, least_bytes).mapInArrow(write, INDEX), "warc-index")


def runs(rows: list[tuple], gap: int, most: int) -> Iterator[list[tuple]]:
    """Neighbouring (file, offset, length) rows that one read serves: at most ``gap`` bytes apart, ``most`` in all."""
    run: list[tuple] = []
    for r in rows:
        if run and (r[0] != run[0][0] or r[1] - (run[-1][1] + run[-1][2]) > gap or r[1] + r[2] - run[0][1] > most or r[1] < run[-1][1]):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """The records of the given index rows (all, or any selection), read by sorted, coalesced byte ranges."""
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "url")), strict=True))
            got = []
            for run in runs(rows, gap, most):
                system, path = _open(run[0][0])
                with system.open_input_file(path) as f:
                    data = f.read_at(run[-1][1] + run[-1][2] - run[0][1], run[0][1])
                for _, offset, length, url in run:
                    fields, payload = decode_record(data[offset - run[0][1] :][:length])
                    refers = fields.get("x-refers-to-page-id")
                    page_id = fields.get("x-page-id")
                    n = len(payload) if refers is None else int(fields["http-length"])
                    got.append((int(page_id) if page_id else None, url, n, fields["warc-payload-digest"][7:], fields["warc-type"], int(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    at = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return at.mapInArrow(read, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a WARC record for each page and reads the archives back.

    Null html: an empty payload, a response.  Null url: no target URI.  Repeated rows of the smallest page_id among
    equal payloads are all responses; a null page_id is never the smallest, and such a row revisits the smallest where
    one exists.  An empty table gives no rows; further columns are ignored.  A page of any length is one record, never cut.
    """
    out = new_dir(spark, "warc")
    return read_records(write_archive(table(spark, sf_dir, "pages"), out))


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM d)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN f IS NULL OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f IS NULL OR page_id = f THEN NULL ELSE f END AS refers_to
FROM g
"""
