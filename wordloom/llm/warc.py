"""WARC archives: one gzip member per record, written and read sequentially.

Payloads that occur more than once are stored once: among equal payloads of ``MIN_REVISIT`` bytes or more, the row with
the smallest id is a ``response`` record, the others are ``revisit`` records that name it. Archives are kept as a table
of (archive, part, data), each ``data`` a run of whole gzip members, so any store that Spark can write to will do and
Spark's commit protocol covers lost executors.

The reader goes through the bytes once: incremental zlib decompression with a bounded output step, record headers up
to the empty line, content framed by ``Content-Length``, and payloads verified against ``WARC-Payload-Digest`` and their
stated length. A revisit has the digest and the length of the response that it names, or reading fails (``checked``).

Edge cases: null html is an empty payload; a null url gives ``urn:page``; rows that repeat the smallest id of a group
are all responses; a null id is never chosen while others exist, and a group of null ids only is all responses;
repeated rows are a record each; very long pages are parts of their own; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, materialise, pieces, scratch_path, small_batches, table, worker_memory

MIN_REVISIT = 100
#: Compressed bytes after which a writer starts a new part.
PART_BYTES = 1 << 20
#: Rows of the table of repeated payloads up to which it is broadcast (about 80 bytes each); beyond, a shuffle join.
BROADCAST_ROWS = 200_000
_STEP = 1 << 16


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. Revisits carry no payload, only its digest and length."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((uri or 'urn:page').split()) or 'urn:page'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


class CorruptRecord(ValueError):
    """A record whose framing or digest does not hold."""


def members(data: bytes) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its content in steps of bounded size."""
    at, view = 0, memoryview(data)
    while at < len(view):
        inflater = zlib.decompressobj(31)
        state = {"at": at}

        def steps(inflater=inflater, state=state) -> Iterator[bytes]:
            rest = b""
            while not inflater.eof:
                if not rest:
                    rest = view[state["at"] : state["at"] + _STEP]
                    state["at"] += len(rest)
                    if not rest:
                        raise CorruptRecord("truncated gzip member")
                out = inflater.decompress(rest, _STEP)
                rest = inflater.unconsumed_tail
                if out:
                    yield out
            state["at"] -= len(inflater.unused_data)

        run = steps()
        yield run
        for _ in run:  # whatever the caller left
            pass
        at = state["at"]


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of every record. Raises CorruptRecord on bad framing or a wrong digest."""
    for steps in members(data):
        buffer = bytearray()
        for step in steps:
            buffer += step
            if (split := buffer.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise CorruptRecord("no end of headers")
        version, *lines = bytes(buffer[:split]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise CorruptRecord(f"not a WARC record: {version[:20]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        length, body = int(headers["Content-Length"]), buffer[split + 4 :]
        for step in steps:
            body += step
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise CorruptRecord("content does not fill its frame")
        payload = bytes(body[:length])
        if headers["WARC-Type"] != "revisit":
            if f"sha256:{hashlib.sha256(payload).hexdigest()}" != headers["WARC-Payload-Digest"]:
                raise CorruptRecord("payload digest differs")
            if int(headers["X-Payload-Length"]) != len(payload):
                raise CorruptRecord("payload length differs")
        yield headers, payload


def decide(pages: DataFrame, id_col: str, uri_col: str, html_col: str) -> DataFrame:
    """(page_id, uri, payload, digest, first): ``first`` is the response's id for rows that become revisits.

    Only ids and digests are grouped; payloads are shuffled only when there are too many repeated ones to broadcast.
    """
    payload = F.coalesce(col(html_col), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(uri_col).alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    repeated = materialise(
        rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"),
        "repeated",
    )
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    return rows.join(side, "digest", "left").select("page_id", "uri", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_archives(decided: DataFrame, path: str) -> None:
    """Write the records of each partition as one archive, in parts of whole members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_memory("")
        archive, part, members_, size = f"{TaskContext.get().partitionId():08d}.warc.gz", 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([archive]), "part": pa.array([part], pa.int64()), "data": pa.array([b"".join(members_)], pa.binary())})

        for whole in batches:
            for batch in pieces(whole):
                for page_id, uri, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    members_.append(record("response" if first is None else "revisit", page_id, uri, payload, digest, first))
                    size += len(members_[-1])
                    if size >= PART_BYTES:
                        yield out()
                        part, members_, size = part + 1, [], 0
        if members_:
            yield out()

    small_batches(decided).mapInArrow(run, "archive string, part long, data binary").write.option("compression", "none").parquet(path)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, uri, record_type, refers_to, payload_digest, payload_bytes, payload (empty for revisits)."""

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    names = ["page_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows, size = [], 0
                for h, payload in read_records(cell.as_py()):
                    rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], number(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"]), payload))
                    size += len(payload)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return small_batches(archives).select("data").mapInArrow(run, "page_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def checked(records: DataFrame) -> DataFrame:
    """``records``, whose revisits name a response of their digest and length; raises where one does not.

    Responses and revisits meet in one row for each page that is named, narrow and combined before the shuffle."""
    name = F.coalesce("refers_to", "page_id")
    print_ = F.struct("payload_digest", "payload_bytes")
    response = F.col("record_type") == "response"
    named = records.groupBy(name.alias("page"), print_.alias("print")).agg(F.bool_or(response).alias("there"), F.bool_or(~response).alias("wanted"))
    lost = named.filter("wanted AND NOT there").select("page").limit(1).collect()
    if lost:
        raise CorruptRecord(f"a revisit names page {lost[0].page}, which has no such payload")
    return records


def archive_pages(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Archive all pages under ``path`` (the shared folder if None) and read the archives back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(decide(pages, id_col, uri_col, html_col), path)
    return read_archives(spark.read.schema("archive string, part long, data binary").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return checked(materialise(records, "records"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
