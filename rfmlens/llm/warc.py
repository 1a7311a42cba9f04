"""WARC archives: a distributed writer with revisit records, and a sequential reader.

Writing. Each page becomes one WARC/1.1 record in a gzip member of its own. Pages with the same payload of
at least ``min_revisit`` bytes are stored once: the one with the smallest id as ``response``, the others as
``revisit`` records that keep the response's HTTP header but no payload. Tasks concatenate members into
shards and Spark's text writer stores each shard as one file, so any Hadoop file system works and the
output committer discards the files of lost or repeated attempts. The text writer ends each row with a
separator; it is set to one zero byte and the last byte of each shard is left to it: a gzip member ends
with the highest byte of its size, which is zero below 16 MiB, and a larger last member is followed by an
empty one.

Reading. Each archive is read from its first to its last byte: ``zlib`` inflates it piece by piece, a member at a
time; the record is framed by its Content-Length and the payload is held against its digest.

Cases: a null payload is empty; a null id is kept as null and sorts after all others; rows that share the
smallest id of a payload are all responses; an empty table gives archives without records; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage, lookup, stage_path

ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 16
RECORDS = ("record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
           "payload_digest string, digest_ok boolean, payload binary")


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _shard_end(shard: bytes, level: int) -> bytes:
    """The shard without its last byte, which is zero."""
    if shard[-1]:
        shard += _member(b"", level)
    return shard[:-1]


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = DATE) -> bytes:
    """One uncompressed WARC record; a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{ID}{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _info(date: str) -> bytes:
    block = b"software: rfmlens\r\nformat: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info:0>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit: int = 100, shard_bytes: int = 32 << 20,
                   level: int = 6, date: str = DATE) -> None:
    """Write ``pages`` as gzip WARC files of about ``shard_bytes`` below ``path`` (see the module's text)."""
    body = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = cut_lineage(
        rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "warc-copies")
    total = pages.count()
    told = lookup(rows, copies, ["digest"], "n", total, F.col("id"))
    told = told.withColumn("refers_to", F.when(F.coalesce(F.col("id") > F.col("first"), F.col("id").isNull()), F.col("first")))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _member(_info(date), level)
        parts, size = [start], len(start)
        empty = True
        for batch in batches:
            cols = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                parts.append(m := _member(record(*[c[i].as_py() for c in cols], date=date), level))
                size, empty = size + len(m), False
                if size >= shard_bytes:
                    yield pa.RecordBatch.from_pydict({"shard": [_shard_end(b"".join(parts), level)]})
                    parts, size, empty = [start], len(start), True
        if not empty:
            yield pa.RecordBatch.from_pydict({"shard": [_shard_end(b"".join(parts), level)]})

    (told.select("id", "url", "payload", "digest", "refers_to").mapInArrow(shards, "shard binary")
     .select(F.col("shard").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path))


def members(archive: bytes | memoryview, piece: int = PIECE) -> Iterator[bytes]:
    """The inflated gzip members of one archive, one after the other."""
    view, at, rest = memoryview(archive), 0, b""
    while rest or at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                if at >= len(view):
                    raise ValueError("the archive ends within a gzip member")
                rest, at = bytes(view[at:at + piece]), at + piece
            out.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(out)


def _headers(block: bytes) -> tuple[str, dict[str, str], int]:
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a header has no end")
    first, *lines = block[:end].decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def read_records(archive: bytes | memoryview) -> Iterator[dict]:
    """The records of one archive; ``ValueError`` where framing fails, ``digest_ok`` false where a payload differs."""
    for data in members(archive):
        if not data:
            continue  # an empty member that ends a shard
        version, head, at = _headers(data)
        length = int(head["content-length"])
        if not version.startswith("WARC/") or data[at + length:] != b"\r\n\r\n":
            raise ValueError("a record isn't as long as its Content-Length says")
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        block = data[at:at + length]
        _, http, start = _headers(block)
        payload = block[start:]
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        ok = kind == "revisit" and not payload or kind == "response" and (
            len(payload) == int(http["content-length"]) and hashlib.sha256(payload).hexdigest() == digest)
        yield {"record_id": head["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": head.get("warc-target-uri"),
               "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "payload_bytes": int(http["content-length"]),
               "payload_digest": digest, "digest_ok": ok, "payload": payload}


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Every response and revisit record below ``path``.

    A revisit has the length and digest of the payload it refers to and no payload. ``strict``: a payload that
    doesn't match its digest fails the job; otherwise its row has ``digest_ok`` false. ``payloads=False``
    checks the payloads but returns null for them.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}.get(n, pa.string()))
                            for n in names])
        for batch in batches:
            for k in range(batch.num_rows):
                found, size = [], 0
                for r in read_records(batch.column(0)[k].as_buffer()):
                    if strict and not r["digest_ok"]:
                        raise ValueError(f"{r['record_id']}: the payload doesn't match its digest")
                    if not payloads:
                        r["payload"] = None
                    found.append(r)
                    size += len(r["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found, size = [], 0
                yield pa.RecordBatch.from_pylist(found, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """One digest row per page from the records that ``write_archives`` made."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          number("refers_to").alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of ``pages`` to WARC archives and read them back."""
    path = stage_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(read_archives(spark, path, payloads=False))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
