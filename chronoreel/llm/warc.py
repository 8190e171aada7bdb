"""WARC archives of pages, and revisit resolution.

1. ``write_archives``: each task writes gzip-per-record archives of its pages into the shared folder,
   under a name of its own attempt; the rows it returns name the files that count, so a lost task
   leaves only files that nothing reads.
2. ``resolve``: record headers, read back from the archives, are shuffled by payload digest; of the
   records with equal payloads of at least ``min_bytes`` the largest page id is the original, and the
   others are joined to it as revisits.
3. ``deduplicate``: each archive is streamed once more and written with fresh headers, revisits
   without their payload.
4. ``read_records`` reads archives back as rows.

Payloads and archives are streamed record by record; only one record at a time is in memory. Files go
through pyarrow's file systems, so the shared folder may be local, HDFS or an object store.

Defined cases: a null html is an empty payload; a null url or page id leaves its header out, and a null
page id sorts below all others; of repeated rows with one page id, one is the response and the others
refer to that same id; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoreel.llm.common import fresh_path, stored

MIN_BYTES = 1000
ROLL_BYTES = 256 << 20
MOST_HEAVY = 65_536
STAMP = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_SCHEMA = (
    "archive string, offset long, record_id string, page_id long, url string, warc_type string, "
    "payload_bytes long, payload_digest string, refers_to_id string, refers_to_page long"
)


def _open(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


class _Roller:
    """Writes records, each its own gzip member, to archives of about ROLL_BYTES."""

    def __init__(self, folder: str, level: int = 3):
        self.folder, self.level, self.out, self.files = folder, level, None, []

    def add(self, record: bytes) -> None:
        if self.out is None or self.size >= ROLL_BYTES:
            self.close()
            path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            fs, inner = _open(path)
            fs.create_dir(os.path.dirname(inner), recursive=True)
            self.out, self.size = fs.open_output_stream(inner, compression=None), 0
            self.files.append(path)
            self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", STAMP), ("Content-Type", "application/warc-fields")], b"software: chronoreel\r\nformat: WARC File Format 1.1\r\n"))
        packed = gzip.compress(record, self.level, mtime=0)
        self.out.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _records(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive, streamed."""
    fs, inner = _open(path)
    with fs.open_input_stream(inner, compression=None) as source:
        start, left = 0, b""
        while True:
            z, parts, used = zlib.decompressobj(31), [], 0
            while not z.eof:
                left = left or source.read(1 << 18)
                if not left:
                    if used:
                        raise OSError(f"{path}: the record at {start} is cut off")
                    return
                used += len(left)
                parts.append(z.decompress(left))
                left = b""
            left = z.unused_data
            used -= len(left)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield start, fields, rest[: int(fields["Content-Length"])]
            start += used


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller = _Roller(folder)
        for pdf in batches:
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", STAMP)]
                fields += [("WARC-Target-URI", _one_line(url))] if url else []
                fields += [("X-Page-Id", page)] if page else []
                fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _b32(hashlib.sha1(payload).digest()))]
                fields += [("WARC-Block-Digest", _b32(hashlib.sha1(http + payload).digest()))]
                roller.add(_record(fields, http + payload))
        roller.close()
        yield pd.DataFrame({"archive": roller.files}, dtype="object")

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """One row per archive written (archive); reading them is up to the caller."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.mapInPandas(_writer(folder), "archive string"), "warc-list")


def _spread(archives: DataFrame) -> DataFrame:
    """One archive a task as far as the cluster allows; the list itself is a few names."""
    return archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2), "archive")


def _header_rows(path: str) -> Iterator[tuple]:
    for offset, fields, block in _records(path):
        if fields["WARC-Type"] == "warcinfo":
            continue
        payload = block.partition(b"\r\n\r\n")[2]
        size = int(fields.get("X-Payload-Length", len(payload)))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
        if fields["WARC-Type"] == "response" and hashlib.sha1(payload).digest() != digest:
            raise OSError(f"{path}: the payload at {offset} does not match its digest")
        page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        yield (
            path, offset, fields["WARC-Record-ID"], page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            size, digest.hex(), fields.get("WARC-Refers-To"), other and int(other),
        )


def read_records(archives: DataFrame) -> DataFrame:
    """Headers of all response and revisit records of the archives, payload digests checked."""
    names = [x.split()[0] for x in HEADER_SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["archive"]:
                rows = []
                for row in _header_rows(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _frame(rows, names)
                        rows = []
                yield _frame(rows, names)

    return _spread(archives).mapInPandas(read, HEADER_SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names, dtype="object")
    return pdf.astype({c: "Int64" for c in ("offset", "page_id", "payload_bytes", "refers_to_page")})


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Revisit records only: archive, offset, and the original's record id, page id and url.

    Originals with very many copies are broadcast: of n records at most MOST_HEAVY payloads can have
    n / MOST_HEAVY copies. So no payload is one key of the join.
    """
    responses = headers.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    originals = (
        responses.groupBy("payload_digest", "payload_bytes")
        .agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "record_id", "url")).alias("original"))
        .where(F.col("copies") > 1)
    )
    originals = stored(originals, "warc-originals")
    heavy = F.col("copies") >= max(2, -(-headers.count() // MOST_HEAVY))
    key = ["payload_digest", "payload_bytes"]
    many = F.broadcast(originals.where(heavy).drop("copies"))
    few = responses.join(many, key, "left_anti").join(originals.where(~heavy).drop("copies"), key)
    return (
        responses.join(many, key)
        .unionByName(few)
        .where(F.col("record_id") != F.col("original.record_id"))
        .select("archive", "offset", F.col("original.record_id").alias("to_id"), F.col("original.page_id").alias("to_page"), F.col("original.url").alias("to_url"))
    )


def _rewriter(folder: str):
    def rewrite(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        revisits = {int(o): (i, p, u) for o, i, p, u in zip(pdf["offset"], pdf["to_id"], pdf["to_page"], pdf["to_url"], strict=True) if not pd.isna(o)}
        roller = _Roller(folder)
        for offset, fields, block in _records(key[0]):
            kind = fields.pop("WARC-Type")
            if kind == "warcinfo":
                continue
            fields.pop("Content-Length")
            if to := revisits.get(offset):
                http, _, payload = block.partition(b"\r\n\r\n")
                block, kind = http + b"\r\n\r\n", "revisit"
                fields |= {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Profile": PROFILE, "WARC-Refers-To": to[0], "X-Payload-Length": str(len(payload)), "WARC-Block-Digest": _b32(hashlib.sha1(block).digest())}
                fields |= {"WARC-Refers-To-Target-URI": to[2]} if isinstance(to[2], str) else {}
                fields |= {} if pd.isna(to[1]) else {"X-Refers-To-Page-Id": str(int(to[1]))}
            roller.add(_record([("WARC-Type", kind), *fields.items()], block))
        roller.close()
        return pd.DataFrame({"archive": roller.files}, dtype="object")

    return rewrite


def deduplicate(archives: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archives in which repeats are revisit records; one row per archive written.

    A group is the revisits of one archive, which ROLL_BYTES bounds; archives without any still have a row.
    """
    revisits = resolve(stored(read_records(archives), "warc-headers"), min_bytes)
    work = _spread(archives.join(revisits, "archive", "left").select("archive", "offset", "to_id", "to_page", "to_url"))
    return stored(work.groupBy("archive").applyInPandas(_rewriter(folder), "archive string"), "warc-list")


def build(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write, resolve, rewrite and read back; one row per page."""
    archives = write_archives(pages, fresh_path(spark, "warc"))
    final = deduplicate(archives, fresh_path(spark, "warc-dedup"), min_bytes)
    return read_records(final).select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to")
    )


#: DuckDB form of ``build``.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""
