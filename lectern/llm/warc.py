"""WARC archives: revisit records for equal payloads, and a salvage reader.

Writing: every record is one gzip member; Spark's text sink lays the members
into files of the shared folder, each followed by one zero byte (zero padding
between members is legal gzip). Reading: whole files come in as ``binaryFile``
rows (files are bounded by ``records_per_file``). Where a member or a record
fails a check, the reader searches for the next valid member or version line,
inside the inflated bytes too, goes on from there and logs the bytes between as a
quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, text_of

VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
#: Algorithms of digest headers that are checked.
DIGESTS = ("md5", "sha1", "sha256", "sha512")
READ_SCHEMA = "path string, offset long, length long, kind string, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long"


def assign_roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to (null: a response).

    Among rows of equal payload of at least ``min_bytes`` the largest page_id
    is the response and the others refer to it. Null html is an empty payload;
    rows that repeat the response's page_id are responses too; a null page_id
    is a response only where no other row has the payload.
    """
    payload = text_of("html").cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    digests = pages.select("page_id", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("n"))
    keepers = digests.where(F.col("n") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(keepers, "payload_digest", "left")
    other = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.withColumn("refers_to", F.when(other, F.col("_keeper"))).drop("_keeper")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: an HTTP response with the payload, or a revisit with its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def records_per_file(pages: DataFrame, most: int = 4000, file_bytes: int = 1 << 29) -> int:
    """So many records that even the longest ones don't fill more than a file of ``file_bytes``."""
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first()["n"] or 0
    return max(1, min(most, file_bytes // (longest + 4096)))


def write_archives(rows: DataFrame, path: str, records_per_file: int = 4000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``assign_roles`` rows as gzip WARC files of at most ``records_per_file`` records under ``path``."""

    @F.pandas_udf("binary")
    def member(page_id: pd.Series, url: pd.Series, payload: pd.Series, digest: pd.Series, refers_to: pd.Series) -> pd.Series:
        whole = lambda x: None if pd.isna(x) else int(x)
        return pd.Series([
            gzip.compress(record_bytes(whole(i), u, bytes(p), d, whole(r), date), 6, mtime=0)
            for i, u, p, d, r in zip(page_id, url, payload, digest, refers_to)
        ])

    # Ids go as text: nullable integers would turn into doubles on the way.
    out = rows.select(member(F.col("page_id").cast("string"), "url", "payload", "payload_digest", F.col("refers_to").cast("string")).cast("string").alias("value"))
    out.write.option("lineSep", "\x00").option("maxRecordsPerFile", records_per_file).text(path)


def digest_holds(declared: str | None, data: bytes) -> bool:
    """Whether data has the digest that a header declares, as hex or base32; unknown algorithms are not checked."""
    name, _, value = (declared or "").partition(":")
    if name.lower() not in DIGESTS or not value:
        return True
    found = hashlib.new(name.lower(), data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and its end; raises ValueError on any failed check."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header does not end")
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise ValueError("header lacks type or length")
    start = end + 4
    stop = start + int(head["content-length"])
    block = data[start:stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where it should")
    if not digest_holds(head.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\ncontent-length: *(\d+)", http)
    digest = head.get("warc-payload-digest", "")
    if head["warc-type"] == "response" and not digest_holds(digest, payload):
        raise ValueError("payload digest differs")
    ids = {k: head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")}
    return {"record_type": head["warc-type"], "record_id": ids["warc-record-id"], "refers_to": ids["warc-refers-to"], "target_uri": head.get("warc-target-uri"), "payload_digest": digest.removeprefix("sha1:") or None, "payload_bytes": int(size[1]) if size else len(payload), "payload": payload}, stop + 4


def _inside(plain: bytes) -> tuple[list[dict], str]:
    """The records of an inflated member that pass their checks, and the first failure (empty if none): after one, the
    search goes on at the next version line."""
    found, at, why = [], 0, ""
    while at < len(plain):
        try:
            one, at = _parse(plain, at)
            found.append(one)
        except ValueError as problem:
            why = why or str(problem)
            at = plain.find(VERSION, at + 1)
            if at < 0:
                break
    return found, why


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, and a row of kind ``gap`` for each run of bytes that failed a check.

    A gzip member is inflated as far as it goes; records inside that pass are
    recovered even if others fail or the member is cut off, and the member is
    logged as a gap then (its records come before it).
    """
    at, lost, reason, n = 0, None, "", len(data)
    while at < n:
        if lost is None and data[at] in b"\x00\r\n":
            at += 1
            continue
        found, end, why = [], None, "neither member nor version line"
        if data.startswith(MAGIC, at):
            plain, end, why = _inflate(data, at)
            found, inner = _inside(plain)
            why = why or inner or ("" if found else "empty member")
        elif data.startswith(VERSION, at):
            try:
                one, end = _parse(data, at)
                found, why = [one], ""
            except ValueError as problem:
                why = str(problem)
        if found and lost is not None:
            yield {"kind": "gap", "offset": lost, "length": at - lost, "reason": reason}
            lost = None
        # version lines of stored members were met inside of them already
        marks = [data.find(MAGIC, at + 1), -1 if found else data.find(VERSION, at + 1)]
        following = end if end is not None else min((x for x in marks if x >= 0), default=n)
        for one in found:
            yield {"kind": "record", "offset": at, "length": following - at} | one
        if why and lost is None:
            lost, reason = at, why
        at = following
    if lost is not None:
        yield {"kind": "gap", "offset": lost, "length": n - lost, "reason": reason}


def _inflate(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int | None, str]:
    """What the member at ``at`` holds, its end (None if it has none) and what is wrong with it; what lies behind is not copied."""
    unzip, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while at < len(data) and not unzip.eof:
            out.append(unzip.decompress(view[at : at + step]))
            at += len(view[at : at + step])
    except zlib.error as problem:
        return b"".join(out), None, str(problem)
    if not unzip.eof:
        return b"".join(out), None, "member is cut off"
    return b"".join(out), at - len(unzip.unused_data), ""


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """Rows of ``READ_SCHEMA`` (with ``payload binary`` if wanted) of all archives under ``path``.

    A damaged stretch gives one row of kind ``gap`` with its offset, length and
    the reason of the first failed check; records after it are recovered. Empty
    files give no rows.
    """
    schema = READ_SCHEMA + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch["path"].to_pylist(), batch["content"]):
                rows = ([where if c == "path" else r.get(c) for c in names] for r in salvage(data.as_py()))  # one record at a time
                while some := list(itertools.islice(rows, 1000 if not payloads else 50)):
                    yield _batch([list(x) for x in zip(*some)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.string())) for c, x in zip(names, columns)], names=names)


def op10_warc(pages: DataFrame) -> DataFrame:
    """Write an archive of all pages, read it back: one row per page."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(assign_roles(pages), path, records_per_file(pages))
    read = read_archives(pages.sparkSession, path)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return read.where("kind = 'record'").select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest
"""
