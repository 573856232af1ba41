"""WARC archives: records written with an index first, read back through coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, durable, maybe_broadcast, shared_dir

INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"
#: Payloads shorter than this are always stored in full.
MIN_REVISIT_BYTES = 1000
#: Bytes of archives that a reading task should have.
TASK_BYTES = 32 << 20


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to, refers_url for every page.

    Only digests that occur more than once are looked up. They are joined by broadcast while few; beyond that the pages are
    shuffled by digest and Spark splits a hot digest, which is a single row on the looked-up side.
    """
    bytes_ = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha1(bytes_))
    copied = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(bytes_).alias("digest"), F.octet_length(bytes_).alias("n"), "url")
        .where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("copies"))
        .where("copies > 1").select("digest", F.col("last.page_id").alias("last"), F.col("last.url").alias("last_url"))
    )
    last = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return (
        rows.join(maybe_broadcast(durable(copied), broadcast_rows), "digest", "left")
        .withColumn("record_type", F.when(last, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(last, F.col("last"))).withColumn("refers_url", F.when(last, F.col("last_url"))).drop("last", "last_url")
    )


def _uri(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(place: str, page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_url) -> bytes:
    """One record as its own gzip member, with an id of its place. A revisit keeps the HTTP head, whose Content-Length is that of
    the full payload, and names the record that it refers to by that one's url and page id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, place)}>", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> tuple:
    """The fields of RECORD. The payload of a response is measured and hashed; one that differs from what its heads say is an
    error. A revisit has none, so its digest and size are those that its heads give."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda k: int(field[k]) if k in field else None
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    own = field["WARC-Type"] == "response"
    if own and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {field['WARC-Record-ID']} has {len(payload)} bytes or a digest that differ from its record's head")
    return number("X-Page-Id"), field.get("WARC-Target-URI"), field["WARC-Type"], number("X-Refers-To-Page-Id"), digest, length, payload if own else None


def _filesystem(uri: str):
    """A file system of pyarrow and the path in it: local folders, and the remote stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str, max_file_bytes: int = 1 << 30, **options) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to archives in folder and returns the index, a durable table.

    Of records with equal payloads of at least MIN_REVISIT_BYTES bytes, that with the largest page_id is a response, the others
    revisit it; rows repeated under that largest page_id are all responses. A null html is an empty payload; a null page_id is
    never the largest if another is there; a null url is left out of the head, and CR or LF in one is percent-encoded in it.
    Other columns, whatever their names, are not archived. A very long html is one record, which its task holds whole. An empty
    table gives an empty index and no archive.

    Each task writes files of its own, with a name of its own for every attempt. The index is written by Spark's commit
    protocol, so archives of failed or repeated attempts stay without index rows and are never read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = _filesystem(folder)
        where.create_dir(root, recursive=True)
        task, out, at, n = TaskContext.get(), None, 0, 0
        path = ""
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if out is None or at >= max_file_bytes:
                    if out is not None:
                        out.close()
                    path, at, n = f"{root}/{task.partitionId():06d}-{uuid.uuid4().hex}-{n}.warc.gz", 0, n + 1
                    out = where.open_output_stream(path, compression=None)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                member = _record(f"{path}:{at}", page_id, r.url, (r.html or "").encode(), r.digest, r.record_type, refers, r.refers_url)
                out.write(member)
                rows.append((path, at, len(member), page_id, r.url, r.digest, r.record_type, refers))
                at += len(member)
            frame = pd.DataFrame(rows, columns=["path", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return durable(plan_records(pages, **options).select("page_id", "url", "html", "digest", "record_type", "refers_to", "refers_url").mapInPandas(write, INDEX))


def read_warc(index: DataFrame, folder: str, range_bytes: int = 4 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """The records that the rows of index select, with payloads (null for revisits); an empty selection reads nothing.

    Each task gets stretches of range_bytes of files and goes through its records by file and offset: neighbours with at most
    gap_bytes between them are read at once, up to range_bytes of archive, and records are handed on whenever their payloads
    come to range_bytes. So a task holds one read and about range_bytes of payloads, or one longer record.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _filesystem(folder)
        columns = ["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        file, name, out, held = None, None, [], 0
        for batch in batches:
            spans = list(zip(batch.path, batch.offset, batch.length, strict=True))
            i = 0
            while i < len(spans):
                path, start, n = spans[i]
                end, j = start + n, i + 1
                while j < len(spans) and spans[j][0] == path and spans[j][1] - end <= gap_bytes and spans[j][1] + spans[j][2] - start <= range_bytes:
                    end, j = max(end, spans[j][1] + spans[j][2]), j + 1
                if path != name:
                    if file is not None:
                        file.close()
                    file, name = where.open_input_file(path), path
                file.seek(int(start))
                data = file.read(int(end - start))
                for _, o, n in spans[i:j]:
                    out.append(_parse(data[o - start : o - start + n]))
                    held += len(out[-1][-1] or b"")
                    if held >= range_bytes:
                        yield frame(out)
                        out, held = [], 0
                i = j
        if file is not None:
            file.close()
        if out:
            yield frame(out)

    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / range_bytes).alias("stretch")
    # the index is small beside the archives: partitions are planned by what its rows make tasks read, not by their own size
    parts = index.select("path", "offset", "length", stretch).repartition(max(1, -(-total // TASK_BYTES)), "path", "stretch")
    return parts.sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInPandas(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_warc(write_warc(pages, folder), folder)
