"""WARC output and indexed reading.

Writing: each task writes its records into one gzip-per-record archive in the shared folder and
returns an index row per record: file, offset, length, url, digest. The index is a table; an
attempt that failed leaves an archive that no index row names, so every record counts once.
Payloads seen before are revisit records: of equal payloads the one with the smallest page_id is
the response, the others refer to it (minimum per digest, combined before the shuffle).

Reading goes by the index: selected rows are sorted by file and offset, ranges that touch or
nearly touch are coalesced into one read, and the records are parsed out of it.

Defined cases: null html is the empty payload; a null url gives a record without target; a null
page_id sorts after all others and stays null; rows that repeat a page_id and payload of the
response are responses too; extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import NULL_ID, cut, prepare, shown_id, slices, text_bytes, work_dir
from haulage.llm.shared_files import make_dir, open_fs

MIN_REVISIT_BYTES = 0
GZIP_LEVEL = 4
MAX_FILE_BYTES = 1 << 30
RANGE_GAP = 64 << 10
RANGE_BYTES = 8 << 20
WARC_DATE = "2024-01-01T00:00:00Z"
# fixed values of the WARC 1.1 standard
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def build_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One WARC record (not yet compressed) and its payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {WARC_DATE}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page_id}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}",
                  f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(data: bytes) -> dict:
    """Fields of one WARC record; payload is None for a revisit."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of page {fields['X-Page-Id']} does not match its digest")
    return {"page_id": int(fields["X-Page-Id"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "payload_bytes": len(payload) if payload is not None else int(fields["X-Payload-Length"]),
            "payload_digest": digest, "payload": payload,
            "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses."""
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    digested = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    slim = digested.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = (slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("digest").alias("f_digest"), "refers_to"))
    later = (slim.join(first, F.col("digest") == F.col("f_digest")).where("page_id <> refers_to")
             .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to").distinct())
    return (digested.join(later, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
            .select("page_id", "url", "html", "refers_to"))


INDEX = ("page_id long, file string, offset long, length long, url string, digest string, "
         "record_type string, refers_to long")


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, level: int = GZIP_LEVEL,
               max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write archives under ``folder`` (default: the shared folder); returns the stored index."""
    spark = prepare(pages.sparkSession)
    folder = folder or work_dir(spark, "warc")
    make_dir(folder)

    def write(batches):
        from pyspark import TaskContext
        filesystem, inner = open_fs(folder)
        out, name, offset = None, None, 0
        try:
            for batch in slices(batches, 8 << 20):
                rows = []
                urls, refers = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                for page, url, html, refer in zip(batch.column(0).to_pylist(), urls, text_bytes(batch.column(2)), refers):
                    if out is None or offset >= max_file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, offset = filesystem.open_output_stream(f"{inner}/{name}", compression=None), 0
                    record, digest = build_record(page, url, html, refer)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = packer.compress(record) + packer.flush()
                    out.write(packed)
                    rows.append((page, name, offset, len(packed), url, digest,
                                 "response" if refer is None else "revisit", refer))
                    offset += len(packed)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    index = with_revisits(pages, id_col, url_col, html_col, min_bytes).mapInArrow(write, INDEX)
    return cut(index.withColumn("folder", F.lit(folder)), "warc-index")


def coalesced(ranges, gap: int = RANGE_GAP, most: int = RANGE_BYTES):
    """Sorted (offset, length) ranges as runs [(start, end, [positions])], one read each."""
    run = None
    for k, (offset, length) in enumerate(ranges):
        if run and offset - run[1] <= gap and offset + length - run[0] <= most:
            run[1] = max(run[1], offset + length)
            run[2].append(k)
        else:
            if run:
                yield run
            run = [offset, offset + length, [k]]
    if run:
        yield run


RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows, read from the archives by coalesced byte ranges."""
    prepare(index.sparkSession)
    chosen = (index.select("folder", "file", "offset", "length")
              .repartition("file", F.floor(F.col("offset") / F.lit(8 * RANGE_BYTES)))
              .sortWithinPartitions("folder", "file", "offset"))

    def read(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            k = 0
            while k < len(rows):
                e = k
                while e < len(rows) and rows[e][:2] == rows[k][:2]:
                    e += 1
                filesystem, inner = open_fs(rows[k][0])
                with filesystem.open_input_file(f"{inner}/{rows[k][1]}") as archive:
                    for start, end, members in coalesced([r[2:] for r in rows[k:e]]):
                        data = archive.read_at(end - start, start)
                        out = []
                        for m in members:
                            offset, length = rows[k + m][2:]
                            r = parse_record(zlib.decompress(data[offset - start:offset - start + length], 31))
                            out.append((r["page_id"], r["url"], r["record_type"], r["payload_bytes"],
                                        r["payload_digest"], r["refers_to"], r["payload"] if payloads else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                         names=[c.split()[0] for c in RECORD.split(", ")])
                k = e

    records = chosen.mapInArrow(read, RECORD)
    return records.withColumn("page_id", shown_id("page_id")).withColumn("refers_to", shown_id("refers_to"))
