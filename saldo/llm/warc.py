"""WARC archives from pages and back, as a chunked record table.

Payloads of at least ``LEAST`` bytes that are equal are stored once: the page with the largest page_id is the response, the others are
revisits that refer to it. Writing streams each payload in pieces through the digest and the gzip member of its record; reading streams
archives and gives rows (record, chunk number, bytes, digest so far), so that no task holds a record longer than a chunk. Archives lie
in the folder that driver and executors share; a file is moved to its name when it is whole, so a task that runs again replaces it.

A null html has an empty payload. A null page_id is written as an empty identifier, read back as null, and never is the larger one. Rows that
repeat a page_id and its payload are all responses, or all revisits. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import bounded, shipped
from saldo.session import checkpoint, shared_folder

LEAST = 1000
#: Bytes of a chunk row, of a piece in memory, and of an archive, about.
CHUNK, PIECE, ARCHIVE = 1 << 20, 1 << 16, 1 << 26
RECORD_DDL = "archive string, record_no long, page_id long, record_type string, refers_to long, full_bytes long, full_digest string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, html and refers_to (null for responses)."""
    p = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    p = p.withColumn("_key", key)
    groups = p.where("_key IS NOT NULL").groupBy(F.col("_key").alias("_k")).agg(F.max("page_id").alias("_most"), F.count("*").alias("_n"))
    groups = checkpoint(groups.where("_n > 1").select("_k", "_most"))
    p = p.join(shipped(groups, 100), F.col("_key") == F.col("_k"), "left")
    return p.select("page_id", "html", F.when(F.coalesce(F.col("page_id") != F.col("_most"), F.col("_most").isNotNull()), F.col("_most")).alias("refers_to"))


def head(page_id: int | None, size: int, digest: bytes, refers_to: int | None, body: int) -> bytes:
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: urn:page:{'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return ("\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {body}"]) + "\r\n\r\n").encode()


def write(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write the pages; archive, records and bytes of each archive. The rows are checkpointed, so writing happens once."""

    def run(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, no, out, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal out, no
            out.close()
            name = f"part-{part:06d}-{no:05d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            done.append((f"{folder}/{name}", records, size))
            out, no = None, no + 1

        for b in batches:
            ids, html, to = b.column(0), b.column(1), b.column(2)
            for k in range(b.num_rows):
                if out is None:
                    temp, records, size = f"{root}/.{part}-{no}-{uuid.uuid4().hex}", 0, 0
                    out = fs.open_output_stream(temp, compression=None)
                payload = html[k].as_buffer()
                pieces = range(0, payload.size, PIECE)
                sha, view = hashlib.sha1(), memoryview(payload)
                for lo in pieces:
                    sha.update(view[lo : lo + PIECE])
                refers, z = to[k].as_py(), zlib.compressobj(1, zlib.DEFLATED, 31)
                size += out.write(z.compress(head(ids[k].as_py(), payload.size, sha.digest(), refers, payload.size if refers is None else 0))) or 0
                if refers is None:
                    for lo in pieces:
                        size += out.write(z.compress(view[lo : lo + PIECE])) or 0
                size += out.write(z.compress(b"\r\n\r\n") + z.flush()) or 0
                records += 1
                if out.tell() >= archive_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["archive", "records", "bytes"])

    return checkpoint(bounded(decided(pages, least), 500, "4m").mapInArrow(run, "archive string, records long, bytes long"))


def inflated(stream):
    """Bytes of a gzip file of many members, piece by piece."""
    z = zlib.decompressobj(31)
    while raw := stream.read(PIECE):
        while raw:
            yield z.decompress(raw, PIECE)
            raw = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                z = zlib.decompressobj(31)
    while not z.eof and (rest := z.decompress(b"", PIECE)):
        yield rest


def records(pieces, chunk: int):
    """(record number, headers, chunk number, bytes, bytes so far, digest so far, last) of an archive."""
    held, no = bytearray(), 0
    more = lambda: (held.extend(x), True)[1] if (x := next(pieces, None)) is not None else False
    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        named = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        del held[: end + 4]
        left, sha, size, k = int(named["Content-Length"]), hashlib.sha1(), 0, 0
        while True:
            while len(held) < min(left, chunk) and more():
                pass
            now = bytes(held[: min(left, chunk)])
            del held[: len(now)]
            sha.update(now)
            size, left = size + len(now), left - len(now)
            yield no, named, k, now, size, sha.hexdigest(), not left
            k += 1
            if not left or not now:
                break
        while len(held) < 4 and more():
            pass
        del held[:4]
        no += 1


def read(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of column archive; ``bytes_so_far`` and ``digest_so_far`` run over a record's chunks."""

    def run(batches):
        from pyarrow.fs import FileSystem

        schema = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("full_bytes", pa.int64()), ("full_digest", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for b in batches:
            for at in b.column(0).to_pylist():
                fs, path = FileSystem.from_uri(at)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for no, h, k, data, size, digest, last in records(inflated(stream), chunk):
                        rows.append((at, no, number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), int(h["X-Payload-Length"]), base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), k, data, size, digest, last))
                        held += len(data)
                        if held >= 4 * PIECE * 16 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive").mapInArrow(run, RECORD_DDL)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to new archives, read them back; the last chunk row of each record."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least)).where("last")
