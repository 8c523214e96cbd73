"""WARC archives as a chunked record table: payloads pass through in pieces, each with the digest of what came so far."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CHUNK = 1 << 16
LEAST_SHARED = 100
ROLL_BYTES = 1 << 30
MANIFEST = "archive string, records long, archive_bytes long"
CHUNKS = "archive string, record_no long, chunk_no long, page_id long, url string, record_type string, refers_to long, declared_digest string, chunk_bytes long, digest_so_far string, last boolean"


def plan_records(pages: DataFrame, scratch: Scratch, least: int = LEAST_SHARED) -> DataFrame:
    """``pages(page_id, url, html)`` -> a row per record with its type, payload, size, digest and the page it refers to.

    Null html is an empty payload. Of equal payloads of ``least`` bytes or more, the smallest page_id is the response
    (rows that tie on it all are; a null page_id counts as the largest, and is a response if all are null).
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    base = pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    shared = base.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "owner")
    shared = scratch.save(shared, "shared")
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")) & (F.col("payload_bytes") >= least)
    return base.join(shared, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("owner")).alias("refers_to"))


def to_chunks(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per piece of a record, in order and together; a revisit has one empty piece."""
    n = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.greatest(F.ceil(F.col("payload_bytes") / F.lit(size)), F.lit(1))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(F.col("record_type") == "response", F.substring(F.col("payload"), k * size + 1, F.lit(size))))
    return records.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", F.posexplode(pieces).alias("chunk_no", "data"))


def _head(row) -> bytes:
    name = "null" if pd.isna(row.page_id) else str(int(row.page_id))
    target = "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row.url) if isinstance(row.url, str) else f"urn:page:{name}"
    revisit = row.record_type == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row.payload_bytes
    lines = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{row.payload_digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{int(row.refers_to)}>"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else row.payload_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def _writer(folder: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")
        out = name = pack = None
        records = size = 0
        done = []

        def close_record():
            nonlocal size, pack
            if pack is not None:
                tail = pack.compress(b"\r\n\r\n") + pack.flush()
                out.write(tail)
                size += len(tail)
                pack = None

        def close_file():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, records, size))
                out = None

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk_no == 0:
                    close_record()
                    if out is not None and size >= roll:
                        close_file()
                    if out is None:
                        store.create_dir(top, recursive=True)
                        name, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{top}/{name.rpartition('/')[2]}", compression=None)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    records += 1
                    data = pack.compress(_head(row))
                    out.write(data)
                    size += len(data)
                if row.data:
                    data = pack.compress(row.data)
                    out.write(data)
                    size += len(data)
        close_record()
        close_file()
        yield pd.DataFrame(done, columns=["archive", "records", "archive_bytes"])

    return write


def write_archives(records: DataFrame, scratch: Scratch, folder: str | None = None, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes gzip WARC files and returns the manifest ``(archive, records, archive_bytes)``.

    Only archives named in the manifest count, so what a lost or repeated task attempt left behind is never read. A file
    rolls at a record's end once it holds ``roll`` bytes.
    """
    folder = folder or scratch.path("warc")
    chunks = to_chunks(records)
    return scratch.save(chunks.mapInPandas(_writer(folder, roll), MANIFEST), "manifest")


def parse_archive(stream, archive: str, size: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS from one archive (each with its bytes as a last value), holding one piece at a time."""
    f = io.BufferedReader(stream, 1 << 20)
    number = -1
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should begin")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        number += 1
        left, inner = int(head["content-length"]), f.readline()
        left -= len(inner)
        while inner not in (b"\r\n", b"\n"):
            inner = f.readline()
            left -= len(inner)
        page = (re.search(r"urn:page:(-?\d+)", head.get("warc-record-id", "")) or [None, None])[1]
        refers = (re.search(r"urn:page:(-?\d+)", head.get("warc-refers-to", "")) or [None, None])[1]
        digest, k = hashlib.sha256(), 0
        while True:
            data = f.read(min(size, left))
            if len(data) < min(size, left):
                raise EOFError(f"{archive}: record {number} is cut short")
            left -= len(data)
            digest.update(data)
            yield archive, number, k, page and int(page), head.get("warc-target-uri"), head["warc-type"], refers and int(refers), head.get("warc-payload-digest", "").rpartition(":")[2], len(data), digest.hexdigest(), left == 0, data
            k += 1
            if not left:
                break


def read_chunks(manifest: DataFrame, data: bool = False, rows: int = 256) -> DataFrame:
    """The chunked record table of the manifest's archives: record and chunk number, and the digest of the payload so far.

    ``data`` adds the bytes. Each task holds ``rows`` pieces at most.
    """
    schema = CHUNKS + (", data binary" if data else "")
    width = schema.count(",") + 1

    def read(batches):
        from pyarrow import fs

        kept = []
        for batch in batches:
            for archive in batch["archive"]:
                store, p = fs.FileSystem.from_uri(archive if "://" in archive or ":/" in archive else f"file://{archive}")
                with store.open_input_stream(p, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for row in parse_archive(unpacked, archive):
                        kept.append(row[:width])
                        if len(kept) >= (rows if data else 16 * rows):
                            yield _frame(kept, schema)
                            kept = []
        yield _frame(kept, schema)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInPandas(read, schema)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_records(chunks: DataFrame) -> DataFrame:
    """A row per record: full payload size and digest, those of a revisit taken from the response it refers to."""
    each = chunks.groupBy("archive", "record_no").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"), F.first("declared_digest").alias("declared_digest"), F.sum("chunk_bytes").alias("own_bytes"), F.max_by("digest_so_far", "chunk_no").alias("own_digest"))
    first = each.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("own_digest").alias("declared_digest")).agg(F.max("own_bytes").alias("of_bytes"))
    revisits = each.filter("record_type = 'revisit'").withColumn("of", F.col("refers_to")).join(first, ["of", "declared_digest"], "left")
    cols = ["page_id", "url", "record_type", "refers_to"]
    return each.filter("record_type = 'response'").select(*cols, F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), (F.col("own_digest") == F.col("declared_digest")).alias("digest_ok")).unionByName(revisits.select(*cols, F.col("of_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), F.col("of_bytes").isNotNull().alias("digest_ok")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives and reads the records back. An empty table gives no rows."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, scratch), scratch)
    return read_records(read_chunks(manifest))
