"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by key into shards along the key; a shard's file rolls over when its compressed size reaches a limit.
Headers and digests are made anew from the payloads; of equal payloads the first is a response record, later ones are
revisit records that refer to it. Tasks write under temporary names; when the job has succeeded the files get their
final names, and the manifest comes last. The same rows give the same files, however they are partitioned.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.shared import MOST_SHARDS, commit_files, fresh_path, hashed, located, manifest, shards_of

#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: The date of all records: archives of the same rows are equal byte by byte.
DATE = "2000-01-01T00:00:00Z"
ROWS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, target string"


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    raw = hashlib.sha256(f"{page_id}\n{url}\n{digest}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{raw[:8]}-{raw[8:12]}-5{raw[13:16]}-8{raw[17:20]}-{raw[20:32]}>"


def header_value(text: str) -> str:
    """Text as a header may hold it: control characters, spaces at the ends and % are percent-encoded."""
    raw = text.encode("utf-8", "surrogatepass")
    inner = b"".join(b"%%%02X" % c if c < 32 or c in (37, 127) or (c == 32 and i in (0, len(raw) - 1)) else bytes([c]) for i, c in enumerate(raw))
    return inner.decode("utf-8", "surrogatepass")


def header_text(value: str) -> str:
    from urllib.parse import unquote_to_bytes

    return unquote_to_bytes(value.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record, uncompressed. A revisit holds the HTTP header block alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    sha = base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("=")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {header_value(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{sha}", "Content-Type: application/http; msgtype=response"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(d.decompress(data))
            data = b""
            if d.eof:
                yield b"".join(out)
                data, d, out = d.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def parsed(raw: bytes) -> dict:
    """A row of ROWS; digests are computed anew and must agree with the headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    sha = base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("=")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.partition(b": ")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-block-digest"] != "sha256:" + sha or kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {h['warc-record-id']}: a digest is wrong")
    number = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": number("x-page-id"), "url": header_text(h["warc-target-uri"]) if "warc-target-uri" in h else None, "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "target": payload.decode("utf-8", "surrogatepass") if kind == "response" else None,
    }


def write_warc(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20) -> str:
    """Writes a record for each row (null payload: empty) in key order, rows without a key first; returns the folder.

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the smallest key (rows without a key are after all
    others; then by url) is the response. Digests are grouped with a partial count in each task; only digests that occur twice
    are joined back, to keys, and go to the shards as rows of their own. So a payload moves once.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    p = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    narrow = p.select("key", "digest", "size")
    twice = narrow.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    notes = narrow.join(twice, "digest").select("key", "digest", "first").distinct()
    none = F.lit(None).cast("string")
    p = p.withColumn("first", F.lit(None).cast("long")).withColumn("note", F.lit(False)).unionByName(notes.select("key", none.alias("url"), none.alias("payload"), F.lit(0).cast("long").alias("size"), "digest", "first", F.lit(True).alias("note")))
    shards = shards_of(pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.octet_length(payload), F.lit(0)).alias("size")), "key", F.col("size") + 256, shard_bytes)
    p = p.withColumn("shard", shards.of(F.col("key"), hashed(F.col("digest")))).repartitionById(shards.count, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("key"), F.col("digest"), F.col("note").desc(), F.col("url"))

    def write(batches):
        store, root = located(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        out = shard = temp = before = noted = None
        part = size = count = 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "temp": temp, "name": f"pages-{shard:06d}-{part:04d}.warc.gz", "records": count, "bytes": size}])

        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)}
            for k, u, t, n, digest, first, note, s in zip(*(cols[c] for c in ("key", "url", "payload", "size", "digest", "first", "note", "shard")), strict=True):
                if note:
                    noted = (k, digest, first)
                    continue
                if out and (s != shard or size >= roll_bytes):
                    yield close()
                    part, out = (part + 1 if s == shard else 0), None
                if not out:
                    shard, size, count, temp = s, 0, 0, f"_temporary/{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{temp}", compression=None)
                same = noted is not None and noted[:2] == (k, digest)
                revisit = same and (k != noted[2] or (k, digest) == before)
                before = (k, digest)
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(k, u, b"" if revisit else t.encode("utf-8", "surrogatepass"), n, digest, noted[2] if same else None, revisit)
                raw = c.compress(raw) + c.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out:
            yield close()

    return commit_files(p.mapInArrow(write, "shard long, part long, temp string, name string, records long, bytes long"), folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row of ROWS for each record (target: the payload of a response), file by file from the manifest."""
    files = manifest(spark, folder)
    n = max(1, min(files.count(), MOST_SHARDS))
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target", pa.string())])

    def read(batches):
        store, root = located(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for raw in members(f):
                        rows.append(parsed(raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    return files.select("name", F.pmod(F.col("shard") + F.col("part"), F.lit(n)).cast("int").alias("task")).repartitionById(n, F.col("task")).mapInArrow(read, ROWS)
