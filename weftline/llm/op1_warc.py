"""WARC archives as a chunked record table.

Writing: each task streams its rows into archives of gzip members, one WARC
record each, payloads deflated chunk by chunk. Of records with equal payloads
of at least ``least`` bytes the one with the smallest id is a response, the
others are revisits without payload; smaller payloads are all responses.

Reading: archives are inflated as streams; a record becomes rows (record_id,
chunk_no, ...) of at most ``CHUNK`` payload bytes, each with the digest of the
payload up to its end, so that no record is held whole and the last row of a
record carries the digest of all of it.

Archives lie in the folder that driver and executors share, reached through
pyarrow's file systems (a local path, hdfs:, s3: or gs:). A task names its files after its attempt
and only the manifest of a finished attempt lists them, so a lost executor
leaves nothing that is read. The manifest is checkpointed: it is made once.

Defined results: a null payload is empty; rows that repeat whole are each a
response if theirs is the smallest id of their payload, else each a revisit; a
null id never is a response's if another id has the payload, and where all ids
are null all are responses; urls lose control characters and blanks; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import bounded_batches, checkpointed, scratch, table

CHUNK, ROLL, LEVEL = 1 << 20, 256 << 20, 1
#: Payloads of more than a share of 1 / HOT of the repeated rows are dealt over SALTS tasks.
HOT, SALTS = 512, 64
EPOCH = "1970-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no int, n_bytes long, total_bytes long, digest string, last boolean, record_type string, refers_to string, url string, declared_bytes long, declared_digest string"
_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def head(page_id: int | None, url: str | None, size: int, digest: str, first: int | None, revisit: bool, date: str) -> tuple[bytes, bytes]:
    """A record's WARC and HTTP header."""
    target = "".join(c for c in url or "" if c > " " and c != "\x7f") or "urn:unknown"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(first)}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else size)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_record(out: BinaryIO, warc: bytes, http: bytes, payload: memoryview, level: int = LEVEL) -> int:
    """One gzip member; the payload is deflated chunk by chunk."""
    z, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for part in (warc, http, *(payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)), b"\r\n\r\n"):
        n += out.write(x) or len(x) if (x := z.compress(part)) else 0
    x = z.flush()
    out.write(x)
    return n + len(x)


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = EPOCH) -> DataFrame:
    """Writes the archives; their manifest: path, records, n_bytes."""
    bounded_batches(spark)
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = checkpointed(spark, rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    # a payload that many pages have is dealt over SALTS tasks; there are at most HOT such
    limit = max(64, (firsts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.col("sha").isin([bytes(r.sha) for r in firsts.filter(F.col("n") > limit).select("sha").collect()])
    firsts = firsts.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    told = rows.withColumn("salt", salt).join(firsts, ["sha", "salt"], "left").select("page_id", "url", "payload", "sha", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem, made, out, count, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", [], None, 0, 0
        for x in batches:
            for page_id, url, payload, sha, first in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), x.column(3).to_pylist(), x.column(4).to_pylist()):
                if out is None:
                    name, count, size = f"{stem}-{len(made):03d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                body = memoryview(payload.as_buffer())
                revisit = first is not None and first != page_id and len(body) >= least
                warc, http = head(page_id, url, len(body), base32(sha), first, revisit, date)
                size += write_record(out, warc, http, body[:0] if revisit else body)
                count += 1
                if size >= ROLL:
                    out.close()
                    made.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", count, size))
        yield pa.record_batch([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "n_bytes"])

    return checkpointed(spark, told.mapInArrow(run, "path string, records long, n_bytes long"))


class Inflated:
    """The bytes of concatenated gzip members, read as a stream."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.held, self.tail = raw, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            data = self.z.unconsumed_tail or self.tail or self.raw.read(CHUNK)
            self.tail = b""
            if not data:
                return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(bytes(data), CHUNK)
            if self.z.eof:
                self.tail = self.z.unused_data
            if got:
                self.held += got
                return True

    def line(self) -> bytes:
        while (k := self.held.find(b"\n")) < 0:
            if not self._more():
                out, self.held = self.held, b""
                return out
        out, self.held = self.held[: k + 1], self.held[k + 1 :]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one unless the stream has ended."""
        if not self.held and not self._more():
            return b""
        out, self.held = self.held[:n], self.held[n:]
        return out


def headers(stream: Inflated) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name up to the empty line, and the bytes read."""
    found, n = {}, 0
    while line := stream.line():
        n += len(line)
        if line in (b"\r\n", b"\n"):
            break
        k, _, v = line.decode("utf-8", "replace").partition(":")
        found[k.strip().lower()] = v.strip()
    return found, n


def read_records(raw: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[tuple, bytes]]:
    """Rows of the chunk table with their payload bytes."""
    stream = Inflated(raw)
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        warc, _ = headers(stream)
        left = int(warc.get("content-length", 0))
        if warc.get("warc-type") not in ("response", "revisit"):
            while left and (x := stream.take(left)):
                left -= len(x)
            continue
        status = stream.line()
        http, n = headers(stream)
        left -= len(status) + n
        sha, no, total = hashlib.sha1(), 0, 0
        fixed = (warc["warc-type"], warc.get("warc-refers-to"), warc.get("warc-target-uri"), int(http.get("content-length", -1)), warc.get("warc-payload-digest", "").removeprefix("sha1:"))
        while True:
            held = []
            want = min(chunk, left)
            while want:
                if not (x := stream.take(want)):
                    raise EOFError("a record ends early")
                held.append(x)
                want -= len(x)
            part = b"".join(held)
            sha.update(part)
            left -= len(part)
            total += len(part)
            yield (warc.get("warc-record-id", ""), no, len(part), total, base32(sha.copy().digest()), not left, *fixed), part
            no += 1
            if not left:
                break


def read(spark: SparkSession, manifest: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in ``manifest`` (path): CHUNKS, and the payload bytes where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), _KINDS)]
            return pa.record_batch(columns + [pa.array(parts)] * payload, _NAMES + ["payload"] * payload)

        for x in batches:
            for uri in x.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                rows, parts, size = [], [], 0
                with fs.open_input_stream(path, compression=None) as raw:
                    for row, part in read_records(raw, chunk):
                        rows.append(row)
                        if payload:
                            parts.append(part)
                            size += len(part)
                        if size >= 4 * CHUNK or len(rows) >= 4096:
                            yield batch(rows, parts)
                            rows, parts, size = [], [], 0
                if rows:
                    yield batch(rows, parts)

    return manifest.select("path").mapInArrow(run, CHUNKS + ", payload binary" * payload)


def records(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url. Digest and size of a response are those read; of a revisit those declared."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    own = F.col("record_type") == "response"
    return chunks.filter("last").select(
        page("record_id").alias("page_id"), F.when(own, F.col("total_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "url",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark, table(spark, sf_dir, "pages"))
    return records(read(spark, archives, payload=False)).drop("url")


