"""WARC archives: a writer that replaces repeated payloads by revisits, and a splittable reader.

An archive is a row of gzip members, a record each. The reader cuts files into byte
ranges; a task looks for the gzip magic in its range, takes a place as a member's start if
what follows decodes to a WARC header, and owns the records that start inside the range,
to their ends, even beyond it. From a record's end the next one follows directly; where it
does not, the search goes on byte by byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written
from .kernels import slices

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of a read, and of a header at most.
SPLIT, READ, HEAD = 8 << 20, 1 << 18, 1 << 16
DATE = "2000-01-01T00:00:00Z"
ID = "urn:quire:record:"


def filesystem(path: str):
    """A pyarrow file system and the path in it. Local paths and URIs of stores that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """SHA-1 in base32, without a label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with refers_to a revisit of that page's response, without the payload."""
    fields = [("WARC-Target-URI", _escaped(url))] if url else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    record_id = ID + ("none" if page_id is None else str(page_id))
    if refers_to is None:
        return _record("response", record_id, fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    return _record("revisit", record_id, fields, http)


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html with refers_to: of equal payloads of at least `least` bytes the largest page_id, null for that page itself."""
    salts = 8
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1("html"), "bytes": F.octet_length("html")})
    last = own.where(F.col("bytes") >= least).groupBy(F.col("sha").alias("of_sha"), F.col("bytes").alias("of_bytes")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = last.select("of_sha", "of_bytes", "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"))
    salt = F.pmod(F.hash("page_id"), F.lit(salts))
    joined = own.withColumn("salt", salt).join(last, (F.col("sha") == F.col("of_sha")) & (F.col("bytes") == F.col("of_bytes")) & (F.col("salt") == F.col("of_salt")), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html, ...) to archives in the folder `path`; path, length and records of each.

    A task writes one archive, under a name of its attempt. The result is written as a
    table, so that archives of lost or repeated attempts are in no row of it. Of equal payloads of at least `least` bytes the
    row with the largest page_id is a response (all rows with this page_id are, if it is
    repeated), others revisit it. Null html is the empty payload; a null page_id is less than all
    others, and if all are null, all are responses; a null url is left out. An empty table gives no archive.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sink, n, size = TaskContext.get(), None, 0, 0
        store, folder = filesystem(path)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        for batch in rows:
            for part in slices(batch, "html"):
                for page, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if sink is None:
                        store.create_dir(folder, recursive=True)
                        sink = store.open_output_stream(f"{folder}/{name}", compression=None)
                        first = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: quire\r\nformat: WARC File Format 1.1\r\n")
                        sink.write(first)
                        size += len(first)
                    record = page_record(page, url, html.encode(), refers)
                    sink.write(record)
                    n, size = n + 1, size + len(record)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "length", "records"])

    return written(planned(pages, least).mapInArrow(run, "path string, length long, records long"), "archives")


class Range:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, at: int, length: int):
        self.file, self.at, self.length = file, at, length
        self.held = b""  # the bytes from `at` on

    def ask(self, n: int) -> bytes:
        """At least n bytes from the place on, if there are so many."""
        while len(self.held) < n and self.at + len(self.held) < self.length:
            self.file.seek(self.at + len(self.held))
            more = self.file.read(max(READ, n - len(self.held)))
            if not more:
                break
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n


def _is_record(source: Range) -> bool:
    """Whether a member that decodes to a WARC header begins here."""
    head = source.ask(3)
    if not head.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(source.ask(HEAD)[:HEAD], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(source: Range) -> bytes:
    """The member that begins here, decoded, and the place moved to its end; a cut or broken one raises zlib.error."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        chunk = source.ask(1)
        if not chunk:
            raise zlib.error("cut off")
        out.append(unpack.decompress(chunk))
        source.skip(len(chunk) - len(unpack.unused_data))
    return b"".join(out)


def records(file, length: int, low: int, high: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields by lower-case name, block) of the records that start in [low, high) of a file; broken members are passed over."""
    source = Range(file, low, length)
    while source.at < min(high, length):
        if not _is_record(source):
            found = source.ask(2 * len(MAGIC)).find(MAGIC, 1)
            source.skip(found if found > 0 else max(1, len(source.held) - len(MAGIC) + 1))
            continue
        at = source.at
        try:
            raw = _member(source)
        except zlib.error:
            source = Range(file, at + 1, length)
            continue
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        size = fields.get("content-length", "")
        yield at, fields, block[: int(size)] if size.isdecimal() else block


RECORDS = "path string, at long, type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives, but for warcinfo; files: path and length. A task reads a byte range.

    payload: the body of an HTTP response, else the block; of a revisit null, whose length
    is that in its HTTP header. payload_digest: as the record says, without its label.
    """
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("low"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, length, low in zip(*(c.to_pylist() for c in batch.columns)):
                store, place = filesystem(path)
                out, size = [], 0
                with store.open_input_file(place) as file:
                    for at, fields, block in records(file, length, low, low + split):
                        kind = fields.get("warc-type", "")
                        if kind == "warcinfo":
                            continue
                        head, blank, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
                        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                        payload = None if kind == "revisit" else body
                        n = int(told[1]) if kind == "revisit" and told else len(body)
                        out.append((path, at, kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None, fields.get("warc-payload-digest", "").rpartition(":")[2] or None, n, payload))
                        size += len(body)
                        if size > 4 << 20 or len(out) >= 5_000:
                            yield _rows(out)
                            out, size = [], 0
                if out:
                    yield _rows(out)

    return ranges.repartition(F.col("path"), F.col("low")).mapInArrow(run, RECORDS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in RECORDS.split(", ")])


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files in a folder or of a pattern, listed by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, as read back from archives written to the shared folder. The digest of a response is taken from the payload that was read."""
    spark = pages.sparkSession
    files = write_warc(pages, scratch(spark, "warc"), least)
    read = read_warc(spark, files)

    def page(c: str):
        return F.when(F.col(c) != ID + "none", F.substring(c, len(ID) + 1, 30).cast("long"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            told, payload = batch.column("payload_digest").to_pylist(), batch.column("payload").to_pylist()
            own = pa.array([t if p is None else digest(p) for t, p in zip(told, payload)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "payload_digest" else own for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    own = read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "payload")
    return own.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
