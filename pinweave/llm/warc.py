"""WARC archives: pages written as whole-file gzip streams, rewritten with one member a record and a sidecar index, and read back by it."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import release
from pinweave.runtime import Scratch, broadcast_if_small

ARCHIVE_BYTES = 256 << 20  # of records before compression, after which a task begins another archive
RANGE_BYTES = 4 << 20  # of an archive whose records are read by one task together
CHUNK = 1 << 18
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"  # records have no capture time of their own
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_id string, record_type string, digest string, uri string"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file in a store that tasks and driver share."""
    if uri.startswith("file:"):
        uri = "file://" + re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of a payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    got = (name or "")[len("<urn:page:") : -1]
    return int(got) if got else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC 1.1 record of an HTTP response; with ``refers_to`` a revisit, which keeps the HTTP head (and so the payload's length) only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {SAME}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, payload, refers_to)`` as archives of one gzip stream each; ``(archive, records)`` of what was written.

    Each attempt of a task writes files of names of its own, and only those of attempts
    that succeed are in the result, which should be kept before use. A null payload is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = store(folder)
        at.create_dir(base, recursive=True)
        out = packer = name = None
        size = n = 0
        for batch in batches:
            for page, url, payload, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")], strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = at.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page, url, payload or b"", digest_of(payload or b""), first)
                out.write(packer.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})
        release()

    return pages.mapInArrow(run, "archive string, records long")


class Inflated:
    """The bytes of a gzip file of one member or more, a bounded number at a time."""

    def __init__(self, source):
        self.source, self.packed, self.ready, self.engine, self.begun = source, b"", bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        """Inflate some bytes; False at the end of the file. A file that ends within a member is an error."""
        while True:
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                if not self.packed:
                    if self.begun and not self.engine.eof:
                        raise EOFError("the gzip stream is cut off")
                    return False
            if self.engine.eof:  # another member follows
                self.engine = zlib.decompressobj(31)
            got = self.engine.decompress(self.packed, CHUNK)
            self.begun = True
            self.packed = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            if got:
                self.ready += got
                return True

    def line(self) -> bytes:
        """Up to and with the next line end; what is left at the end of the file."""
        seen = 0
        while (end := self.ready.find(b"\n", seen)) < 0:
            seen = len(self.ready)
            if not self._more():
                end = seen - 1
                break
        out = bytes(self.ready[: end + 1])
        del self.ready[: end + 1]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if not self.ready and not self._more():
                raise EOFError("a record is cut off")
            out = bytes(self.ready[:n])
            del self.ready[: len(out)]
            n -= len(out)
            yield out


def head_of(stream: Inflated) -> tuple[bytes, dict[str, str]] | None:
    """The next record's head, as it stands and by lower-case names; blank lines before it are passed over, None at the end."""
    while (line := stream.line()) and not line.strip():
        pass
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.line()).strip():
        raw.append(line)
        name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join([*raw, b"\r\n"]), fields


def normalise_file(source, target) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Inflate ``source`` once and write each record to ``target`` as a gzip member of its own; offset, length and fields of each."""
    stream, at = Inflated(source), 0
    while (got := head_of(stream)) is not None:
        head, fields = got
        packer, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        for piece in chain((head,), stream.pieces(int(fields["content-length"])), (b"\r\n\r\n",)):
            packed = packer.compress(piece)
            target.write(packed)
            n += len(packed)
        packed = packer.flush()
        target.write(packed)
        n += len(packed)
        yield at, n, fields
        at += n


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each of ``archives(archive, ...)`` of one gzip stream in ``source`` to ``target``; ``(archive, records, packed)`` of the new ones.

    A record becomes a gzip member of its own, so that it can be read by offset. Beside
    an archive lies its index, a tab-separated line a record: archive, offset, length,
    record id, type, payload digest, URI. An archive is inflated once, record by record in
    bounded pieces. Names are of an attempt, as in ``write_archives``.
    """
    names = archives.select("archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, base = store(source)
        new, to = store(target)
        new.create_dir(f"{to}/index", recursive=True)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with old.open_input_stream(f"{base}/{archive}", compression=None) as src, new.open_output_stream(f"{to}/{name}", compression=None) as dst, new.open_output_stream(f"{to}/index/{name}.tsv", compression=None) as side:
                    for offset, length, f in normalise_file(src, dst):
                        cells = (name, offset, length, f.get("warc-record-id", ""), f.get("warc-type", ""), f.get("warc-payload-digest", "").removeprefix("sha1:"), f.get("warc-target-uri", ""))
                        side.write(("\t".join(map(str, cells)) + "\n").encode("utf-8", "surrogateescape"))
                        n, size = n + 1, offset + length
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "packed": [size]})
        release()

    return names.mapInArrow(run, "archive string, records long, packed long")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """The index lines of the given archives: archive, offset, length, record_id, record_type, digest, uri."""
    lines = archives.sparkSession.read.schema(INDEX).option("sep", "\t").option("quote", "").option("escape", "").csv(f"{folder}/index")
    return lines.join(broadcast_if_small(archives.select("archive"), 100_000), "archive", "left_semi")


def parse(member: bytes) -> dict:
    """A record of one gzip member: its page, URI, type, what it refers to, its payload (None in a revisit), the payload's length and digest.

    A response's length and digest are those of the bytes that are there, and must be
    those that the record states; a revisit's are stated in its HTTP head and its own.
    """
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != stated or digest_of(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']}: the payload is not the one that the record states")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": stated, "payload_digest": digest, "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record that an index lists, read from its place in its archive; see ``parse`` for the columns.

    Index rows are dealt by ranges of an archive, so that tasks share large archives and
    read forward through small ones; payloads may be left out.
    """
    ranges = index.select("archive", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("_range")).repartition("archive", "_range").sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = store(folder)
        name = file = None
        rows, size = [], 0
        for batch in batches:
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, at.open_input_file(f"{base}/{archive}")
                row = parse(file.read_at(length, offset))
                size += row["payload_bytes"] if payloads and row["payload"] is not None else 0
                rows.append(row)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        release()

    return ranges.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """Write all pages as WARC records, normalised; the archives ``(archive, records, packed)`` and their folder.

    Of pages of equal payloads (compared by SHA-256) of at least ``min_bytes`` bytes that
    of the smallest page_id is written in full and the others as revisits of it; smaller
    payloads are always written in full. A null html is an empty payload. A null page_id
    is never the smallest; where no page of a payload has one, all are written in full, as
    are repeated rows of the smallest page_id. Null URLs leave their line out. An empty
    table gives no archives.
    """
    raw, folder = f"{scratch.base}/whole", f"{scratch.base}/warc"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.unhex(F.lit(""))).alias("payload"))
    rows = rows.withColumn("own", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("own").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("own", "first")
    shared = broadcast_if_small(scratch.keep(groups, "shared"), 100_000)
    rows = rows.join(shared, "own", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    whole = scratch.keep(write_archives(rows, raw, archive_bytes), "whole")
    n = whole.count()
    archives = scratch.keep(normalise(whole.repartition(max(1, n)), raw, folder), "archives")
    files, path = store(raw)
    if n:
        files.delete_dir(path)
    return archives, folder


def page_records(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Pages written to archives by ``archive_pages`` and read back, one row a page; see ``parse``."""
    archives, folder = archive_pages(pages, scratch, min_bytes)
    if archives.isEmpty():  # no index lies there
        return read_records(archives.sparkSession.createDataFrame([], INDEX), folder, payloads)
    return read_records(read_index(archives, folder), folder, payloads)
