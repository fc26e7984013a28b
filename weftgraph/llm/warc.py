"""WARC archives: a writer, and a sequential reader.

One gzip member per record. The reader takes an archive in pieces and inflates it incrementally
(a new inflater for each member), frames each record by its content length, and verifies block
and payload digests; it never holds more than one record.

Archives lie in the folder that driver and executors share, written under a temporary name and
then renamed. The list of archives is itself committed as a table before anything is read, so
readers see the archives of exactly one successful attempt of each writing task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh_path, materialize

VERSION = b"WARC/1.1"
READ = 1 << 18  # compressed bytes that the reader takes at once
ARCHIVE_BYTES = 64 << 20  # an archive is closed once it is this long
MOST_TASKS = 20_000  # that read archives; more archives share tasks
DATE = "2024-01-01T00:00:00Z"  # fixed, so that writing again gives the same bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: Any) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def page_of(uri: str) -> str | None:
    return uri.strip("<>").removeprefix("urn:page:") or None


def record(page_id: Any, url: str | None, payload: bytes, refers_to: Any = None) -> bytes:
    """One uncompressed record: a response, or (with refers_to) a revisit that carries the
    HTTP header of the payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_uri(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_uri(refers_to)}>")]
    lines = b"".join(k.encode() + b": " + v.encode("utf-8", "surrogatepass") + b"\r\n" for k, v in head if v)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member, without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# -- reader --------------------------------------------------------------------------------


class BadRecord(ValueError):
    """An archive that breaks its own framing or digests."""


def inflated(source: BinaryIO, size: int = READ) -> Iterator[tuple[bytes, bool]]:
    """(piece, whether its member ends with it) of an archive, inflated as it is read."""
    z, rest, begun = zlib.decompressobj(31), b"", False
    while True:
        data = rest or source.read(size)
        rest = b""
        if not data:
            if begun:
                raise BadRecord("the archive ends inside a gzip member")
            return
        begun = True
        try:
            out = z.decompress(data, size)
        except zlib.error as e:
            raise BadRecord(f"not a gzip member: {e}") from e
        if z.eof:
            yield out, True
            rest, z, begun = z.unused_data, zlib.decompressobj(31), False
        else:
            yield out, False
            rest = z.unconsumed_tail


def read_records(source: BinaryIO, size: int = READ) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, one after the other."""
    buffer, headers, want = bytearray(), None, 0
    for piece, ends in inflated(source, size):
        buffer += piece
        if headers is None and (at := buffer.find(b"\r\n\r\n")) >= 0:
            lines = bytes(buffer[:at]).split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise BadRecord("a record doesn't begin with its version")
            headers = {}
            for line in lines[1:]:
                k, _, v = line.partition(b":")
                headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "surrogatepass")
            if not headers.get("content-length", "").isdigit():
                raise BadRecord("a record without content length")
            want = int(headers["content-length"])
            del buffer[: at + 4]
        if ends:
            if headers is None or len(buffer) != want + 4 or buffer[want:] != b"\r\n\r\n":
                raise BadRecord("a record is not as long as its header says")
            block = bytes(buffer[:want])
            if (digest := headers.get("warc-block-digest")) and digest != "sha1:" + sha1_base32(block):
                raise BadRecord(f"block digest of {headers.get('warc-record-id')}")
            yield headers, block
            buffer, headers = bytearray(), None


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload where the record holds it."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("no HTTP header")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == "revisit":
        return length, digest, None
    if length != len(body) or digest != sha1_base32(body):
        raise BadRecord(f"payload of {headers.get('warc-record-id')}")
    return length, digest, body


# -- Spark ---------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of pages to archives in folder; return the committed list of
    archives (path, records, bytes).

    Of the rows with equal payloads of least_bytes or more, those with the largest id are
    responses and the others revisit that id; a row without id revisits it too, or is a response
    where no row of its group has an id. Smaller payloads are all responses. A null html is the
    empty payload, a null url has no target header.
    """
    spark = pages.sparkSession
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("first_digest"), "first"), "warc-first")
    linked = rows.join(first, (F.col("digest") == F.col("first_digest")) & (F.octet_length("html") >= least_bytes), "left")
    linked = linked.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).select("page_id", "url", "html", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, records, size, made = None, "", 0, 0, []

        def close() -> None:
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            made.append((f"{folder}/{name}", records, size))

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b[c] for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{name}", compression=None)
                data = member(record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers_to.as_py()), level)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": [m[1] for m in made], "bytes": [m[2] for m in made]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(linked.mapInArrow(write, "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, path_col: str = "path", with_payload: bool = False) -> DataFrame:
    """The records of the archives, each archive read sequentially by one task: page_id (text),
    target_uri, payload_bytes, payload_digest, record_type, refers_to (text), and with
    with_payload the payload (null for revisits). A damaged archive raises BadRecord."""
    schema = "page_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        arrow = pa.schema(list(zip(names + ["payload"] * with_payload, kinds)))
        held: list[tuple] = []
        weight = 0
        for b in batches:
            for path in b["path"].to_pylist():
                fs, at = _filesystem(path)
                with fs.open_input_stream(at, compression=None) as source:
                    for headers, block in read_records(source):
                        length, digest, payload = payload_of(headers, block)
                        refers = headers.get("warc-refers-to")
                        row = (page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest, headers["warc-type"], page_of(refers) if refers else None)
                        held.append((*row, payload) if with_payload else row)
                        weight += 200 + (len(payload or b"") if with_payload else 0)
                        if weight > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)
                            held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)], schema=arrow)

    # One task an archive: a list of paths is too short for Spark to spread by itself.
    tasks = max(1, min(MOST_TASKS, archives.count()))
    return archives.select(col(path_col).alias("path")).repartition(tasks).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, one row for each row of pages (repeated rows included). An empty
    table writes no archive and gives an empty result."""
    folder = fresh_path(pages.sparkSession, "warc")
    kind = pages.select(col(id_col)).schema[0].dataType
    back = read_archives(write_archives(pages, folder, id_col, url_col, html_col, least_bytes))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
