"""Web archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Tasks write archives of bounded size to the shared folder and hand on their paths; a task that
is repeated writes new files, and only the paths that Spark kept are read. Of equal payloads from
``min_bytes`` on, one record is the response and the others refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.storage import fresh_path, materialize

MIN_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
# The dictionary: its size, and about how much text it is trained on.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 8 << 20
# No page of the sample is larger.
SAMPLE_PAGE_BYTES = SAMPLE_BYTES >> 4
LEVEL = 3
# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
    block = block.encode() + END + (payload if refers_to is None else b"")
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page is None else f"<urn:page:{page}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", header_value(url)))
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    head = "\r\n".join(f"{n}: {v}" for n, v in lines).encode("utf-8", "replace")
    return VERSION + b"\r\n" + head + END + block + END


def fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            raise ValueError(f"not a header line: {line[:80]!r}")
        found[name.decode().lower()] = value.decode("utf-8")
    return found


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def parsed(raw: bytes) -> dict:
    """A record's content; ValueError if its headers, lengths or digest don't fit."""
    head, end, rest = raw.partition(END)
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not end:
        raise ValueError(f"not a record: {raw[:40]!r}")
    warc = fields(lines)
    kind, length = warc.get("warc-type"), int(warc["content-length"])
    if kind not in ("response", "revisit") or len(rest) != length + len(END) or not rest.endswith(END):
        raise ValueError(f"{kind} of {len(rest)} bytes, {length} announced")
    http, end, payload = rest[:length].partition(END)
    size = int(fields(http.partition(b"\r\n")[2])["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if not end or len(payload) != (size if kind == "response" else 0):
        raise ValueError(f"payload of {len(payload)} bytes, {size} announced")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload doesn't fit its digest")
    return {
        "page": page_of(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": page_of(warc.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; where they are too few for that, their text itself, or nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Text that starts like a trained dictionary would be taken for one.
        return b"\x00" + b"".join(samples)[: DICTIONARY_BYTES] if any(samples) else b""


class ArchiveWriter:
    """Archives of about ``ARCHIVE_BYTES`` each in a folder."""

    def __init__(self, folder: str, trained: bytes):
        self.files, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.trained = trained
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        self.out = None

    def add(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """Writes a record; gives (name, records, bytes) of an archive that is full."""
        if self.out is None:
            self.name, self.records = f"{uuid.uuid4().hex}.warc.zst", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            if self.trained:
                self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(self.trained)) + self.trained)
        self.out.write(self.compressor.compress(raw))
        self.records += 1
        if self.out.tell() >= ARCHIVE_BYTES:
            yield from self.close()

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.out is not None:
            size = self.out.tell()
            self.out.close()
            self.out = None
            yield self.name, self.records, size


def frames(stream) -> Iterator[bytes]:
    """The records of an archive; ValueError where it is cut off or not made of frames."""
    data, shared = stream.read(READ_BYTES), None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        data = data[8:]
        if len(data) < size:
            data += stream.read(size - len(data))
        if len(data) < size:
            raise ValueError("the dictionary is cut off")
        trained, data = data[:size], data[size:]
        if trained[:4] == FRAME_MAGIC:
            trained = zstandard.ZstdDecompressor().decompress(trained)
        shared = zstandard.ZstdCompressionDict(trained)
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    while data or (data := stream.read(READ_BYTES)):
        frame, out = decompressor.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as error:
                raise ValueError(f"not a frame: {error}") from error
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(READ_BYTES)):
                raise ValueError("the last frame is cut off")
        yield b"".join(out)


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(name, records, bytes) of the archives that hold a record for every row of ``pages``.

    NULL pages are empty ones. Equal payloads are found by their digests; the record with the
    largest id is the response (all that have it, if rows repeat), a NULL id is below all others.
    """
    plain = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"),
    )
    plain = plain.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    large = plain.filter(F.col("size") >= min_bytes)
    copies = large.groupBy("digest").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies.filter("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "warc-copies")
    total = plain.agg(F.sum("size")).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    drawn = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20))
    # Copies are made one before they travel, and a page too large to be typical is no sample.
    drawn = plain.filter(drawn & (F.col("size") <= SAMPLE_PAGE_BYTES)).groupBy("digest").agg(F.first("payload").alias("payload"))
    sample, held = [], 0
    for row in drawn.orderBy("digest").toLocalIterator():
        if held + len(row["payload"]) > SAMPLE_BYTES:
            break
        sample.append(bytes(row["payload"]))
        held += len(row["payload"])
    trained = dictionary(sample)
    shared = pages.sparkSession.sparkContext.broadcast(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, shared.value)

        def told(done):
            for name, records, size in done:
                yield pa.RecordBatch.from_pylist([{"name": name, "records": records, "bytes": size}])

        for batch in batches:
            for page, url, payload, digest, keeper in zip(*(batch.column(i) for i in range(5))):
                page, keeper = page.as_py(), keeper.as_py()
                refers_to = keeper if keeper is not None and keeper != page else None
                made = record(page, url.as_py(), payload.as_py(), digest.as_py(), refers_to)
                yield from told(writer.add(made))
        yield from told(writer.close())

    joined = plain.join(copies, "digest", "left").select("page", "url", "payload", "digest", "keeper")
    return joined.mapInArrow(write, "name string, records bigint, bytes bigint")


SCHEMA = "page bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(archives: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """``columns`` of every record in the archives named by ``archives(name, records)``."""
    names = archives.sparkSession.createDataFrame([], SCHEMA).select(*columns).schema

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        schema = to_arrow_schema(names)
        for batch in batches:
            for name, records in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
                rows, size, n = [], 0, 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in frames(stream):
                        found = parsed(raw)
                        rows.append({c: found[c] for c in columns})
                        size, n = size + len(raw), n + 1
                        if size > ARCHIVE_BYTES // 8 or len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    tasks = max(1, min(archives.count(), 10_000))
    return archives.select("name", "records").repartition(tasks).mapInArrow(load, names)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives."""
    folder = fresh_path(pages.sparkSession, "warc")
    archives = materialize(written(pages, folder, id_col, **options), "warc-archives")
    columns = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read(archives, folder, columns).withColumnRenamed("page", id_col)
