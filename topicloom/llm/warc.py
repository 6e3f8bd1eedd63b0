"""WARC archives with Zstandard dictionaries, written from a table of pages and read back.

Every archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from records of this
archive, itself compressed; after it comes one Zstandard frame per record. An archive needs nothing besides
itself to be read. A task trains on the first ``TRAIN_BYTES`` of its records, then streams the rest, so its memory
is bounded. The dictionary changes sizes only; where there are too few records for one, the frame is left out.

Of records with equal payloads of at least ``least`` bytes, that with the smallest page_id is the response; the
others are revisits, which keep the HTTP header with the payload's length, its digest and a reference, but no
payload. Smaller payloads are all responses.

Defined results: a null html is an empty payload. Rows that repeat a page_id and its payload are each the record
with the smallest page_id, so all are responses if that is theirs. A null page_id refers to a known one and is
a response if there is none; it comes back null. A null url leaves out the target URI. Control characters
in a url are percent-encoded in the header. An empty table gives no archives. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import created, filesystem, new_folder, own_name

SKIPPABLE = 0x184D2A5D
LEVEL = 6
TRAIN_BYTES = 2 << 20
#: At most so much of a record is used for training.
TRAIN_RECORD = 16 << 10
DICTIONARY_BYTES = 32 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
#: Bytes given to the decompressor at once, and read from storage at once.
WINDOW, READ = 16 << 10, 4 << 20

MANIFEST = "file string, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response) of every page.

    Only digests that occur more than once are joined back, and the join may split a digest with many pages.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        page.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return page.join(shared.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; the payload follows an HTTP header with its length, which a revisit keeps."""
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(uri: str | None) -> int | None:
    name = (uri or "").strip("<>")
    return int(name.removeprefix(PAGE)) if name.startswith(PAGE) else None


def parse(data: bytes) -> dict:
    """Fields of a record, with its payload if it is a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    found = {
        "page_id": _number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(inner["Content-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("WARC-Refers-To")),
        "payload": None,
    }
    if found["record_type"] == "response":
        found |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        if (len(payload), found["payload_digest"]) != (int(inner["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its header says")
    return found


class Archive:
    """Writes one archive: trains on its first records, then compresses each record by itself."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor:
            self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= TRAIN_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        samples, held = [x[:TRAIN_RECORD] for x in self.waiting], None
        if len(samples) >= 16:
            try:
                held = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples)
            except zstandard.ZstdError:  # too alike to train on: then some of them are the dictionary
                held = zstandard.ZstdCompressionDict(b"".join(samples[:: -(-len(samples) // 16)])[:DICTIONARY_BYTES])
        if held is not None:
            content = zstandard.ZstdCompressor(level=LEVEL).compress(held.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held)
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.out.close()


def write(resolved: DataFrame, folder: str) -> DataFrame:
    """Write records of ``resolved`` as archives in ``folder``, one per partition; returns the manifest."""
    spark = resolved.sparkSession
    created(folder)

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        name, archive, n = own_name(TaskContext.get().partitionId(), ".warc.zst"), None, 0
        for batch in batches:
            ids, refers = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                archive = archive or Archive(store.open_output_stream(f"{root}/{name}", compression=None))
                url, payload, digest = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                archive.add(record(ids[i], url, payload, digest, refers[i]))
                n += 1
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    resolved.mapInArrow(write_part, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(source) -> Iterator[bytes]:
    """Records of an open archive, in order, with bounded reading."""
    import zstandard

    data, at = source.read(READ), 0
    held = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        at = 8 + struct.unpack("<I", data[4:8])[0]
        while len(data) < at:
            data += source.read(READ)
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:at]))
    decompressor = zstandard.ZstdDecompressor(dict_data=held)
    while True:
        if at >= len(data):
            data, at = source.read(READ), 0
            if not data:
                return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                data, at = source.read(READ), 0
                if not data:
                    raise ValueError("the archive ends within a record")
            window = data[at : at + WINDOW]
            parts.append(frame.decompress(window))
            at += len(window) - len(frame.unused_data)
        yield b"".join(parts)


def read(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that the manifest lists; one archive is read by one task."""
    schema = RECORDS + ", payload binary" * with_payload
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for data in records(source):
                        rows.append(parse(data))
                        size += 256 + len(data) * with_payload
                        if size > READ:
                            yield _batch(rows, names, kinds)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    files = manifest.select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(read_files, schema)


def _batch(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def archived(pages: DataFrame, least: int = 100) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read(spark, folder, write(resolve(pages, least), folder))
