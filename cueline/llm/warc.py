"""WARC archives with dictionary-compressed records.

Each task writes archives of bounded size to the shared folder. A Zstandard dictionary is built from records of the
archive itself (a bounded sample, spread evenly over it) and stored in a leading skippable frame; then every record is a
frame of its own, compressed with that dictionary, so that any record can be read without the ones before it. The first is a warcinfo
record. Of pages with equal payloads one is a response, an HTTP message, and the others are revisits with its headers alone that point to it.

The name of an archive carries the attempt that wrote it. What counts is the table of archives, which Spark commits for one attempt of
each task: archives of other attempts, whatever rows they hold, are not named there and are never read.

Record ids are unique. That of a response which revisits point to follows from its row id and payload, so that they can state it;
where rows repeat both, revisits leave it out and name the row alone. All other ids are random.

Defined cases: a null payload counts as empty; payloads shorter than `min_bytes` are all responses; of rows that share
payload and the smallest id all are responses; a null id comes after all others; with no rows there is no archive; other
columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import prepare, shared_folder

#: Fixed values of the format: the skippable frame of a dictionary, the version line, and the profile of a revisit.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SALTS = 32


def open_store(uri: str):
    """A pyarrow file system and the path in it; local folders, HDFS and object stores by their scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(row: int, digest: str) -> str:
    """The id of the only response that has this row id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}:{digest}')}>"


#: Compressed bytes of archives for a task that reads them.
READ_BYTES = 64 << 20


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _record(headers: list[str], block: bytes) -> bytes:
    return VERSION + b"\r\n" + "\r\n".join([*headers, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The record that leads an archive."""
    fields = b"software: cueline\r\nformat: WARC File Format 1.1\r\n"
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def record(row: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, target: bool = False, known: bool = True) -> bytes:
    """One record; a revisit has no payload and names the record that has it, and how long it is.

    target: the record is the one response that revisits point to. known: a revisit can state the id of that record.
    """
    revisit = refers_to is not None
    block = http_head(len(payload)) + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
    headers = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row, digest) if target else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Row-ID: {'' if row is None else row}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Row-ID: {refers_to}"] if revisit else []), *([f"WARC-Refers-To: {record_id(refers_to, digest)}"] if revisit and known else []),
        "Content-Type: application/http; msgtype=response",
    ]
    return _record(headers, block)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, rest[:n]


def train(records: list[bytes], dictionary_bytes: int, sample_bytes: int) -> bytes:
    """A dictionary from records spread evenly over the archive, 33 or more where it has so many. Where there is too little to learn from, or nothing
    repeats, it is the beginning of these records as it stands, which Zstandard takes as a dictionary just so."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, min(-(-total // sample_bytes), -(-len(records) // 64)))
    sample = [x[: 1 << 16] for x in records[::step]]
    size = min(dictionary_bytes, sum(map(len, sample)) // 10)
    if len(sample) >= 8 and size >= 256:
        try:
            return zstandard.train_dictionary(size, sample, k=200, d=8, steps=4, level=3).as_bytes()
        except zstandard.ZstdError:  # nothing repeats in these records
            pass
    return b"".join(x[: max(256, dictionary_bytes // len(sample))] for x in sample)[:dictionary_bytes]


def archive(records: list[bytes], dictionary_bytes: int, sample_bytes: int) -> bytes:
    """The bytes of an archive: dictionary frame, then a frame for each record."""
    import zstandard

    trained = train(records, dictionary_bytes, sample_bytes)
    packed = zstandard.ZstdCompressor(level=3).compress(trained)
    context = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(map(context.compress, records))


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    trained = zstandard.ZstdDecompressor().decompress(stream.read(size))
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        if not rest and not (rest := stream.read(chunk)):
            return
        frame, out = context.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
            out.write(frame.decompress(rest))
            rest = frame.unused_data
        yield parse(out.getvalue())


def responses(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Each page with the id that holds its payload (`first`), if others share it, and how many rows have both (`heads`). Equal payloads
    are those of equal SHA-256 and length.

    A payload that very many pages share is counted in SALTS parts first, and each part looks up its own row.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    each = rows.where(F.length("payload") >= min_bytes).groupBy("key", "salt", "page_id").agg(F.count(F.lit(1)).alias("n"))
    low = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    part = each.groupBy("key", "salt").agg(low.alias("low"), F.sum("n").alias("n"))
    whole = part.groupBy("key").agg(F.min("low").alias("low"), F.sum("n").alias("n")).where("n > 1").select("key", F.col("low.page_id").alias("first"), F.col("low.n").alias("heads"))
    lookup = part.join(whole, "key").select(F.col("key").alias("k"), F.col("salt").alias("s"), "first", "heads")
    return rows.join(lookup, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")), "left").select("page_id", "url", "payload", "first", "heads")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_mb: int = 16, dictionary_kb: int = 64, sample_mb: int = 2) -> DataFrame:
    """Write archives to `folder` (a URI that all executors see); the table of archives: path, records, bytes. This runs the writing."""
    prepare(pages.sparkSession)
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    rows = responses(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        files, where = open_store(folder)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            name = f"part-{part:06d}-{n:04d}-{TaskContext.get().taskAttemptId()}.warc.zst"
            data = archive([warcinfo(name), *records], dictionary_kb << 10, sample_mb << 20)
            with files.open_output_stream(f"{where}/{name}", compression=None) as out:
                out.write(data)
            n += 1
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        held, size = [], 0
        for batch in batches:
            for row, url, payload, first, heads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(row, url, payload, base32_sha1(payload), None if first is None or first == row else first, first is not None and first == row and heads == 1, heads == 1))
                size += len(held[-1])
                if size >= archive_mb << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    schema = "path string, records long, bytes long"
    spark = pages.sparkSession
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/archives")
    return spark.read.schema(schema).parquet(f"{folder}/archives")


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of the archives (columns path, bytes; some READ_BYTES a task): id, type, digest as stated, payload length, referred id, target, payload.

    A response whose payload does not have the stated digest or length is an error.
    """
    prepare(archives.sparkSession)
    schema = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, where = open_store(path)
                rows, size = [], 0
                with files.open_input_stream(where, compression=None) as stream:
                    for h, block in read_archive(stream):
                        if h["warc-type"] == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2]
                        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        response = h["warc-type"] == "response"
                        if response and (len(body) != length or base32_sha1(body) != digest):
                            raise ValueError(f"a payload in {path} is not the one that was written")
                        number = lambda x: int(x) if x else None
                        rows.append((number(h["x-row-id"]), h["warc-type"], digest, length, number(h.get("x-refers-to-row-id")), h["warc-target-uri"], body if response else None))
                        size += len(body) + 300
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    least = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    return archives.select("path").repartition(max(least, total // READ_BYTES + 1), "path").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, archive_mb: int = 16) -> DataFrame:
    """Write all pages to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_warc(pages, shared_folder(pages.sparkSession, "warc"), min_bytes, archive_mb)
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
