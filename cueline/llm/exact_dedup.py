"""Exact dedup by an extendible-hash index on shared files.

Each task first combines equal texts among its own rows, so that a text that a third of all rows repeat leaves a task once, not once a
row. Owner tasks, each with one range of the hash keys, insert these texts into an extendible-hash index: a directory of 2^depth
slots points to buckets, an overfull bucket splits by one more bit, and the directory doubles when the bucket already uses all its bits.
Texts whose keys are equal are chained, and bytes decide whether they are the same. An owner gets its texts in the order of their keys
(Spark sorts them, on disk where they are many), so a bucket is complete, written and released as soon as a key lies behind it, and an
owner holds one bucket at a time, whatever its range holds.

The index of an owner is two files in the shared folder: buckets, one Arrow record batch each, and the directory, the number of the
bucket of each slot. Their names carry the attempt that wrote them; the table of owners, which Spark commits for one attempt of each
task, says which count. Rows look their text up in these files, each distinct text once in a task: from the directory to the bucket and
along the chain to the entry with their digest. So a lost executor costs tasks and nothing else.

Defined cases: null text counts as empty; a null id comes after all others; of rows with the same text and id one
stays; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.shared import SALTS, SPACE, partitions_for, prepare, shared_folder, stored, texts

LAST = (1 << 63) - 1  # the id of rows that have none: after every other
M32 = (1 << 32) - 1
KEY_SEED = 42  # of Spark's xxhash64


def normalised(text: bytes) -> bytes:
    """The text with every run of white space (0x20, 0x09-0x0D) replaced by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def key_of(text: bytes) -> int:
    """The 64-bit key of a text, as Spark's xxhash64 has it but for the sign."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text, seed=KEY_SEED)


def place_of(key: int, owners: int) -> tuple[int, int]:
    """The owner of a key, and where the key lies in that owner's range, as 64 bits in the same order."""
    high = (key >> 32) * owners
    return high >> 32, (high & M32) << 32 | key & M32


class Entry:
    """One text of the index: its smallest id, how many rows have it, and what comes with the row of that id."""

    __slots__ = ("count", "key", "low", "payload", "text")

    def __init__(self, key: int, text: bytes, low: int, count: int, payload: dict | None = None) -> None:
        self.key, self.text, self.low, self.count, self.payload = key, text, low, count, payload

    def add(self, low: int, count: int, payload: dict | None) -> None:
        self.count += count
        if low < self.low:
            self.low, self.payload = low, payload


class Bucket:
    """Chains of entries by place; `bits` are the first `depth` bits that all its places have. number: once it is written."""

    __slots__ = ("bits", "chains", "depth", "number", "size")

    def __init__(self, bits: int, depth: int) -> None:
        self.bits, self.depth, self.size, self.number = bits, depth, 0, -1
        self.chains: dict[int, list[Entry]] = {}

    def put(self, place: int, chain: list[Entry]) -> None:
        self.chains[place] = chain
        self.size += sum(len(e.text) for e in chain)


class ExtendibleIndex:
    """Extendible hashing over 64-bit places. A bucket holds `capacity` places or `max_bytes` of text; texts of one place share a chain."""

    def __init__(self, capacity: int = 512, max_bytes: int = 4 << 20) -> None:
        self.capacity, self.max_bytes, self.depth, self.written = capacity, max_bytes, 0, 0
        self.directory = [Bucket(0, 0)]

    def bucket(self, place: int) -> Bucket:
        return self.directory[place >> (64 - self.depth)]

    def insert(self, place: int, key: int, text: bytes, low: int, count: int, payload: dict | None = None) -> None:
        bucket = self.bucket(place)
        for entry in bucket.chains.get(place, ()):
            if entry.text == text:
                entry.add(low, count, payload)
                return
        bucket.chains.setdefault(place, []).append(Entry(key, text, low, count, payload))
        bucket.size += len(text)
        while (len(bucket.chains) > self.capacity or bucket.size > self.max_bytes) and len(bucket.chains) > 1 and bucket.depth < 64:
            self._split(bucket)
            bucket = self.bucket(place)

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory = [b for b in self.directory for _ in range(2)]
            self.depth += 1
        low, high = Bucket(bucket.bits << 1, bucket.depth + 1), Bucket(bucket.bits << 1 | 1, bucket.depth + 1)
        for place, chain in bucket.chains.items():
            (high if place >> (63 - bucket.depth) & 1 else low).put(place, chain)
        width = 1 << (self.depth - bucket.depth)
        at = bucket.bits * width
        self.directory[at : at + width] = [low] * (width // 2) + [high] * (width // 2)

    def complete(self, place: int | None, since: int = 0) -> Iterator[Bucket]:
        """Buckets with texts, from slot `since` on, that lie before a place (None: all), in order; each is numbered, and empty afterwards."""
        end = len(self.directory) if place is None else place >> (64 - self.depth)
        slot = since
        while slot < end:
            bucket = self.directory[slot]
            if (place is None or bucket is not self.directory[end]) and bucket.chains:
                bucket.number, self.written = self.written, self.written + 1
                yield bucket
                bucket.chains = {}
            slot = (bucket.bits + 1) << (self.depth - bucket.depth)

    def slots(self) -> np.ndarray:
        """The number of the bucket of each slot; -1 where it has no texts."""
        return np.array([b.number for b in self.directory], np.int32)


def _combine_schema(payload: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("low", T.LongType()), T.StructField("count", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("payload", payload)])


def _combiner(owners: int, memory: int, arrow: pa.Schema):
    """Equal texts of a task become one row, with the smallest id and what comes with it. Keys are shifted so that their order is that of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = [key_of(text) for text in held]
            rows = [(place_of(key, owners)[0], key - (1 << 63), low, count, text, payload) for key, (text, (low, count, payload)) in zip(keys, held.items(), strict=True)]
            held.clear()
            return _batch(rows, arrow)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            payloads = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for k, text in enumerate(map(normalised, texts(batch))):
                low = LAST if ids[k] is None else ids[k]
                entry = held.get(text)
                if entry is None:
                    held[text] = [low, 1, payloads and payloads[k]]
                    size += len(text) * (2 if payloads else 1) + 300
                else:
                    entry[1] += 1
                    if low < entry[0]:
                        entry[0], entry[2] = low, payloads and payloads[k]
                if size > memory:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _owned(batches: Iterator[pa.RecordBatch], owners: int, index_of) -> Iterator[tuple[int, ExtendibleIndex, Bucket | None]]:
    """Insert the rows of a task, which come in the order of owner and key. Each bucket when it is complete, and each owner's index (no bucket) at its end."""
    owner, index, slot = None, None, 0
    for batch in batches:
        for owner_, key, low, count, body, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if owner_ != owner:
                if index is not None:
                    yield from ((owner, index, b) for b in index.complete(None))
                    yield owner, index, None
                owner, index, slot = owner_, index_of(), 0
            place = place_of(key + (1 << 63), owners)[1]
            depth, at = index.depth, index.bucket(place)
            index.insert(place, key, body, low, count, payload)
            slot <<= index.depth - depth
            if index.depth > depth or index.bucket(place) is not at or place >> (64 - index.depth) > slot:
                yield from ((owner, index, b) for b in index.complete(place, slot))
                here = index.bucket(place)
                slot = here.bits << (index.depth - here.depth)
    if index is not None:
        yield from ((owner, index, b) for b in index.complete(None, slot))
        yield owner, index, None


#: What a bucket holds of each text. place_in_chain: 0 unless other texts have its key.
ENTRY = pa.schema([("key", pa.int64()), ("place_in_chain", pa.int32()), ("low", pa.int64()), ("group_size", pa.int64()), ("sha256", pa.binary(32)), ("body", pa.binary())])


def _entries(bucket: Bucket) -> pa.RecordBatch:
    return _batch([(e.key, k, e.low, e.count, hashlib.sha256(e.text).digest(), e.text) for chain in bucket.chains.values() for k, e in enumerate(chain)], ENTRY)


def _sent(docs: DataFrame, columns: list, memory_mb: int) -> tuple[DataFrame, T.DataType, int]:
    """The combined texts, at their owners and in the order of their keys."""
    from pyspark.sql.pandas.types import to_arrow_schema

    owners = partitions_for(docs, 32)
    payload = docs.select(F.struct(*columns).alias("payload")).schema["payload"].dataType if columns else T.StructType([T.StructField("none", T.IntegerType())])
    schema = _combine_schema(payload)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*columns).alias("payload")] if columns else []))
    combined = given.mapInArrow(_combiner(owners, memory_mb << 20, to_arrow_schema(schema)), schema)
    return combined.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", "key"), payload, owners


OWNERS = "owner int, path string, depth int, buckets long"


def build_index(docs: DataFrame, capacity: int = 512, memory_mb: int = 48, bucket_mb: int = 4) -> tuple[DataFrame, int]:
    """Write the index of all texts; the table of owners (owner, path of its buckets, depth of its directory, buckets), and how many ranges there are."""
    from cueline.llm.warc import open_store

    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "exact-index")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    sent, _, owners = _sent(docs, [], memory_mb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = open_store(folder)
        out, writer = None, None
        for owner, index, bucket in _owned(batches, owners, lambda: ExtendibleIndex(capacity, bucket_mb << 20)):
            name = f"owner-{owner:07d}-{TaskContext.get().taskAttemptId()}"
            if writer is None:
                out = files.open_output_stream(f"{where}/{name}.buckets", compression=None)
                writer = pa.ipc.new_file(out, ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            if bucket is not None:
                writer.write_batch(_entries(bucket))
                continue
            writer.close()
            out.close()
            writer = None
            with files.open_output_stream(f"{where}/{name}.directory", compression=None) as directory:
                directory.write(index.slots().tobytes())
            yield pa.RecordBatch.from_pydict({"owner": pa.array([owner], pa.int32()), "path": [f"{folder}/{name}"], "depth": pa.array([index.depth], pa.int32()), "buckets": pa.array([index.written], pa.int64())})

    return stored(sent.mapInArrow(run, OWNERS), "exact-owners"), owners


class IndexFile:
    """The files of one owner: its directory, and its buckets, of which the last one read is held."""

    def __init__(self, path: str) -> None:
        from cueline.llm.warc import open_store

        store, where = open_store(path)
        with store.open_input_stream(f"{where}.directory", compression=None) as f:
            self.slots = np.frombuffer(f.read(), np.int32)
        self.depth = len(self.slots).bit_length() - 1
        self.file = store.open_input_file(f"{where}.buckets")
        self.buckets = pa.ipc.open_file(self.file)
        self.number, self.chains = -1, {}

    def find(self, place: int, key: int, sha: bytes) -> tuple[int, int]:
        """Smallest id and group size of the text with this key and digest."""
        number = int(self.slots[place >> (64 - self.depth)])
        if number != self.number:
            batch = self.buckets.get_batch(number)
            self.number, self.chains = number, {}
            for k, low, size, digest in zip(*(batch.column(n).to_pylist() for n in ("key", "low", "group_size", "sha256")), strict=True):
                self.chains.setdefault(k, []).append((digest, low, size))
        for digest, low, size in self.chains[key]:
            if digest == sha:
                return low, size
        raise KeyError(f"no entry for key {key}")

    def close(self) -> None:
        self.file.close()


ANSWERS = "sha binary, salt int, keep_row long, keep_id long, group_size long"


def look_up(asked: DataFrame, index: DataFrame, owners: int) -> DataFrame:
    """The entry of each distinct text, once for each of its parts. asked: key, sha, salt, and low: the smallest (id, row) of the part.

    Parts of one text come one after the other; the least of their rows is the one that stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, sha, held, best = None, None, None, [], None
        answers: list[tuple] = []
        names, types = ["sha", "salt", "keep_row", "keep_id", "group_size"], [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

        def settle() -> None:
            if held:
                low, size = file.find(place_of(held[0][0] + (1 << 63), owners)[1], held[0][0], sha)
                if low != best[0]:
                    raise ValueError("the index does not have the smallest id of its rows")
                answers.extend((sha, salt, best[1], None if low == LAST else low, size) for _, salt in held)
                held.clear()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*answers, strict=True), types, strict=True)], names=names)
            answers.clear()
            return out

        for batch in batches:
            for path_, key, sha_, salt, low, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha_ != sha or path_ != path:
                    settle()
                    if path_ != path:
                        if file is not None:
                            file.close()
                        path, file = path_, IndexFile(path_)
                    sha, best = sha_, (low, row)
                held.append((key, salt))
                best = min(best, (low, row))
            if len(answers) > 50_000:
                yield made()
        settle()
        if answers:
            yield made()
        if file is not None:
            file.close()

    owner = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * owners, 32).cast("int")
    shifted = asked.select(owner.alias("owner"), F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), "sha", "salt", "low.id", "low.row")
    found = shifted.join(index.select("owner", "path"), "owner").repartitionById(owners, F.col("owner")).sortWithinPartitions("owner", "key", "sha")
    return found.select("path", "key", "sha", "salt", "id", "row").mapInArrow(run, ANSWERS)


def exact_dedup(docs: DataFrame, capacity: int = 512, memory_mb: int = 48, bucket_mb: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. `docs` has doc_id and text.

    capacity, bucket_mb: keys and text of a bucket before it splits. memory_mb: distinct text that a task holds while it combines.
    """
    index, owners = build_index(docs, capacity, memory_mb, bucket_mb)
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    # row numbers decide between rows of one id; stored, they are the same whatever runs again
    members = stored(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int")), "members")
    asked = members.groupBy("key", "sha", "salt").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row")).alias("low"))
    found = members.join(look_up(asked, index, owners), ["sha", "salt"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, capacity: int = 512, memory_mb: int = 48, bucket_mb: int = 4) -> DataFrame:
    """The rows that stay, with all their columns, straight from the owners' buckets: no join brings them back."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    sent, payload, owners = _sent(docs, [F.col(f"`{c}`") for c in docs.columns], memory_mb)
    out = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("group_size", T.LongType()), T.StructField("payload", payload)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, _, bucket in _owned(batches, owners, lambda: ExtendibleIndex(capacity, bucket_mb << 20)):
            if bucket is not None:
                yield _batch([(owner, bucket.number, e.count, e.payload) for chain in bucket.chains.values() for e in chain], arrow)

    return stored(sent.mapInArrow(run, out), "exact-index").select("payload.*")
