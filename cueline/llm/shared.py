"""What the operators of this package share: the shared folder, worker imports, partition sizes."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: White space and words of every contract: bytes.split() cuts at exactly these characters.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver has it on its path, and give them batches of bounded size."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m"):  # its default; long texts would make workers large
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


#: Folders that this driver has made, by URI, with the Hadoop file system that removes each.
_MADE: dict[str, tuple] = {}
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, in the folder that all executors see: the one of spark.checkpoint.dir.

    Where the cluster names none that is an error, except with a local master, whose executors are this machine. The folder goes when
    this driver ends, if `forget` has not removed it before.
    """
    prepare(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    if not _MADE:
        atexit.register(lambda: [_remove(x) for x in list(_MADE)])
    _MADE[uri] = (path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return uri


def _remove(uri: str) -> None:
    store, path = _MADE.pop(uri)
    try:
        store.delete(path, True)
    except Exception as e:  # the JVM or the store may be gone by now; what is left lies in the shared folder
        print(f"left behind: {uri} ({type(e).__name__})")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: what follows does not depend on executors that may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        if (uri := _FOLDERS.pop(df, None)) in _MADE:
            _remove(uri)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of a plan's rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb: int = 32, growth: float = 3.0) -> int:
    """Partitions of about `mb` MB; Parquet text grows about `growth` times when decoded. At least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    return max(least, int(size * growth / (mb << 20)) + 1) if size < 1 << 60 else least


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hashes of words, each computed once while it is held; emptied when it holds too many."""

    def __init__(self, limit: int = 150_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows over word hashes; none if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, U64)
        for k in range(n):
            total = total * U64(0x9E3779B97F4A7C15) + words[k : k + count]
    return mixed(total)


def small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


SLICES, FAN = 64, 64
COUNTS = "slice int, sender int, counts binary"


def sliced(counts: np.ndarray, slices: int = SLICES) -> pa.RecordBatch:
    """What a task has counted, a row a slice."""
    size = -(-len(counts) // slices)
    return _packed(range(slices), TaskContext.get().partitionId(), [counts[k * size : (k + 1) * size] for k in range(slices)])


def _packed(slices, sender: int, counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array(slices, pa.int32()), "sender": pa.array([sender] * len(counts), pa.int32()), "counts": [small(x) for x in counts]})


def summed(rows: DataFrame, senders: int, slices: int = SLICES, fan: int = FAN) -> DataFrame:
    """One row a slice with the sum of what all tasks have sent of it, a slice a partition.

    What very many senders have to say of a slice would be too much for one task: at most about `fan` of them meet in one, level by level.
    """

    def add(of: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, sender, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, got = (k, sender // of), large(data)
                    if key in sums:
                        sums[key] += got
                    else:
                        sums[key] = got
            for (k, sender), counts in sums.items():
                yield _packed([k], sender, [counts])

        return run

    while senders > fan:
        senders = -(-senders // fan)
        rows = rows.repartition(slices * senders, "slice", F.expr(f"sender div {fan}")).mapInArrow(add(fan), COUNTS)
    return rows.repartitionById(slices, F.col("slice")).mapInArrow(add(1 << 31), COUNTS)


#: A side of a join of up to so many narrow rows is broadcast; beyond that Spark shuffles both sides.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A table of few narrow columns as a side of a join: broadcast if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


SALTS = 32


def looked_up(rows: DataFrame, key: str, by: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with the one row that `table` has for each key. A key that very many rows have is dealt over SALTS tasks by
    another column: each of its parts looks the key up once, and the rows meet the answer of their part."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    parts_ = rows.select(key, salt.alias("salt_of_part")).distinct().join(table, key)
    return rows.withColumn("salt_of_part", salt).join(parts_, [key, "salt_of_part"], how).drop("salt_of_part")


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, overlap: int, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, some `limit` bytes at a time; each stretch begins with the last `overlap` words before it."""
    begin, before = 0, []
    while begin < len(text):
        blank = _BLANK.search(text, begin + limit)
        end = blank.start() if blank else len(text)
        words = before + text[begin:end].split()
        yield words
        begin, before = end, words[-overlap:] if overlap else []


def given(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and more text columns of documents, whatever else there is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in more])


def parts(batch: pa.RecordBatch, max_bytes: int = 1 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts stay near max_bytes together, one row at least."""
    column = batch.column(batch.schema.get_field_index(name))
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else np.empty(0, np.int64)
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
