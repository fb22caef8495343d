"""Importance resampling towards a target: array-scored weights, the exact k-th key by radix selection, ranks of what is drawn.

1. Features are runs of one to three words; a feature's bucket is the CRC-32 of its bytes. The CRC of a run follows from those of its words by
   table lookups, so buckets of a whole batch of texts are computed as arrays. Both corpora's buckets are counted over all their texts, in
   Spark; the driver gets two arrays of `buckets` counts.
2. A document's weight is the sum of its features' gains; a hash of its id gives the noise that turns the largest scores into a weighted
   draw. The scored rows are stored, four numbers each.
3. The draw's last key is found by radix selection: the rows are counted by the leading 16 bits of their keys (score, then id) that are not the
   same in all, then those of the bucket that holds the k-th by the next 16, and so on. A round is an aggregation to at most 65,536 counts.
4. Only rows up to that key are sorted by range and ranked: a row's rank is its place in its partition and the sizes of the partitions before.

Defined cases: null text counts as empty, has no features and weight 0; rows that share an id each take part, ordered by score, id (none last) and number
of features; rows alike in all of these are interchangeable, and exactly as many are drawn as are due; an id that is null is hashed as ''; without
benchmark or documents all counts are 0; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import given, large, partitions_for, parts, prepare, sliced, stored, stretches, summed, texts

GRAMS, BUCKETS = 3, 10_000
#: Words of one array step, and the bytes of a stretch of a long text.
WORDS, STRETCH = 200_000, 1 << 20
#: Each byte of a text in a word, or a blank: letters in lower case, digits, and all beyond ASCII.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DIRECT = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending n zero bytes makes of each byte of a CRC: for n below DIRECT, and for DIRECT times powers of two."""
    one = np.array([[zlib.crc32(b"\0", b << 8 * k) ^ zlib.crc32(b"\0") for b in range(256)] for k in range(4)], np.uint32)
    direct = [np.array([[b << 8 * k for b in range(256)] for k in range(4)], np.uint32)]
    while len(direct) <= DIRECT:
        direct.append(_looked_up(one, direct[-1]))
    powers = [direct.pop()]
    while len(powers) < 32:
        powers.append(_looked_up(powers[-1], powers[-1]))
    return np.stack(direct), powers


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def appended(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a longer string's CRC that comes from its beginning, of this CRC, if `length` bytes follow; the other part is their own CRC."""
    direct, powers = _tables()
    n = length % DIRECT
    out = direct[n, 0, crc & 255] ^ direct[n, 1, crc >> 8 & 255] ^ direct[n, 2, crc >> 16 & 255] ^ direct[n, 3, crc >> 24]
    rest, k = length // DIRECT, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _looked_up(powers[k], out[at])
        rest, k = rest >> 1, k + 1
    return out


class WordCrc(dict):
    """CRC-32 and length of words, each computed once while it is held; emptied when it holds too many."""

    def __init__(self, limit: int = 150_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = len(word) << 32 | zlib.crc32(word)
        return value


def run_buckets(words: list[bytes], place: np.ndarray, crcs: WordCrc, buckets: int) -> np.ndarray:
    """Buckets of the runs of one, two and three words that end at each word, a row each. place: how many words of its text are before it;
    -1 where a run would begin before the text does."""
    packed = np.fromiter(map(crcs.__getitem__, words), np.int64, len(words))
    crc, length = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
    spaced = appended(np.full(len(words), zlib.crc32(b" "), np.uint32), length) ^ crc
    out, run = np.full((GRAMS, len(words)), -1, np.int64), crc
    for n in range(GRAMS):
        if n:
            run = np.concatenate([[np.uint32(0)], appended(run[:-1], length[1:] + 1) ^ spaced[1:]])
        full = place >= n
        out[n, full] = run[full] % buckets
    return out


def text_buckets(batch: list[bytes], crcs: WordCrc, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, buckets of the runs that end there) of all words of some texts, many words at a time."""
    words: list[bytes] = []
    owner: list[int] = []
    begins: list[int] = []
    skip: list[int] = []  # words that are there only for the runs that begin in them

    def flush() -> tuple[np.ndarray, np.ndarray]:
        n = np.diff([*begins, len(words)])
        first = np.repeat(begins, n)
        at = np.arange(len(words)) - first
        found = run_buckets(words, np.where(at < np.repeat(skip, n), -1, at), crcs, buckets)
        return np.repeat(owner, n), found

    for k, text in enumerate(batch):
        seen = 0
        for stretch in stretches(text.translate(BYTES), GRAMS - 1, STRETCH):
            known = min(seen, GRAMS - 1)
            begins.append(len(words))
            owner.append(k)
            skip.append(known)
            words += stretch
            seen += len(stretch) - known
            if len(words) >= WORDS:
                yield flush()
                words, owner, skip, begins = [], [], [], []
    if words:
        yield flush()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, crcs = np.zeros(buckets, np.int64), WordCrc()
        for batch in (x for whole in batches for x in parts(whole)):
            for _, found in text_buckets(texts(batch), crcs, buckets):
                total += np.bincount(found[found >= 0], minlength=buckets)
        yield sliced(total, 1)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slice int, sender int, counts binary")
    sums = summed(rows, partitions_for(docs), 1).collect()  # one array
    return large(sums[0].counts) if sums else np.zeros(buckets, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Words, features, weight and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, crcs = np.append(shared.value, 0), WordCrc()  # -1 finds the 0
        for batch in (x for whole in batches for x in parts(whole)):
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for owner, found in text_buckets(texts(batch), crcs, len(own) - 1):
                words += np.bincount(owner, found[0] >= 0, n).astype(np.int64)
                features += np.bincount(owner, (found >= 0).sum(0), n).astype(np.int64)
                np.add.at(weight, owner, own[found].sum(0))
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, score))], names=[x.split()[0] for x in SCORED.split(", ")])

    return given(docs).mapInArrow(run, SCORED)


#: Columns of the order in which rows are drawn, the smallest first.
KEY = ("key_score", "key_none", "key_id", "key_features")
TOP = 1 << 63


def kth_key(rows: DataFrame, k: int, digit: int = 16) -> tuple[list[int], int]:
    """The k-th smallest key (from 1) of the KEY columns, and how many rows of just this key are among the first k.

    Each round counts the rows that are left by the next digit of their key and goes on with those of the digit that holds the k-th.
    """
    found: list[int] = []
    for c in KEY:
        low, high = rows.agg(F.min(c), F.max(c)).first()
        low, high = low + TOP, high + TOP  # as unsigned
        while low < high:
            shift = max(0, (low ^ high).bit_length() - digit)
            value = F.expr(f"shiftrightunsigned({c} ^ {-TOP + 1}L ^ 1L, {shift}) & {(1 << digit) - 1}L")
            for d, n in sorted(rows.groupBy(value.alias("d")).count().collect()):
                if k <= n:
                    break
                k -= n
            low = low >> shift + digit << shift + digit | d << shift
            high = low | (1 << shift) - 1
            rows = rows.where(F.col(c).between(low - TOP, high - TOP))
            if n == 1:  # no need to look at the rest of it digit by digit
                return list(rows.select(*KEY).first()), 1
        found.append(low - TOP)
        rows = rows.where(F.col(c) == low - TOP)
    return found, k


def _compared(key: list[int]) -> tuple[Column, Column]:
    """Whether a row's key is smaller, and whether it is the same."""
    less, same = F.lit(False), F.lit(True)
    for c, v in zip(KEY, key, strict=True):
        less, same = less | (same & (F.col(c) < v)), same & (F.col(c) == v)
    return less, same


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """Rows with rank: their place, from 1, in the order of KEY."""
    # equal rows may be very many: a number of their own deals them over partitions
    own = rows.withColumn("own__", F.monotonically_increasing_id())
    placed = stored(own.repartitionByRange(partitions_for(rows), *KEY, "own__").sortWithinPartitions(*KEY, "own__").withColumn("at__", F.monotonically_increasing_id()), name)
    sizes = sorted(placed.groupBy(F.expr("at__ >> 33").alias("part")).count().collect())  # a number a partition
    if not sizes:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("own__", "at__")
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part__ long, before__ long")
    numbered = placed.withColumn("part__", F.expr("at__ >> 33")).join(F.broadcast(offsets), "part__")
    return numbered.withColumn("rank", F.expr("before__ + (at__ & 8589934591) + 1")).drop("own__", "at__", "part__", "before__")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if it is not drawn). docs: doc_id, text; target: text.

    Of the documents with `least_words` words or more, `percent` in a hundred are drawn, rounded down.
    """
    rows = stored(scored(docs, gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)), seed), "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    keyed = rows.select(*out, (F.col("n_words") >= least_words).alias("takes_part"), F.expr("~score").alias("key_score"), F.col("doc_id").isNull().cast("long").alias("key_none"), F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("n_features").alias("key_features"))
    k = percent * keyed.where("takes_part").count() // 100
    if not k:
        return keyed.select(*out, F.lit(None).cast("long").alias("rank"))
    less, same = _compared(kth_key(keyed.where("takes_part"), k)[0])
    drawn = F.col("takes_part") & (less | same)
    best = ranked(keyed.where(drawn), "drawn").select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))  # more than k only if rows are equal
    return best.union(keyed.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
