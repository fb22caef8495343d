"""Quality classifier: a factorisation machine over hashed words, statistics of a text's structure, and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum takes linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Words weigh log(1 + count), scaled to length 1;
each statistic falls in one of a few bins, which are features; so does the number of characters that the table states.

Training rows are a bounded sample of the labelled ones, `train_rows` at most (rows of one id included), the first by a hash of their id; the driver
gets their features and learns in numpy, the same for the same rows. Scoring reads every text as a whole.

Defined cases: null text counts as empty and is scored by its bins; labels other than 0 and 1 are not used; if only one label or none is
there, every score is the share of label 1 (0.5 without labels); of an id with several labels the largest holds; repeated rows each get
their row; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import U64, WordHash, parts, prepare

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SIGNS = b"#*$%&|<>{}[]\\^~@_=+/"
_STOPS = b".,;:!?"
#: Edges of the bins of each statistic: words, letters a word, shares of capitals, digits, signs, stops and distinct words, words a line, repeated lines, stated size, words like the one before.
EDGES = [
    np.array([1, 5, 20, 50, 150, 500, 2000]), np.array([2, 3, 4, 5, 6, 8, 12]), np.array([0.005, 0.02, 0.05, 0.1, 0.3, 0.6]), np.array([0.001, 0.005, 0.02, 0.05, 0.2]), np.array([0.001, 0.01, 0.03, 0.1, 0.3]),
    np.array([0.005, 0.01, 0.02, 0.04, 0.1]), np.array([0.05, 0.15, 0.3, 0.5, 0.7, 0.9]), np.array([3, 8, 20, 60, 200]), np.array([0.001, 0.05, 0.2, 0.5]), np.array([0, 30, 150, 500, 2000, 10000]), np.array([0.01, 0.05, 0.2, 0.5]),
]
OFFSETS = np.cumsum([0, *(len(e) + 1 for e in EDGES)])


def statistics(text: bytes, words: list[bytes], distinct: int, stated: int | None) -> np.ndarray:
    """The bin of each statistic, as feature numbers from 0 on."""
    n, size = len(words), max(1, len(text))
    share = lambda chars: 1 - len(text.translate(None, chars)) / size if text else 0.0
    lines = [x for x in text.split(b"\n") if x]
    values = [n, size / max(1, n), share(_UPPER), share(_DIGITS), share(_SIGNS), share(_STOPS), distinct / max(1, n), n / max(1, len(lines)), 1 - len(set(lines)) / len(lines) if lines else 0.0, -1 if stated is None else stated, sum(map(eq, words, words[1:])) / max(1, n)]
    return np.array([np.searchsorted(e, v, side="right") for e, v in zip(EDGES, values, strict=True)]) + OFFSETS[:-1]


@dataclass
class Rows:
    """Features of several rows in one array: row begins, feature numbers, values."""

    begins: np.ndarray
    index: np.ndarray
    value: np.ndarray


def featurise(texts: list[bytes], stated: list[int | None], slots: int, hashes: WordHash) -> Rows:
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = hashes.of([w for ws in split for w in ws]) % U64(slots)
    key = np.repeat(np.arange(len(texts), dtype=np.int64), counts) * slots + flat.astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    row, index, value = key // slots, key % slots, np.log1p(times)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    value = value / norm[row]
    distinct = np.bincount(row, minlength=len(texts))
    stats = np.stack([statistics(t, ws, int(d), s) for t, ws, d, s in zip(texts, split, distinct, stated, strict=True)]) + slots
    width = stats.shape[1]
    size = distinct + width
    begins = np.cumsum(size) - size
    out_index, out_value = np.empty(int(size.sum()), np.int64), np.full(int(size.sum()), 0.3)
    stat_at = (begins + distinct)[:, None] + np.arange(width)
    out_index[stat_at.ravel()] = stats.ravel()
    word_at = np.ones(len(out_index), bool)
    word_at[stat_at.ravel()] = False
    out_index[word_at], out_value[word_at] = index, value
    return Rows(begins, out_index, out_value)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slots: int

    def margins(self, r: Rows) -> np.ndarray:
        x = r.value[:, None].astype(np.float32)
        vx = self.factors[r.index] * x
        total, squares = np.add.reduceat(vx, r.begins), np.add.reduceat(vx * vx, r.begins)
        return self.bias + np.add.reduceat(self.linear[r.index] * r.value, r.begins) + 0.5 * (total * total - squares).sum(1)

    def scores(self, r: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(r), -30, 30)))


def fit_machine(rows: Rows, labels: np.ndarray, slots: int, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 2e-5, batch: int = 128, seed: int = 3, steps: int = 600) -> Machine:
    """Logistic loss by AdaGrad over small batches, in an order that the seed fixes; epochs at least, and more of them where these make fewer than `steps` steps."""
    rng = np.random.default_rng(seed)
    width = slots + int(OFFSETS[-1])
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(width), rng.normal(scale=0.02, size=(width, rank)).astype(np.float32), slots)
    if len(np.unique(labels)) < 2:
        m.factors[:] = 0
        return m
    square_linear, square_factors, square_bias = np.full(width, 1e-6), np.full((width, rank), 1e-6, np.float32), 1e-6
    ends = np.r_[rows.begins[1:], len(rows.index)]
    for _ in range(max(epochs, -(-steps // -(-len(labels) // batch)))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = ends[pick] - rows.begins[pick]
            take = np.repeat(rows.begins[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            r = Rows(np.cumsum(sizes) - sizes, rows.index[take], rows.value[take])
            error = m.scores(r) - labels[pick]
            each = np.repeat(error, sizes)
            used, where = np.unique(r.index, return_inverse=True)
            x = r.value[:, None].astype(np.float32)
            v = m.factors[r.index]
            total = np.repeat(np.add.reduceat(v * x, r.begins), sizes, axis=0)
            slope = each[:, None].astype(np.float32) * x * (total - v * x)
            g = np.bincount(where, each * r.value) / len(pick) + decay * m.linear[used]
            gf = np.stack([np.bincount(where, slope[:, f]) for f in range(rank)], axis=1).astype(np.float32) / len(pick) + decay * m.factors[used]
            square_linear[used] += g * g
            square_factors[used] += gf * gf
            m.linear[used] -= rate * g / np.sqrt(square_linear[used])
            m.factors[used] -= 0.5 * rate * gf / np.sqrt(square_factors[used])
            gb = float(error.mean())
            square_bias += gb * gb
            m.bias -= rate * gb / float(np.sqrt(square_bias))
    return m


def _given(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("n_chars"))


def _held(c) -> F.Column:
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def train_machine(docs: DataFrame, labels: DataFrame, slots: int = 1 << 15, train_rows: int = 8000) -> Machine:
    """docs: doc_id, text, n_chars; labels: doc_id, quality."""
    spark = docs.sparkSession
    prepare(spark)
    good = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = sorted((r[0], r[1]) for r in good.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(train_rows).collect())
    shared = spark.sparkContext.broadcast((np.array([x[0] for x in chosen], np.int64), np.array([x[1] for x in chosen], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, quality = shared.value
        hashes = WordHash()
        for whole in batches:
            own = whole.column(0).fill_null(-1).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            mine = np.flatnonzero((ids[at] == own) & ~whole.column(0).is_null().to_numpy(zero_copy_only=False)) if len(ids) else np.empty(0, np.int64)
            if not len(mine):
                continue
            for batch in parts(whole.take(pa.array(mine)), 4 << 20):
                r = featurise([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], batch.column(2).to_pylist(), slots, hashes)
                ends = np.r_[r.begins[1:], len(r.index)]
                numbers = batch.column(0).to_pylist()
                y = quality[np.searchsorted(ids, numbers)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(numbers, pa.int64()), "quality": pa.array(y, pa.int32()), "index": [r.index[a:b].astype(np.int32).tobytes() for a, b in zip(r.begins, ends, strict=True)], "value": [r.value[a:b].astype(np.float32).tobytes() for a, b in zip(r.begins, ends, strict=True)]})

    found = _given(docs).mapInArrow(run, "doc_id long, quality int, index binary, value binary")
    got = sorted(found.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id", F.xxhash64("index", "value"), "index", "value").limit(train_rows).collect())  # repeated ids, too, stay within the bound
    if not got:
        return fit_machine(Rows(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.empty(0), slots)
    index, value = [np.frombuffer(r["index"], np.int32) for r in got], [np.frombuffer(r["value"], np.float32) for r in got]
    sizes = np.array([len(x) for x in index])
    return fit_machine(Rows(np.cumsum(sizes) - sizes, np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64)), np.array([r.quality for r in got], float), slots)


def score_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each row's whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHash(), shared.value
        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            r = featurise([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], batch.column(2).to_pylist(), m.slots, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(r), pa.float64())], names=["doc_id", "score"])

    return _given(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents whose crc32(doc_id) mod 5 is not 0 and score all: doc_id, held_out, score, predicted."""
    machine = train_machine(docs, labels.where(~_held(F.col("doc_id"))))
    return score_quality(docs, machine).select("doc_id", _held(F.col("doc_id")).alias("held_out"), "score", "predicted")
