"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into `buckets` slots. Their counts over the whole corpus make one multinomial, those
over a trusted target another. A document scores the mean over its n-grams of log (share in the target + prior) /
(share in the corpus + prior), so that rare n-grams say little; dividing by their number makes lengths comparable. The prior is a share too:
more of the same documents gives the same scores. Every document with a mean under `threshold` goes, as does one that fails the base rules.

The trusted target are all documents that `labels` marks with quality 1, found by a join on the id. The corpus counts cover
every document. Counts are summed in Spark, a slice of the slots per task and at most
about FAN tasks' counts at a time, level by level; the driver gets one array of `buckets` entries.

Defined cases: null text counts as empty and fails the base rules; without trusted documents every ratio is 0 and the
base rules decide; documents of the same id and repeated rows each get their row; other columns are not touched; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import COUNTS, FAN, U64, WordHash, given, large, ngram_hashes, parts, partitions_for, prepare, sliced, summed, texts

SYMBOLS = "#*$%&|<>"
#: What is added to both shares of an n-gram: those that are rarer than it say little.
PRIOR = 1e-4
NO_SLOTS = np.empty(0, np.int64)
#: So many trusted ids are broadcast; beyond that Spark shuffles both sides of the join.
BROADCAST_IDS = 500_000


def slots(words: np.ndarray, buckets: int) -> np.ndarray:
    """Slots of the words and of the word pairs."""
    return (np.concatenate([words, ngram_hashes(words, 2)]) % U64(buckets)).astype(np.int64)


def repeated_words(words: np.ndarray, window: int = 8) -> int:
    """How many words lie in windows that occur more than once."""
    grams = ngram_hashes(words, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    hit = np.zeros(len(grams), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and trusted: whether labels give the document quality 1."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good__", F.lit(True))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return given(docs).join(good, "doc_id", "left").select("doc_id", "text", F.col("good__").isNotNull().alias("trusted"))


def fit_ratios(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, prior: float = PRIOR, fan: int = FAN) -> np.ndarray:
    """The log ratio of each slot, from counts over all documents and over the trusted ones."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, target, hashes = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), WordHash()
        for batch in (x for whole in batches for x in parts(whole)):
            good = batch.column(2).to_numpy(zero_copy_only=False)
            found = [slots(hashes.of(text.split()), buckets) for text in texts(batch)]
            total += np.bincount(np.concatenate([NO_SLOTS, *found]), minlength=buckets)
            target += np.bincount(np.concatenate([NO_SLOTS, *(x for x, g in zip(found, good, strict=True) if g)]), minlength=buckets)
        yield sliced(np.concatenate([total, target]))

    sums = summed(with_trust(docs, labels).mapInArrow(count, COUNTS), partitions_for(docs), fan=fan).collect()
    both = np.concatenate([large(r.counts) for r in sorted(sums)]) if sums else np.zeros(2 * buckets)
    total, target = both[:buckets], both[buckets:]
    if not target.sum():
        return np.zeros(buckets, np.float32)
    return np.log((target / target.sum() + prior) / (total / total.sum() + prior)).astype(np.float32)


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def mean_ratio(words: np.ndarray, table: np.ndarray) -> float:
    """The mean log ratio of a text's n-grams, from the hashes of its words."""
    return float(table[slots(words, len(table))].mean(dtype=np.float64)) if len(words) else 0.0


def base_fails(n_words, n_repeat_words):
    """The base rules, over numbers or columns."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def quality_stats(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """The counts of each document and its score; no verdict yet."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHash(), shared.value
        for whole in batches:
            for batch in parts(whole):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                    words = text.split()
                    h = hashes.of(words)
                    joined = b"".join(words)
                    chars = len(joined) if joined.isascii() else len(joined.decode())
                    out.append((doc_id, len(words), chars, sum(joined.count(c) for c in SYMBOLS.encode()), repeated_lines(text), repeated_words(h), mean_ratio(h, table)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.float64())], names=[x.split()[0] for x in STATS.split(", ")])

    return given(docs).mapInArrow(run, STATS)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, buckets: int = 1 << 18, prior: float = PRIOR) -> DataFrame:
    """One row per document: its counts, base_failed, kept, and the score that decided."""
    stats = quality_stats(docs, fit_ratios(docs, labels, buckets, prior))
    return stats.withColumn("base_failed", base_fails(F.col("n_words"), F.col("n_repeat_words"))).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, buckets: int = 1 << 18, prior: float = PRIOR) -> DataFrame:
    """The documents that the rules keep, with all their columns and without a join: each text is judged where it is read."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit_ratios(docs, labels, buckets, prior))

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        hashes, out = WordHash(), []
        for text in texts:
            words = hashes.of((text or "").encode().split())
            out.append(not base_fails(len(words), repeated_words(words)) and mean_ratio(words, shared.value) >= threshold)
        return pd.Series(out, dtype=bool)

    return docs.where(kept(F.col("text").cast("string")))
