"""Scoring by an interpolated modified Kneser-Ney model of word pairs.

Counting runs in Spark. Tasks count the pairs (context, word) of their own texts in numpy and send them, packed by shard of the
context; one task per shard adds them up, writes the shard of the model, and sends on what it saw of each word: tokens and
distinct contexts. One task per word shard adds these up and writes the word shard. The driver gets only sums: the
numbers of pairs and words seen once, twice, three and four times, and totals.

The model is files in the shared folder: arrays of sorted 64-bit hashes and arrays of counts beside them. Workers map
them into memory, so the pages that their texts need are read and no worker holds the model, which grows with the corpus.

A context that very many tokens have is split over SPLIT shards by its word; such contexts come from a bounded sample, and
whether one is on the list changes where its pairs lie, not what they count. Its sums are added up on the driver (a few numbers each).

The order is two: with trigrams, counts and model of this kind of text would need more disk than four times the input.

Defined cases: null text counts as empty and is one end token; an unknown word has the probability mass that discounts leave for it, and an
unknown context falls back to words alone; with nothing to learn from, every token has probability 1 / (V + 1); a null id
counts as training; repeated rows each count; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import U64, WordHash, large, mixed, parts, partitions_for, prepare, shared_folder, small

START, END = U64(0x5BF03635DCF3A2C1), U64(0xC2B2AE3D27D4EB4F)
SPLIT = 16
TAIL = 255  # counts from here on lie in an array of their own


def spread_hash(x: np.ndarray, n: int) -> np.ndarray:
    """Shards 0 .. n - 1 by the high half of a mixed hash."""
    return ((mixed(x) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(context * U64(0x9E3779B97F4A7C15) + word)


def pair_shard(context: np.ndarray, word: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    split = np.isin(context, hot) if len(hot) else np.zeros(len(context), bool)
    with np.errstate(over="ignore"):
        return spread_hash(np.where(split, context + (word % U64(SPLIT) + U64(1)) * U64(0xD6E8FEB86659FD93), context), n)


def chains(texts: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens (words, then one end a text), and how many tokens each text has."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(counts)
    word = np.empty(int(ends[-1]) if len(ends) else 0, U64)
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    word[inner] = hashes.of([w for ws in split for w in ws])
    word[ends - 1] = END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[ends - counts] = START
    return context, word, counts


def summed(keys: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct keys (sorted by the first, then the next) and the sums of values by them."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    sorted_ = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in sorted_:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return tuple(k[first] for k in sorted_), tuple(np.add.reduceat(v[order], first) for v in values)


SENT = "shard int, contexts binary, runs binary, words binary, counts binary"


def _counter(shards: int, hot: np.ndarray, tokens: int):
    """Counts of a task's pairs, sent by shard; after `tokens` tokens it sends what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            context, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            (context, word), (count,) = summed((context, word), np.ones(len(word), np.int64))
            shard = pair_shard(context, word, shards, hot)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in range(shards):
                part = order[edges[k] : edges[k + 1]]
                if len(part):
                    c = context[part]
                    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "contexts": [c[first].tobytes()], "runs": [small(np.diff(np.r_[first, len(c)]))], "words": [word[part].tobytes()], "counts": [small(count[part])]})

        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            context, word, _ = chains([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], hashes)
            held.append((context, word))
            size += len(word)
            if size >= tokens:
                yield from flush()
                size = 0
        if held and size:
            yield from flush()

    return run


PASSED = "shard int, words binary, counts binary, contexts binary, said array<double>"


def _pair_shards(folder: str, word_shards: int, hot: np.ndarray):
    """Adds up a shard's pairs, writes them, and sends what it saw of each word. said: sums for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for shard, contexts, runs, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = shard
                held.append((np.repeat(np.frombuffer(contexts, U64), large(runs)), np.frombuffer(words, U64), large(counts)))
        if number is None:
            return
        context, word, count = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        (context, word), (count,) = summed((context, word), count)
        ones = [(count == 1).astype(np.int64), (count == 2).astype(np.int64), (count >= 3).astype(np.int64)]
        (names,), kinds = summed((context,), *ones)
        key = pair_hash(context, word)
        order = np.argsort(key)
        big = count[order] >= TAIL
        write(folder, "pair", number, {"key": key[order], "count": np.minimum(count[order], TAIL).astype(np.uint8), "big_key": key[order][big], "big_count": count[order][big]})
        split = np.isin(names, hot)
        write(folder, "context", number, {"key": names[~split], **{f"n{i + 1}": k[~split].astype(np.uint32) for i, k in enumerate(kinds)}})
        said = [0.0, *(float((count == k).sum()) for k in (1, 2, 3, 4)), float(len(count))]
        rows = [(0, None, None, None, said)] + [(0, None, None, None, [1.0, float(np.flatnonzero(hot == n)[0]), *(float(k[i]) for k in kinds)]) for i, n in zip(np.flatnonzero(split), names[split], strict=True)]
        (word,), (count, contexts) = summed((word,), count, np.ones(len(word), np.int64))
        shard = spread_hash(word, word_shards)
        for k in range(word_shards):
            at = shard == k
            if at.any():
                rows.append((k, word[at].tobytes(), small(count[at]), small(contexts[at]), None))
        yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "words", "counts", "contexts", "said"])


def _word_shards(folder: str):
    """Adds up a shard's words and writes them; sums pass on to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            for shard, words, counts, contexts, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if said is not None:
                    yield _rows([(0, None, None, None, said)])
                else:
                    number = shard
                    held.append((np.frombuffer(words, U64), large(counts), large(contexts)))
        if number is None:
            return
        word, count, contexts = (np.concatenate(x) for x in zip(*held, strict=True))
        (word,), (count, contexts) = summed((word,), count, contexts)
        write(folder, "word", number, {"key": word, "count": count.astype(np.int64), "contexts": contexts.astype(np.int64)})
        yield _rows([(0, None, None, None, [2.0, *(float((contexts == k).sum()) for k in (1, 2, 3, 4)), float(len(word)), float(count.sum()), float(count[word == END].sum())])])

    return run


def write(folder: str, kind: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """Files of a shard, complete under their names only; a task that runs again replaces them with the same."""
    from cueline.llm.warc import open_store

    store, where = open_store(folder)
    for name, x in arrays.items():
        hidden = f"{where}/.{kind}-{shard}-{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(hidden, compression=None) as out:
            out.write(x.tobytes())
        store.move(hidden, f"{where}/{kind}-{shard}-{name}")


def mapped(folder: str, name: str, kind: type) -> np.ndarray:
    """An array of the model, mapped into memory; read where the shared folder is no path of this machine."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = f"{unquote(url.path)}/{name}"
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.empty(0, kind)
        with open(path, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), kind)
    from cueline.llm.warc import open_store

    store, where = open_store(folder)
    if not store.get_file_info(f"{where}/{name}").is_file:
        return np.empty(0, kind)
    with store.open_input_file(f"{where}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def found(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted hashes stand in sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


def discounts(n: list[float]) -> list[float]:
    """What is taken off counts of one, two, and three or more, from how many have each count. Never 0, so that every word has some probability."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 1.0, 1.0]
    y = n1 / (n1 + 2 * n2)
    return [float(np.clip(1 - 2 * y * n2 / n1, 0.1, 1)), float(np.clip(2 - 3 * y * n3 / n2, 0.1, 2)), float(np.clip(3 - 4 * y * n4 / n3, 0.1, 3)) if n3 else 1.0]


@dataclass
class Model:
    folder: str
    pair_shards: int
    word_shards: int
    tokens: int  # of the training texts
    texts: int
    words: int  # distinct
    pairs: int  # distinct
    discount: list[float]
    word_discount: list[float]
    word_kinds: list[float]  # words with one, two, and three or more contexts
    hot: np.ndarray
    hot_kinds: np.ndarray
    arrays: dict = field(default_factory=dict, repr=False)

    def array(self, name: str, kind: type) -> np.ndarray:
        if name not in self.arrays:
            self.arrays[name] = mapped(self.folder, name, kind)
        return self.arrays[name]

    def _by_shard(self, shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(n + 1))
        for k in np.flatnonzero(np.diff(edges)):
            yield int(k), order[edges[k] : edges[k + 1]]

    def word_counts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and distinct contexts of distinct words."""
        count, contexts = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        for k, at in self._by_shard(spread_hash(word, self.word_shards), self.word_shards):
            where, there = found(self.array(f"word-{k}-key", U64), word[at])
            count[at[there]] = self.array(f"word-{k}-count", np.int64)[where[there]]
            contexts[at[there]] = self.array(f"word-{k}-contexts", np.int64)[where[there]]
        return count, contexts

    def context_kinds(self, context: np.ndarray) -> np.ndarray:
        """How many words follow each distinct context once, twice, and more often."""
        out = np.zeros((len(context), 3))
        split = np.isin(context, self.hot)
        if split.any():
            out[split] = self.hot_kinds[np.searchsorted(self.hot, context[split])]
        rest = np.flatnonzero(~split)
        for k, at in self._by_shard(spread_hash(context[rest], self.pair_shards), self.pair_shards):
            at = rest[at]
            where, there = found(self.array(f"context-{k}-key", U64), context[at])
            for i in range(3):
                out[at[there], i] = self.array(f"context-{k}-n{i + 1}", np.uint32)[where[there]]
        return out

    def pair_counts(self, context: np.ndarray, word: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, in the order of their hashes."""
        count = np.zeros(len(key), np.int64)
        for k, at in self._by_shard(pair_shard(context, word, self.pair_shards, self.hot), self.pair_shards):
            where, there = found(self.array(f"pair-{k}-key", U64), key[at])
            count[at[there]] = self.array(f"pair-{k}-count", np.uint8)[where[there]]
            big = at[count[at] == TAIL]
            if len(big):
                where, _ = found(self.array(f"pair-{k}-big_key", U64), key[big])
                count[big] = self.array(f"pair-{k}-big_count", np.int64)[where]
        return count

    def logs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, and how often training has its word."""
        names, inverse = np.unique(np.r_[context, word], return_inverse=True)
        c, w = inverse[: len(context)], inverse[len(context) :]
        tokens, contexts = self.word_counts(names)
        d, e = np.array([0.0, *self.discount]), np.array([0.0, *self.word_discount])
        unknown = (np.dot(self.word_discount, self.word_kinds) / self.pairs if self.pairs else 1.0) / (self.words + 1)
        alone = (np.maximum(contexts - e[np.minimum(contexts, 3)], 0) / self.pairs if self.pairs else 0.0) + unknown
        total = np.where(names == START, self.texts, np.where(names == END, 0, tokens))
        left = self.context_kinds(names) @ np.array(self.discount)
        key = pair_hash(context, word)
        key, first, back = np.unique(key, return_index=True, return_inverse=True)
        count = self.pair_counts(context[first], word[first], key)
        off = np.maximum(count - d[np.minimum(count, 3)], 0)[back]
        seen = total[c] > 0
        p = np.where(seen, (off + left[c] * alone[w]) / np.maximum(total[c], 1), alone[w])
        return np.log10(p), tokens[w]


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_words(docs: DataFrame, rows: int, share: float) -> np.ndarray:
    """Sorted hashes of the start and of words with a share of the tokens of about `rows` documents: 1 / share at most."""
    rate = max(1, docs.count() // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            _, word, _ = chains([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], hashes)
            name, count = np.unique(word, return_counts=True)
            keep = count >= share * len(word) / 2
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.r_[name[keep], U64(0)].view(np.int64)), "n": pa.array(np.r_[count[keep], len(word)].astype(np.int64))})

    sample = _given(docs).where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(rate)) == 0)
    got = {r[0]: r[1] for r in sample.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).orderBy(F.desc("sum(n)")).limit(int(2 / share)).collect()}
    total = got.get(0, 0)
    names = np.array([k for k, n in got.items() if k and n >= share * total], np.int64).view(U64)
    return np.unique(np.r_[names[names != END], START])


def train_model(docs: DataFrame, sample_rows: int = 2000, hot_share: float = 0.004, task_tokens: int = 3_000_000) -> Model:
    """Count all documents and write the model to the shared folder."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "language-model")
    from cueline.llm.warc import open_store

    store, where = open_store(folder)
    store.create_dir(where, recursive=True)
    hot = frequent_words(docs, sample_rows, hot_share)
    shards = partitions_for(docs, 32)
    word_shards = max(1, shards // 4)
    sent = _given(docs).mapInArrow(_counter(shards, hot, task_tokens), SENT).repartitionById(shards, F.col("shard"))
    passed = sent.mapInArrow(_pair_shards(folder, word_shards, hot), PASSED).repartitionById(word_shards, F.col("shard"))
    said = [r.said for r in passed.mapInArrow(_word_shards(folder), PASSED).collect()]
    pair, words = np.zeros(5), np.zeros(7)
    kinds = np.zeros((len(hot), 3))
    for x in said:
        if x[0] == 0:
            pair += x[1:]
        elif x[0] == 1:
            kinds[int(x[1])] += x[2:]
        else:
            words += x[1:]
    return Model(folder, shards, word_shards, int(words[5]), int(words[6]), int(words[4]), int(pair[4]), discounts(list(pair[:4])), discounts(list(words[:4])), [words[0], words[1], words[4] - words[0] - words[1]], hot, kinds)


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Tokens, known tokens, the score by words alone with half counts, and the model's log10 probability of each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHash(), shared.value
        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            if not batch.num_rows:
                continue
            context, word, counts = chains([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], hashes)
            logs, known = m.logs(context, word)
            begins = np.cumsum(counts) - counts
            base = np.log10((known + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
            columns = [pa.array(counts), pa.array(np.add.reduceat((known > 0).astype(np.int64), begins)), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(logs, begins))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in SCORED.split(", ")])

    return _given(docs).mapInArrow(run, SCORED)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 5 is not 1 and score all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    model = train_model(docs.where(~held))
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
