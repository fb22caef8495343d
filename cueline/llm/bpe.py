"""BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a batch lie as symbols in one flat array. In each round the rank of every neighbouring pair is
found by binary search over the sorted pair keys of the vocabulary, the lowest rank of each word is taken, and all its
occurrences merge at once, from the left where they overlap. Words without a known pair leave. Each token of the
vocabulary has one merge that makes it, so that rounds give what merging one pair at a time gives; load() checks this.

The file is a BPE model of the tokenizers library with word ends, lower-casing and byte-level symbols. Texts are cut
at white space, which no token spans, so results of a word are kept and reused within a task.

Defined cases: null text counts as empty and gives no tokens; texts of any length; special tokens in a text become
their own ids; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.shared import parts, prepare

NONE = np.int64(1 << 40)
#: Fixed values of this kind of model: its pre-token pattern, and the characters that both this file's pattern and Unicode count as white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
BLANKS = r"[\t-\r \x85\xA0  -     　]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]
    first: np.ndarray  # by byte: id of its symbol inside a word
    last: np.ndarray  # by byte: id of its symbol at a word's end
    keys: np.ndarray  # sorted left << 32 | right
    ranks: np.ndarray  # of keys
    made: np.ndarray  # by rank: id of the merged token
    specials: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, specials = given["model"], {x["content"]: x["id"] for x in given["added_tokens"]}
        ids = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("two merges make one token; merge rounds would not be exact")
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        tokens = [""] * (max([*ids.values(), *specials.values()]) + 1)
        for t, i in [*ids.items(), *specials.items()]:
            tokens[i] = t
        symbols = byte_symbols()
        return Vocabulary(tokens, np.array([ids[s] for s in symbols], np.int64), np.array([ids[s + end] for s in symbols], np.int64), keys[order], order.astype(np.int64), np.array(made, np.int64), specials)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where the vocabulary has no such pair."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)


def merge_rounds(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and where each word begins (one more entry at the end). No word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    ids = v.first[symbols]
    ids[ends - 1] = v.last[symbols[ends - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    done_ids, done_words = [], []
    ranks = np.full(len(ids), NONE)  # of each symbol and the next one of its word
    inside = np.flatnonzero(word[1:] == word[:-1])
    ranks[inside] = v.pair_ranks(ids[inside], ids[inside + 1])
    while len(ids):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(ids)])
        lowest = np.minimum.reduceat(ranks, starts)
        over = lowest == NONE
        if over.any():
            leave = np.repeat(over, sizes)
            done_ids.append(ids[leave])
            done_words.append(word[leave])
            stay = ~leave
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            lowest, sizes = lowest[~over], sizes[~over]
            if not len(ids):
                break
        hit = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        run = np.r_[True, np.diff(hit) != 1]  # pairs that overlap: every second one of a run, from its left
        hit = hit[(hit - np.repeat(hit[run], np.diff(np.r_[np.flatnonzero(run), len(hit)]))) % 2 == 0]
        ids[hit] = v.made[ranks[hit]]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, word, ranks = ids[keep], word[keep], ranks[keep]
        hit -= np.arange(len(hit))
        changed = np.r_[hit, hit[hit > 0] - 1]  # only pairs with a merged symbol have new ranks
        ranks[changed] = NONE
        changed = changed[changed < len(ids) - 1]
        changed = changed[word[changed] == word[changed + 1]]
        ranks[changed] = v.pair_ranks(ids[changed], ids[changed + 1])
    if not done_ids:
        return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return ids[order].astype(np.int32), np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]


class Encoder:
    """Encodes batches of texts; keeps the tokens of up to `limit` words."""

    def __init__(self, v: Vocabulary, limit: int = 120_000) -> None:
        import regex

        self.v, self.limit = v, limit
        self.pieces = regex.compile(PIECES)
        self.blanks = regex.compile(BLANKS)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.specials, key=len, reverse=True)) + ")") if v.specials else None
        self.marks = [s[:2] for s in v.specials]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The text cut at white space; str.split() also cuts at four control characters that the model takes for others."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.blanks.split(text) if x]
        return text.split()

    def _pieces(self, word: str) -> list[str | int]:
        """Pre-tokens of a word; special tokens as ids."""
        if self.special and any(m in word for m in self.marks):
            out: list[str | int] = []
            for part in self.special.split(word):
                out += [self.v.specials[part]] if part in self.v.specials else self._plain(part)
            return out
        return self._plain(word)

    def _plain(self, word: str) -> list[str]:
        if not word.isascii():
            if "Cn" in map(unicodedata.category, word):
                return self._unknown(word)
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return self.pieces.findall(word.lower())

    def _unknown(self, word: str) -> list[str]:
        """Pieces of a word with characters that Python's Unicode tables don't know yet; the library's may."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        word = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(word)
        return [x for x, _ in pre_tokenizers.Split(Regex(PIECES), "removed", invert=True).pre_tokenize_str(word)]

    def _learn(self, new: list[str]) -> None:
        flat: list[bytes] = []
        plan: list[list[int]] = []  # per word: index into flat, or -1 - special id
        index: dict[str, int] = {}
        for w in new:
            row = []
            for p in self._pieces(w):
                if isinstance(p, int):
                    row.append(-1 - p)
                else:
                    at = index.get(p)
                    if at is None:
                        index[p] = at = len(flat)
                        flat.append(p.encode())
                    row.append(at)
            plan.append(row)
        ids, starts = merge_rounds(self.v, flat) if flat else (np.empty(0, np.int32), np.zeros(1, np.int64))
        counts = np.fromiter(map(len, plan), np.int64, len(plan))
        pieces = np.fromiter((x for row in plan for x in row), np.int64, int(counts.sum()))
        own = pieces < 0
        ids = np.r_[ids, (-1 - pieces[own]).astype(np.int32)]
        at = np.where(own, 0, pieces)
        lengths = np.where(own, 1, np.diff(starts)[at] if len(flat) else 1)
        begins = np.where(own, len(ids) - own.sum() + np.cumsum(own) - 1, starts[at])
        got = ids[spread(begins, lengths)]
        total = np.r_[0, np.cumsum(lengths)]
        ends = total[np.cumsum(counts)]
        for w in new:
            self.number[w] = len(self.number)
        self.starts = np.r_[self.starts, self.starts[-1] + ends]
        self.ids = np.r_[self.ids, got]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and where each text begins (one more entry at the end)."""
        split = [self.words(t) for t in texts]
        if len(self.number) > self.limit:
            self._clear()
        new = dict.fromkeys(w for ws in split for w in ws)
        new = [w for w in new if w not in self.number]
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((i for ws in split for i in map(self.number.__getitem__, ws)), np.int64, int(counts.sum()))
        lengths = np.diff(self.starts)[at]
        total = np.r_[0, np.cumsum(lengths)]
        return self.ids[spread(self.starts[at], lengths)], total[np.r_[0, np.cumsum(counts)]]


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges begins[i] .. begins[i] + lengths[i] - 1, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The tokens' strings joined by one space; these files name no decoder, and then the library does the same."""
    return " ".join(map(v.tokens.__getitem__, ids))


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each row's whole text. path: the vocabulary's file, read here; workers get it as a broadcast of its fixed size."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for batch in parts(whole):
                ids, starts = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """The table with the text of its column ids as column decoded."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("string")
    def decoded(ids):
        v = shared.value
        return ids.map(lambda x: decode(v, x.tolist()))

    return encoded.withColumn("decoded", decoded("ids"))


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of each row's whole text, in one pass of the workers."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = Encoder(v)
        for whole in batches:
            for batch in parts(whole):
                ids, starts = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                plain, at = ids.tolist(), starts.tolist()
                back = [decode(v, plain[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and decoded text."""
    return bpe_round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
