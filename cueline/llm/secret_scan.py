"""Secret scans by a linear-chain conditional random field over tokens, on top of three base patterns.

Tokens are runs of letters, digits and `+ / _ . -`, and every other visible character by itself. Each gets a label: begin,
inside or outside of a secret. A label's score is the sum of weights for the token's shape (length, digits, case, hex, changes
between letters and digits), its own identity if it is short, the two tokens before and the one after it, the shape before it, and
features of the whole file; labels of neighbours add a transition weight. Viterbi finds the best labels.

Decoding is exact and yet touches few tokens: where "outside" leads by more than any two transitions can make up, a token
is outside in the best labelling, and the chain can be cut there. Only the runs between such tokens are decoded, all runs
of a batch in step.

Training: the field has no labels of its own, so the base patterns label windows of a bounded sample (`sample_rows`
documents, chosen by a hash of their id) and it learns what stands in and around them; full-batch conditional likelihood, in numpy,
the same for the same documents. Scanning covers every text as a whole.

Defined cases: null text counts as empty; a corpus in which no base pattern occurs gives no field and the base spans alone; offsets are in code
points; base spans are always reported and a span of the field that overlaps one is not; repeated rows each get their row;
other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.shared import U64, mixed, parts, prepare

#: The base patterns, fixed values of the contract: pattern, group whose length counts, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = (*BASE, "crf")
OUT, BEGIN, INSIDE = 0, 1, 2
SHAPES, WORDS, FILES = 2048, 4096, 64
WINDOW = 48

_run = np.zeros(256, bool)
_run[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")] = True
_run[128:] = True
_blank = np.zeros(256, bool)
_blank[list(b" \t\n\r\x0b\x0c")] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_hex = _digit.copy()
_hex[97:103] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start and then kind."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        if (kind == "assign" and ":" not in text and "=" not in text) or (kind == "access" and "AKIA" not in text):
            continue
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Tokens:
    """Tokens of several texts that lie end to end: byte offsets, the text each is in, and feature numbers."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    file: np.ndarray
    long_hex: np.ndarray  # per text: whether it has 24 hex digits in a row


def tokens(texts: list[bytes]) -> Tokens:
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(16), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    n = len(data) - 16
    run, visible = _run[data[:n]], ~_blank[data[:n]]
    before = np.r_[False, run[:-1]]
    start = np.flatnonzero(visible & ~(run & before))
    after = np.r_[run[1:], False]
    end = np.flatnonzero(visible & ~(run & after)) + 1
    text = np.searchsorted(begins, start, side="right") - 1

    def between(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag, dtype=np.int32)]
        return total[end] - total[start]

    digit, letter = _digit[data[:n]], (_upper | _lower)[data[:n]]
    size = end - start
    digits, uppers, lowers, hexes = between(digit), between(_upper[data[:n]]), between(_lower[data[:n]]), between(_hex[data[:n]])
    changes = between(np.r_[False, (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])])
    size_class = np.searchsorted([2, 4, 6, 10, 16, 24, 40], size, side="right")
    digit_class = np.where(digits == 0, 0, 1 + np.minimum(2, 3 * digits // np.maximum(size, 1)))
    case_class = (uppers > 0) * 1 + (lowers > 0) * 2
    change_class = np.searchsorted([1, 3, 6], changes, side="right")
    plain = (hexes == size) * 1 + (digits + uppers + lowers == size) * 2
    shape = (((size_class * 4 + digit_class) * 4 + case_class) * 4 + change_class) * 4 + plain
    folded = _fold[data]
    eight = np.ndarray((n,), np.uint64, folded.tobytes(), strides=(1,))  # the eight bytes from each place on
    keep = U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * U64(8 - np.minimum(size, 8)).astype(U64))
    tail = eight[np.maximum(end - 8, start)] & keep
    word = (mixed((eight[start] & keep) ^ (tail * U64(0x9E3779B97F4A7C15)) ^ size.astype(U64)) % U64(WORDS)).astype(np.int64)
    word[size > 20] = 0  # long tokens have a shape, not an identity
    many = lambda flag: np.add.reduceat(flag.astype(np.int64), begins) if len(texts) else np.empty(0, np.int64)
    size_file = np.searchsorted([200, 2000, 20000], lengths, side="right")
    digit_file = np.searchsorted([1, 20, 50], 1000 * many(digit) // np.maximum(lengths, 1), side="right")
    sign_file = np.searchsorted([1, 20, 60], 1000 * many(visible & ~run) // np.maximum(lengths, 1), side="right")
    file = ((size_file * 4 + digit_file) * 4 + sign_file)[text]
    hexed = _hex[data[:n]]
    edges = np.diff(np.r_[0, hexed.astype(np.int8), 0])
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_hex = np.zeros(len(texts), bool)
    long_hex[np.searchsorted(begins, first[last - first >= 24], side="right") - 1] = True
    return Tokens(start - begins[text], end - begins[text], text, shape, word, file, long_hex)


#: Blocks of the weight table: shape, own word, previous word, the one before it, next word, previous shape, file. The row after them keeps weight 0.
BLOCKS = (SHAPES, WORDS, WORDS, WORDS, WORDS, SHAPES, FILES)
NOTHING = sum(BLOCKS)
#: What a feature of each block counts: identities less than shapes, which also hold for words that training did not see.
SCALE = np.r_[np.repeat((1.0, 0.5, 0.5, 0.5, 0.5, 1.0, 0.5), BLOCKS), 0.0][:, None]


def features(t: Tokens) -> np.ndarray:
    """Rows of the weight table for each token; neighbours are those of the same text."""

    def shifted(values: np.ndarray, by: int, empty: int) -> np.ndarray:
        out = np.full(len(values), empty, np.int64)
        if by > 0:
            same = t.text[by:] == t.text[:-by]
            out[by:][same] = values[:-by][same]
        else:
            same = t.text[-by:] == t.text[:by]
            out[:by][same] = values[-by:][same]
        return out

    columns = [t.shape, t.word, shifted(t.word, 1, 0), shifted(t.word, 2, 0), shifted(t.word, -1, 0), shifted(t.shape, 1, 0), t.file]
    return np.stack([c + o for c, o in zip(columns, np.cumsum((0, *BLOCKS[:-1])), strict=True)], axis=1)


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from label, to label

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3), np.float32)
        for k in range(rows.shape[1]):
            out += self.weights[rows[:, k]]
        return out


def viterbi_in_step(field: Field, scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of many runs at once; before and after each run stands an outside token."""
    labels = np.zeros(len(scores), np.int8)
    if not len(begins):
        return labels
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    steps = int(lengths[0])
    back: list[np.ndarray] = []
    best = scores[begins] + field.moves[OUT]
    last = np.zeros(len(begins), np.int8)
    for step in range(steps):
        alive = int(np.searchsorted(-lengths, -step, side="left"))  # runs longer than step
        if step:
            paths = best[:alive, :, None] + field.moves[None]
            back.append(paths.argmax(1).astype(np.int8))
            best[:alive] = paths.max(1) + scores[begins[:alive] + step]
        ending = lengths[:alive] == step + 1
        last[:alive][ending] = (best[:alive] + field.moves[:, OUT])[ending].argmax(1)
    current = last.copy()
    for step in range(steps - 1, -1, -1):
        alive = int(np.searchsorted(-lengths, -step, side="left"))
        if step < steps - 1:
            longer = int(np.searchsorted(-lengths, -(step + 1), side="left"))
            current[:longer] = back[step][np.arange(longer), current[:longer]]
        labels[begins[:alive] + step] = current[:alive]
    return labels


def best_labels(field: Field, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Viterbi labels of all texts; tokens that are outside for certain cut the chains."""
    room = 2 * (field.moves.max() - field.moves.min())
    open_ = scores[:, OUT] - scores[:, 1:].max(1) <= room
    labels = np.zeros(len(scores), np.int8)
    at = np.flatnonzero(open_)
    if not len(at):
        return labels
    cut = np.r_[True, (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])]
    first = np.flatnonzero(cut)
    return viterbi_in_step(field, scores, at[first], np.diff(np.r_[first, len(at)]))


def fit_field(rows: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum conditional likelihood. rows: windows x tokens x features, -1 where a window is shorter; labels alike."""
    n, steps, k = rows.shape
    there = labels >= 0
    weights, moves = np.zeros((NOTHING + 1, 3)), np.zeros((3, 3))
    gold = np.zeros((n, steps, 3))
    gold[there, labels[there]] = 1
    pairs = there[:, 1:] & there[:, :-1]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (labels[:, :-1][pairs], labels[:, 1:][pairs]), 1)
    flat = rows[there]
    used = np.setdiff1d(flat, [NOTHING])
    squares, move_squares = np.full((NOTHING + 1, 3), 1e-8), np.full((3, 3), 1e-8)
    for _ in range(rounds):
        e = np.where(there[..., None], (weights * SCALE)[np.where(there[..., None], rows, 0)].sum(2), 0.0)
        a, b = np.zeros((n, steps, 3)), np.zeros((n, steps, 3))
        a[:, 0] = e[:, 0]
        for s in range(1, steps):
            a[:, s] = np.where(there[:, s, None], e[:, s] + np.logaddexp.reduce(a[:, s - 1, :, None] + moves[None], axis=1), a[:, s - 1])
        for s in range(steps - 2, -1, -1):
            b[:, s] = np.where(there[:, s + 1, None], np.logaddexp.reduce(moves[None] + (e[:, s + 1] + b[:, s + 1])[:, None, :], axis=2), b[:, s + 1])
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        p = np.exp(a + b - z[:, None, None]) * there[..., None]
        wanted = np.zeros((3, 3))
        for s in range(1, steps):
            wanted += (np.exp(a[:, s - 1, :, None] + moves[None] + (e[:, s] + b[:, s])[:, None, :] - z[:, None, None]) * pairs[:, s - 1, None, None]).sum(0)
        gradient = np.zeros((NOTHING + 1, 3))
        difference = (gold - p)[there]
        for c in range(k):
            for y in range(3):
                gradient[:, y] += np.bincount(flat[:, c], difference[:, y], minlength=len(gradient))
        gradient -= decay * len(flat) * weights / 1000
        squares += gradient**2
        move_gradient = gold_moves - wanted
        move_squares += move_gradient**2
        weights[used] += (rate * gradient / np.sqrt(squares))[used]
        moves += rate * move_gradient / np.sqrt(move_squares)
    return Field((weights * SCALE).astype(np.float32), moves.astype(np.float32))


def weak_labels(text: str, raw: bytes, t: Tokens) -> np.ndarray:
    """Labels of one text's tokens from its base spans; of an assignment only the value is the secret."""
    labels = np.zeros(len(t.start), np.int64)
    spans = []
    for kind, (pattern, group, least) in BASE.items():
        spans += [m.span(2 if kind == "assign" else 0) for m in pattern.finditer(text) if len(m[group]) >= least]
    for a, b in spans:
        if not text.isascii():
            a, b = len(text[:a].encode()), len(text[:b].encode())
        inside = np.flatnonzero((t.start < b) & (t.end > a))
        labels[inside] = INSIDE
        labels[inside[:1]] = BEGIN
    return labels


def windows(texts: list[bytes], per_text: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of WINDOW tokens: around base spans of a text, and one anywhere in it; a hash of its bytes says which and where."""
    from xxhash import xxh3_64_intdigest

    rows, labels = [], []
    for raw in texts:
        t = tokens([raw])
        if not len(t.start):
            continue
        f, y = features(t), weak_labels(raw.decode(), raw, t)
        own = xxh3_64_intdigest(raw)
        hits = np.flatnonzero(y == BEGIN)
        drawn = mixed(U64(own) ^ (hits + 1).astype(U64))
        pick = np.argsort(drawn, kind="stable")[:per_text]
        back = (drawn[pick] // U64(WINDOW) % U64(WINDOW)).astype(np.int64)
        for at in {*(np.maximum(0, hits[pick] - back) // 8 * 8).tolist(), own % len(y)}:
            r, g = np.full((WINDOW, f.shape[1]), -1, np.int64), np.full(WINDOW, -1, np.int64)
            part = f[at : at + WINDOW]
            r[: len(part)], g[: len(part)] = part, y[at : at + WINDOW]
            rows.append(r)
            labels.append(g)
    if not rows:
        return np.empty((0, WINDOW, len(BLOCKS)), np.int64), np.empty((0, WINDOW), np.int64)
    return np.stack(rows), np.stack(labels)


def train_field(docs: DataFrame, sample_rows: int = 12_000, with_spans: int = 2_000, without: int = 1_000) -> Field | None:
    """A field from a sample of about sample_rows documents; None if no base span occurs in it.

    Windows with spans and windows without have a bound each, so that the field sees both kinds at every size; a hash chooses among more.
    """
    prepare(docs.sparkSession)
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            rows, labels = windows([(x or "").encode() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"hit": pa.array((labels > 0).any(1), pa.bool_()), "rows": pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary()), "labels": pa.array([x.astype(np.int8).tobytes() for x in labels], pa.binary())})

    found = sample.mapInArrow(run, "hit boolean, rows binary, labels binary")
    slices = 32  # of each kind by hash, so that no task has all windows of a kind; each slice has its share of the bound
    dealt = found.withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "rows"), F.lit(slices)))
    place = F.row_number().over(Window.partitionBy("hit", "slice").orderBy(F.xxhash64("rows"), "rows", "labels"))
    most = dealt.withColumn("place", place).where(F.col("place") <= -(-max(with_spans, without) // slices))  # a limit before the shuffle, too
    got = sorted(most.where(F.col("place") <= F.when(F.col("hit"), -(-with_spans // slices)).otherwise(-(-without // slices))).collect(), key=lambda x: (not x.hit, x.place, x.slice))
    if not got or not got[0].hit:
        return None
    rows = np.stack([np.frombuffer(x.rows, np.int32).reshape(WINDOW, len(BLOCKS)) for x in got]).astype(np.int64)
    half = rows[::2]  # every second window hides which words stand at a token and two before it, so that shapes must tell as well
    for column in (1, 3):
        half[..., column] = np.where(half[..., column] >= 0, NOTHING, -1)
    return fit_field(rows, np.stack([np.frombuffer(x.labels, np.int8) for x in got]).astype(np.int64))


def field_spans(field: Field, t: Tokens) -> list[list[tuple[int, int]]]:
    """Byte spans of the secrets that the field finds in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(t.long_hex))]
    labels = best_labels(field, field.emissions(features(t)), t.text)
    before = -2
    for at in np.flatnonzero(labels).tolist():
        k = int(t.text[at])
        if labels[at] == INSIDE and before == at - 1 and out[k]:
            out[k][-1] = (out[k][-1][0], int(t.end[at]))
        else:
            out[k].append((int(t.start[at]), int(t.end[at])))
        before = at
    return out


def scan(texts: list[str], field: Field | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text in code points: base ones, and the field's where they overlap none of those."""
    raw = [x.encode() for x in texts]
    t = tokens(raw)
    own = field_spans(field, t) if field else [[] for _ in texts]
    out = []
    for text, data, spans, long_hex in zip(texts, raw, own, t.long_hex, strict=True):
        base = base_spans(text) if long_hex or b":" in data or b"=" in data or b"AKIA" in data else []
        more = []
        for a, b in spans:
            if not text.isascii():
                a = len(data[:a].decode())
                b = a + len(data[len(text[:a].encode()) : b].decode())
            if all(b <= x or a >= y for x, y, _ in base):
                more.append((a, b, "crf"))
        out.append(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
    return out


def secret_spans(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and spans (array of start, end, kind) of each row's whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, 2 << 20)):
            found = scan([x or "" for x in batch.column(1).to_pylist()], shared.value)
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def find_secrets(docs: DataFrame, sample_rows: int = 12_000) -> DataFrame:
    """Train on a sample of the documents and scan all of them."""
    return secret_spans(docs, train_field(docs, sample_rows))


def span_digests(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(said(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
