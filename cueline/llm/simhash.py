"""SimHash near-duplicates: 64-bit fingerprints of word shingles, and exact pairs of near ones by vantage-point trees.

1. A text's shingles (three words, repeats included) are hashed; a bit of its fingerprint is 1 if over half of the hashes have it.
2. Texts of one fingerprint are one class, named by it. From here on only distinct fingerprints count.
3. A bounded sample gives the upper levels of a vantage-point tree: a node is a fingerprint and a radius, inside are those within the radius,
   outside the others. Its leaves are shards, a task each. Every fingerprint lives in one of them. One that lives outside a node but at most `bits`
   beyond its radius also visits the inside, and a visitor goes on to each side that can hold something `bits` or less away from it: the
   triangle inequality excludes the rest. So of two near fingerprints one visits the home of the other.
4. In a shard the same goes on with a tree over all that lives there, down to leaves whose members are compared with each other and with
   the visitors. Pairs are joined at once by union-find; a task gives one link for each fingerprint at most, whatever the number of pairs.
5. Links of all shards are grouped, and each class gets the smallest id of its group.

The sample (SAMPLE_A_SHARD fingerprints a shard, of all at most an eighth) and the tree of it are what the driver holds: 512 bytes a shard.
The search is exact with any tree; the sample only decides how even the shards are.

Defined cases: null text counts as empty and has fingerprint zero, as has a text without words, linked like any other; rows that share an id or a
fingerprint share a group; rows without id take part, and have the smallest id of their group, null if nobody in it has one; an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.near_dedup import components
from cueline.llm.shared import U64, forget, given, looked_up, parts, prepare, stored, stretches, texts

SHINGLE, SEED = 3, 42
#: Shards, at least; more of them from HOMES fingerprints a shard on.
SHARDS, HOMES = 64, 1 << 17
SAMPLE_A_SHARD = 64
#: Members of a leaf, which are compared pair by pair, and rows compared at once.
LEAF, BLOCK = 128, 1024


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each window of `width` words, joined by spaces."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), U64, n)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a whole text, read a stretch at a time."""
    total, n, words = np.zeros(64, np.int64), 0, []
    for words in stretches(text.lower(), width - 1):
        if len(words) >= width:
            hashes = _hashes(words, width)
            total, n = total + _set_bits(hashes), n + len(hashes)
    if not n and words:
        total, n = _set_bits(_hashes(words, len(words))), 1
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole)):
            prints = np.array([fingerprint(x) for x in texts(batch)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    return given(docs).mapInArrow(run, "doc_id long, fingerprint long")


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def vantage(members: np.ndarray, bits: int, tries: int = 8) -> tuple[np.uint64, int]:
    """A member and a radius with few others near the boundary, and two fifths at least on either side where that can be had."""
    best = None
    for point in members[np.linspace(0, len(members) - 1, min(tries, len(members))).astype(int)]:
        within = np.cumsum(np.bincount(distance(members, point), minlength=65 + bits)) / len(members)
        for r in range(64):
            inside, band = within[r], within[r + bits] - within[max(0, r - bits)]
            key = (max(0.0, 0.4 - min(inside, 1 - inside)), band)
            if best is None or key < best[0]:
                best = (key, point, r)
    return best[1], best[2]


@dataclass(frozen=True)
class Tree:
    """The upper levels, in the order of a heap: the children of node k are 2k + 1 (inside) and 2k + 2."""

    points: np.ndarray
    radii: np.ndarray
    levels: int

    @property
    def shards(self) -> int:
        return 1 << self.levels


def upper_tree(sample: np.ndarray, levels: int, bits: int) -> Tree:
    """A tree whose leaves have about equal shares of the sample; a node without members sends everything inside."""
    n = (1 << levels) - 1
    points, radii, members = np.zeros(n, U64), np.full(n, 64, np.int64), {0: sample}
    for k in range(n):
        own = members.pop(k)
        if len(own) > 1:
            points[k], radii[k] = vantage(own, bits)
        inside = distance(own, points[k]) <= radii[k]
        members[2 * k + 1], members[2 * k + 2] = own[inside], own[~inside]
    return Tree(points, radii, levels)


def routes(tree: Tree, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards, fingerprints, and whether each is at home there."""
    x, at, home = prints, np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    for _ in range(tree.levels):
        d, r = distance(x, tree.points[at]), tree.radii[at]
        inside, outside = np.where(home, d <= r, d <= r + bits), np.where(home, d > r, d + bits > r)
        visits = home & (d > r) & (d <= r + bits)
        pick = [inside, outside, visits]
        side = np.repeat([1, 2, 1], [int(p.sum()) for p in pick])
        x, at, home = np.concatenate([x[p] for p in pick]), 2 * np.concatenate([at[p] for p in pick]) + side, np.concatenate([home[inside], home[outside], np.zeros(int(visits.sum()), bool)])
    return at - (tree.shards - 1), x, home


class Groups:
    """Union-find over numbers, many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def tops(self, x: np.ndarray) -> np.ndarray:
        while (y := self.up[x]).size and (y != x).any():
            x = y
        return x

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            x, y = self.tops(x), self.tops(y)
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def join_near(prints: np.ndarray, n_home: int, bits: int, leaf: int = LEAF) -> Groups:
    """Groups of fingerprints by the pairs within `bits` of which one at least is at home; the first n_home are."""
    groups = Groups(len(prints))

    def compare(home: np.ndarray, other: np.ndarray) -> None:
        for a in range(0, len(home), BLOCK):
            for b in range(0, len(other), BLOCK):
                i, j = home[a : a + BLOCK], other[b : b + BLOCK]
                near = np.nonzero(np.bitwise_count(prints[i][:, None] ^ prints[j][None]) <= bits)
                groups.join(i[near[0]], j[near[1]])

    left = [(np.arange(n_home), np.arange(n_home, len(prints)))]
    while left:
        home, visitors = left.pop()
        if len(home) > leaf:
            point, r = vantage(prints[home], bits)
            d, v = distance(prints[home], point), distance(prints[visitors], point)
            inside = d <= r
            if 0 < inside.sum() < len(home):
                left.append((home[inside], np.concatenate([visitors[v <= r + bits], home[~inside & (d <= r + bits)]])))
                left.append((home[~inside], visitors[v + bits > r]))
                continue
        compare(home, home)
        compare(home, visitors)
    return groups


def near_links(prints: DataFrame, bits: int, homes: int = HOMES, shards: int = SHARDS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fingerprint, stored) that join all that are `bits` or less apart."""
    spark = prints.sparkSession
    n = prints.count()
    levels = max(shards, -(-n // homes)).bit_length() - 1
    one_in = max(8, n // (SAMPLE_A_SHARD << levels))
    sample = prints.where(F.pmod(F.xxhash64(F.lit(11), "fingerprint"), F.lit(one_in)) == 0).toArrow().column(0).to_numpy().astype(np.int64).view(U64)
    shared = spark.sparkContext.broadcast(upper_tree(np.sort(sample), levels, bits))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, x, home = routes(shared.value, batch.column(0).to_numpy().view(U64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(home)], names=["shard", "fingerprint", "home"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column(1).to_numpy().view(U64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if own:
            x, home = (np.concatenate(c) for c in zip(*own, strict=True))
            x = np.concatenate([x[home], x[~home]])
            tops = join_near(x, int(home.sum()), bits).tops(np.arange(len(x)))
            at = np.flatnonzero(tops != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[tops[at]].view(np.int64)), pa.array(x[at].view(np.int64))], names=["a", "b"])

    routed = prints.mapInArrow(route, "shard int, fingerprint long, home boolean").repartitionById(1 << levels, F.col("shard"))
    return routed.mapInArrow(search, "a long, b long")


def simhash_duplicates(docs: DataFrame, bits: int = 2, homes: int = HOMES) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id. `docs` has doc_id and text.

    bits: how many may differ. homes: fingerprints a shard; it changes the plan and not the groups.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "classes")
    labels = components(near_links(classes.select("fingerprint"), bits, homes)).toDF("fingerprint", "label")
    grouped = classes.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    grouped = stored(grouped, "grouped")
    lows = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    resolved = looked_up(grouped.select("fingerprint", "label"), "label", "fingerprint", lows).select("fingerprint", "component_id")
    resolved = stored(resolved, "resolved")
    forget(labels, classes, grouped)
    return looked_up(marked, "fingerprint", "doc_id", resolved).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
