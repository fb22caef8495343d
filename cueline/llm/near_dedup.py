"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Each text gets its set of distinct shingles (64-bit hashes), a fingerprint of the set, and a SuperMinHash signature: every
   element draws a random permutation step by step (rank plus a fraction), and position p keeps the least value drawn for it. Later
   steps only give larger values, so a text is finished as soon as its largest kept value is below the next step.
2. Texts with equal sets are one class; its smallest id stands for it. Copies meet in counts, not in lists.
3. The signature is cut into bands. Texts that agree on a band meet; in each bucket a text is first paired with the first and with the
   one before it in the order of ids, so a bucket of any size gives two pairs a text. Similar texts agree on many bands, and each
   brings other partners. Pairs whose signatures agree too little for the threshold are left out.
4. Pairs are verified on the full sets. First each text's pair with its smallest likely partner; after grouping these, all the pairs
   whose ends are still in different groups. Pairs within a group need no verdict: it would change nothing.
5. Buckets of four and more whose members are still in different groups, such as those that a common passage fills, are finished
   exactly. Their texts' shingles are put in one order, rare ones first. Two texts with the threshold's overlap share their first
   common shingle early in both, so a text is listed only under its early shingles, by classes of size: the smaller one of a pair
   under as many as an equal partner leaves room for, the larger one under as many as the class does. In these lists texts again meet
   the first and the one before; then all pairs of a list whose ends are still in different groups meet, in blocks.
6. Groups come from union-find within tasks, then rounds in which every node moves to the smallest one around it.

What passes from step to step lies in the shared folder. At the threshold 0.75, 32 bands of 4 miss a pair with a
chance of (1 - 0.75^4)^32 = 5e-6, and the limit on signatures is five standard deviations below it.

Defined cases: null text counts as empty; a text without words has no shingles and links with nothing; rows without an id stand alone
and stay; rows that share an id share its group; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.shared import SALTS, U64, WordHash, forget, looked_up, mixed, ngram_hashes, parts, prepare, stored

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
SHINGLE = 5
#: Class representatives for which a bucket is taken as one; of each so many more, every bucket is dealt to one more task.
HEADS_A_SALT = 2_000_000
#: A side of a join of up to so many ids is broadcast; beyond that Spark shuffles both sides.
BROADCAST_IDS = 500_000
#: So many links (16 MB) are grouped by one task.
FEW_LINKS = 1_000_000
#: Slots in which shingles of unfinished buckets are counted; any order of shingles is right, a good one has rare ones first.
SLOTS = 1 << 22
#: Texts of a list in one block; each block of smaller texts meets each of larger ones.
BLOCK = 1024
#: The least size of each class; classes are 5 % wide.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, -(-EDGES[-1] * 21 // 20)))


def shingle_set(text: bytes, hashes: WordHash, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words than `width` the whole sequence is one shingle."""
    words = hashes.of(text.lower().split())
    if 0 < len(words) < width:
        return mixed(ngram_hashes(words, len(words)) + U64(len(words)))
    return np.unique(ngram_hashes(words, width))


def draws(elements: np.ndarray, step: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each element draws at a step: the place to swap with, from step on, and the fraction of its value."""
    with np.errstate(over="ignore"):
        x = mixed(elements + U64(0x9E3779B97F4A7C15) * U64(step + 1))
    place = step + ((x & U64(0xFFFFFFFF)) * U64(size - step) >> U64(32)).astype(np.int64)
    return place, (x >> U64(32)).astype(np.float64) / 4294967296.0


def super_minhash(sets: list[np.ndarray], size: int = SIZE, held: int = 100_000) -> np.ndarray:
    """Signatures (rows of values) of non-empty sets. held: elements that have a permutation in memory at once."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    values = np.full((len(sets), size), np.inf)
    place, fraction = draws(elements, 0, size)
    np.minimum.at(values.reshape(-1), owner * size + place, fraction)
    open_ = values.max(1) > 1
    left = np.flatnonzero(open_)
    begins = np.cumsum(counts) - counts
    while len(left):
        upto = max(1, int(np.searchsorted(np.cumsum(counts[left]), held, side="right")))
        some, left = left[:upto], left[upto:]
        at = np.concatenate([np.arange(begins[k], begins[k] + counts[k]) for k in some])
        e, o = elements[at], owner[at]
        rank = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(e), 1))
        row = np.arange(len(e))
        rank[row, place[at]] = 0
        for step in range(1, size):
            k, r = draws(e, step, size)
            to = rank[row, k].astype(np.int64)
            rank[row, k] = rank[:, step]
            np.minimum.at(values.reshape(-1), o * size + to, r + step)
            going = (values.max(1) > step + 1)[o]
            if not going.any():
                break
            if going.sum() < 0.7 * len(e):
                e, o, rank = e[going], o[going], rank[going]
                row = np.arange(len(e))
    return values


def bands_of(values: np.ndarray) -> np.ndarray:
    """A hash of each band, different for different bands."""
    bits = values.view(U64).reshape(len(values), BANDS, ROWS)
    with np.errstate(over="ignore"):
        total = np.zeros(bits.shape[:2], U64) + mixed(np.arange(1, BANDS + 1, dtype=U64))[None]
        for k in range(ROWS):
            total = mixed(total * U64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return total


SIGNED = "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>, signature binary"


def sign(docs: DataFrame) -> DataFrame:
    """Number of shingles, fingerprint of the set, hashes of the bands and 16 bits of each signature value."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHash()
        for batch in (x for whole in batches for x in parts(whole)):
            sets = [shingle_set(x or b"", hashes) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            full = np.flatnonzero([len(s) > 0 for s in sets])
            bands, marks = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SIZE), np.uint16)
            if len(full):
                values = super_minhash([sets[k] for k in full])
                bands[full] = bands_of(values).view(np.int64)
                marks[full] = (mixed(values.view(U64)) & U64(0xFFFF)).astype(np.uint16)
            prints = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists, pa.array([m.tobytes() for m in marks], pa.binary())], names=[x.split()[0] for x in SIGNED.split(", ")])

    return _given(docs).mapInArrow(run, SIGNED)


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _met(rows: DataFrame, *bucket: str, salts: int = 1) -> DataFrame:
    """Pairs a < b: each doc_id with the first one of its bucket and the one before it, two pairs a row at most.

    salts: into how many parts a bucket is dealt by doc_id; first and neighbour are then those of the part, and the firsts of the parts meet
    in the same way.
    """

    def pairs(part: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("doc_id")
        first, before = F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lag("doc_id").over(w)
        met = part.select("doc_id", first.alias("first"), before.alias("before")).where("before IS NOT NULL")
        return met.select(F.explode(F.array_distinct(F.array("first", "before"))).alias("a"), F.col("doc_id").alias("b")).where("a < b")

    if salts == 1:
        return pairs(rows, *bucket).distinct()
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(salts)).cast("int"))
    firsts = dealt.groupBy(*bucket, "part").agg(F.min("doc_id").alias("doc_id"))
    return pairs(dealt, *bucket, "part").union(pairs(firsts, *bucket)).distinct()


def candidate_pairs(signed: DataFrame, least: float, salts: int = 1) -> DataFrame:
    """Pairs a < b of class representatives that share a band and whose signatures agree on a share of `least` or more, with that share.

    signed: one row per class. A bucket gives two pairs a text, whatever its size; `finished` does the rest.
    """
    return likely_pairs(_met(signed.select("doc_id", F.explode("bands").alias("band")), "band", salts=salts), signed, least)


def likely_pairs(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree on a share of `least` or more, with that share."""
    left = signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("mark_a"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("mark_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIZE) for k in (2, 3))
            share = (x == y).mean(1)
            keep = share >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(share[keep])], names=["a", "b", "share"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "mark_a", "mark_b").mapInArrow(run, "a long, b long, share double").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union; sets: doc_id and the sorted hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                small, large = (p, q) if len(p) < len(q) else (q, p)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the documents with these ids (column doc_id), as sorted hashes in binary."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in (x for whole in batches for x in parts(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x or b"", hashes).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "hashes"])

    return _given(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes binary")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: each node linked to the smallest of its group."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(a), top(b)
            if p != q:
                up[max(p, q)] = min(p, q)
    nodes = [x for x in up if top(x) != x]
    if nodes:
        yield pa.RecordBatch.from_pydict({"a": pa.array([top(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """doc_id and component_id (the smallest id reachable) of every node of the links a, b.

    Per round each node moves to the smallest node around it, and on to where that one moves; links move along, and those within one node
    go. The nodes of every round are fewer by at least the largest of each group, and by far more where nodes have common neighbours.
    The smallest node of a large group, around which very many stand, is looked up in parts. As soon as `few` links or less are left, one task
    finishes them; until then each step is stored, so plans stay small.
    """
    edges, labels = stored(links.select("a", "b").mapInArrow(_forest, "a long, b long"), "links"), None
    while edges.count() > few:
        if labels is None:
            labels = stored(edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct().withColumn("component_id", F.col("doc_id")), "labels")
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        near = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("to"))
        near = stored(near, "moves")
        moves = stored(looked_up(near, "to", "v", near.toDF("to", "further"), "left").select("v", F.coalesce("further", "to").alias("to")), "moves")
        half = stored(looked_up(edges, "a", "b", moves.toDF("a", "p")), "links")
        moved = looked_up(half, "b", "a", moves.toDF("b", "q"))
        new_edges = stored(moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct().mapInArrow(_forest, "a long, b long"), "links")
        new_labels = _moved(labels, moves)
        forget(edges, labels, near, moves, half)
        edges, labels = new_edges, new_labels
    stars = stored(edges.repartition(1).mapInArrow(_forest, "a long, b long"), "stars")
    if labels is None:
        done = stored(stars.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id")).union(stars.select("a", "a").distinct()), "labels")
    else:
        done = _moved(labels, stars.select(F.col("b").alias("v"), F.col("a").alias("to")))
        forget(labels)
    forget(edges, stars)
    return done


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """The labels after their components have moved."""
    moved = looked_up(labels.withColumnRenamed("component_id", "v"), "v", "doc_id", moves, "left")
    return stored(moved.select("doc_id", F.coalesce("to", "v").alias("component_id")), "labels")


def _cross(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups."""
    joined = pairs.join(labels.toDF("a", "p"), "a", "left").join(labels.toDF("b", "q"), "b", "left")
    return joined.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select(*pairs.columns)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the group of their doc_id."""
    return rows.join(labels, "doc_id", "left").withColumn("label", F.coalesce("component_id", "doc_id")).drop("component_id")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def unfinished(heads: DataFrame, labels: DataFrame, salts: int = 1) -> DataFrame:
    """The ids in buckets whose members are in different groups and have not all met; of up to three (two in parts), first and neighbour are all."""
    rows = _labelled(heads.select("doc_id", "bands"), labels).select("doc_id", "label", F.explode("bands").alias("band"))
    open_ = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where(f"n > {3 if salts == 1 else 2} AND low < high")
    return rows.join(_small(stored(open_.select("band"), "buckets")), "band", "left_semi").select("doc_id").distinct()


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            np.add.at(total, (np.frombuffer(b"".join(batch.column(1).to_pylist()), U64) % U64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(total[at[k : k + (1 << 16)]])], names=["slot", "n"])

    found = sets.select("doc_id", "hashes").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(SLOTS, np.int32)
    counts[found.column(0).to_numpy()] = np.minimum(found.column(1).to_numpy(), 2**31 - 1)
    return counts


LISTED = "token long, size_class int, larger boolean, doc_id long, n long, at long"


def early_shingles(hashes: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Class, role, shingles and their places: where a set is listed. Shingles alone in their slot have no partner and are left out."""
    n = len(hashes)
    weight = counts[(hashes % U64(len(counts))).astype(np.int64)]
    order = np.lexsort((hashes, weight))
    hashes, shared = hashes[order], weight[order] > 1
    least = -(-percent * n // 100)
    roles = [(bisect_right(EDGES, n) - 1, False, n)]
    roles += [(c, True, max(EDGES[c], least)) for c in range(bisect_right(EDGES, least) - 1, bisect_right(EDGES, n))]
    for c, larger, other in roles:
        at = np.flatnonzero(shared[: n + 1 - -(-percent * (n + other) // (100 + percent))])
        if len(at):
            yield c, larger, hashes[at].view(np.int64), at


def listed(sets: DataFrame, percent: int) -> DataFrame:
    """One row for each shingle, class and role under which a set can meet a partner."""
    shared = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(early_shingles(np.frombuffer(x, U64), counts, percent))
                if found:
                    m = [len(f[2]) for f in found]
                    columns = [np.concatenate([f[2] for f in found]), np.repeat([f[0] for f in found], m).astype(np.int32), np.repeat([f[1] for f in found], m)]
                    columns += [np.full(sum(m), doc_id, np.int64), np.full(sum(m), len(x) // 8, np.int64), np.concatenate([f[3] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in LISTED.split(", ")])

    return sets.where("length(hashes) > 0").select("doc_id", "hashes").mapInArrow(run, LISTED)


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows of the lists that hold both roles and different groups, with the blocks of either role."""
    rows = _labelled(lists, labels)
    open_ = rows.groupBy("token", "size_class").agg(F.count_if(~F.col("larger")).alias("n_small"), F.count_if("larger").alias("n_large"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = open_.where("n_small > 0 AND n_large > 0 AND low < high").select("token", "size_class", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("n_small", "n_large")])
    return rows.join(_small(stored(open_, "open")), ["token", "size_class"])


def _all_met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of each list, a smaller and a larger one of different groups, whose places leave room for the threshold."""
    keys = ["token", "size_class", "i", "j"]
    spread = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    small = rows.where("NOT larger").withColumn("i", spread("n_small")).withColumn("j", every("n_large")).select(*keys, *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "n", "at", "label")])
    large = rows.where("larger").withColumn("j", spread("n_large")).withColumn("i", every("n_small")).select(*keys, *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "n", "at", "label")])
    # at the first common shingle of two sets no more than what follows it in both can be common
    room = f"{100 + percent} * least(n_x - at_x, n_y - at_y) >= {percent} * (n_x + n_y)"
    met = small.join(large, keys).where(f"label_x != label_y AND n_x <= n_y AND {room}")
    return met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def finished(docs: DataFrame, heads: DataFrame, links: DataFrame, percent: int, least: float, salts: int = 1) -> DataFrame:
    """Groups of the links and of all links that the buckets' other pairs bring."""
    labels = components(links)
    ids = stored(unfinished(heads, labels, salts), "unfinished")
    if ids.isEmpty():
        return labels
    sets = stored(shingle_sets(docs, ids), "sets")
    lists = stored(listed(sets, percent), "lists")
    for meet in (lambda rows: _met(rows.select("token", "size_class", "doc_id").distinct(), "token", "size_class", salts=salts), lambda rows: _all_met(rows, percent)):
        pairs = _cross(likely_pairs(meet(_open_lists(lists, labels)), heads, least), labels)
        more = stored(verified(pairs, sets, percent), "verified")
        if not more.isEmpty():
            links = links.union(more)
            forget(labels)
            labels = components(links)
    forget(ids, sets, lists)
    return labels


def near_duplicates(docs: DataFrame, percent: int = 75, heads_a_salt: int = HEADS_A_SALT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. `docs` has doc_id and text.

    heads_a_salt: how many class representatives there are for each task over which a bucket is dealt; it changes the plan and not the groups.
    """
    signed = stored(sign(docs), "signed")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # a class that very many rows share is counted in SALTS parts, and each part looks up its own row
    salted = named.select("doc_id", "set_high", "set_low", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    part = salted.groupBy("set_high", "set_low", "salt").agg(F.min("doc_id").alias("low"))
    classes = stored(part.groupBy("set_high", "set_low").agg(F.min("low").alias("class_id")), "classes")
    heads = named.join(classes.select(F.col("class_id").alias("doc_id"), "set_high", "set_low"), ["doc_id", "set_high", "set_low"]).select("doc_id", "bands", "signature")
    heads = stored(heads, "heads")
    likely = percent / 100
    salts = 1 + heads.count() // heads_a_salt
    pairs = stored(candidate_pairs(heads, likely - 0.2, salts), "pairs")
    sets = stored(shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), "sets")
    score = F.when(F.col("share") >= likely, 2.0).otherwise(F.col("share"))
    first = pairs.groupBy("b").agg(F.max(F.struct(score.alias("s"), (-F.col("a")).alias("n"))).alias("best")).select((-F.col("best.n")).alias("a"), "b")
    links = stored(verified(first, sets, percent), "verified")
    rest = _cross(pairs.join(first, ["a", "b"], "left_anti"), components(links))
    links = links.union(stored(verified(rest, sets, percent), "verified"))
    forget(sets, pairs)
    groups = finished(docs, heads, links, percent, likely - 0.2, salts)
    forget(heads)
    final = classes.join(groups, F.col("class_id") == F.col("doc_id"), "left").select("set_high", "set_low", F.coalesce("component_id", "class_id").alias("component_id"))
    lookup = part.join(final, ["set_high", "set_low"]).select("set_high", "set_low", "salt", "component_id")
    linked = salted.join(lookup, ["set_high", "set_low", "salt"]).select("doc_id", "component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called."""
    dropped = stored(near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return rows.join(dropped, "doc_id", "left_anti").select("document.*")
