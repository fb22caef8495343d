"""Divergence of sources within a language: which terms set a source apart, and how far any two sources are from each other.

1. Each task cuts a stretch of texts into terms at once, as arrays, and counts in how many of its documents a term of a language occurs. It adds the counts
   to a count-min sketch: `DEPTH` rows of `width` cells, a cell of each row for a term. The sketches of all tasks are summed in Spark. The least cell of
   a term is never below its number of documents, so a term with a cell below `min_docs` is impossible; only whether cells reach it, one bit each, goes
   to the tasks (DEPTH * MOST_CELLS / 8 bytes at most, 4 MB).
2. Each task counts again and sends a row for each language, source and term that is left, of some stretches together. The rows of a language's term meet in one
   partition, where they are summed exactly, the terms in too few documents that the sketch let pass go, and the rest is written once.
3. Pairs of sources are summed sparsely. A term that neither source has gives the same value for all such terms; one that only one of them has gives
   a value that depends on its count there alone, so terms of a source are met by the histogram of their counts; only terms of both sources are joined.
   The three parts are added up by pair as they are made.

The width follows the input's size, up to MOST_CELLS a row; beyond that (some billions of distinct terms) the sketch discards less and the shuffle grows, while
results stay the same. Sums are exact integers: values below 2^62 as longs, products of counts as decimals.

Defined cases: null text, lang and source count as ''; each row is a document, whatever its id; a group without kept terms has counts of 0; a language without
kept terms gives pairs of value 0; a language of one source gives no pairs; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.shared import SLICES, U64, estimated_bytes, large, mixed, partitions_for, parts, prepare, sliced, small_side, stored, summed, texts

#: Each byte of a text in a term, or a blank: letters in lower case, and all beyond ASCII.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DEPTH, LEAST_CELLS, MOST_CELLS = 4, 1 << 16, 1 << 23
#: Bytes of text that a task counts at once, and counts that it holds and adds up before it passes them on.
CHUNK, HELD = 8 << 20, 300_000
#: Groups of sources that a join deals over one task each way.
BLOCK = 2_000
UNIT = 1_000_000_000


def sketch_width(docs: DataFrame) -> int:
    """Cells in a row of the sketch: one for every 400 bytes or so."""
    return 1 << min(MOST_CELLS, max(LEAST_CELLS, min(estimated_bytes(docs), 1 << 40) // 400)).bit_length() - 1


def _hashes(terms: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, terms), U64, len(terms))


def _cells(hashes: np.ndarray, seeds: np.ndarray | np.uint64, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(hashes + seeds)
        return np.stack([(mixed(h + U64(0x9E3779B97F4A7C15) * U64(k + 1)) % U64(width)).astype(np.int64) + k * width for k in range(DEPTH)])


def cells(terms: list[bytes], lang: bytes, width: int) -> np.ndarray:
    """Cells of terms of a language, a row of the sketch each."""
    return _cells(_hashes(terms), _hashes([lang])[0], width)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that their texts have some `limit` bytes; a longer text is alone in its batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (x for whole in batches for x in parts(whole, limit)):
        more = _length(batch.column("text"))
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def _length(column: pa.Array) -> int:
    return pc.sum(pc.binary_length(column)).as_py() or 0


def _terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of some texts, in their order, and the row of each."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes().translate(BYTES) if at[-1] > at[0] else b"", np.uint8)
    at = at - at[0]
    inside = raw != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(raw))]  # a text ends before each and another begins there
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return terms.dictionary_encode(), np.repeat(np.arange(len(column)), np.diff(np.searchsorted(start, at)))


class Counts(NamedTuple):
    """Distinct terms; of each group and term its occurrences and the rows that have it, the term by its place in `terms`."""

    terms: pa.Array
    group: np.ndarray
    place: np.ndarray
    n: np.ndarray
    docs: np.ndarray


def _counted(column: pa.Array, group: np.ndarray) -> Counts:
    """group: of each row."""
    coded, row = _terms(column)
    place, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    own = np.sort(row * many + place)
    own = own[np.flatnonzero(np.diff(own, prepend=-1))]
    key, n = np.unique(group[row] * many + place, return_counts=True)
    _, docs = np.unique(group[own // many] * many + own % many, return_counts=True)
    return Counts(coded.dictionary, key // many, key % many, n, docs)


def _counted_long(text: bytes, group: int, limit: int) -> Counts:
    """As above, of one text, in pieces of some `limit` bytes that end where a term does."""
    text, begin, tables = text.translate(BYTES), 0, []
    while begin < len(text):
        end = text.find(b" ", begin + limit)
        end = len(text) if end < 0 else end
        c = _counted(pa.array([text[begin:end]], pa.large_binary()), np.zeros(1, np.int64))
        tables.append(pa.table({"term": c.terms.take(pa.array(c.place)), "n": c.n}))
        begin = end
    whole = pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("n", "sum")])
    one = np.ones(len(whole), np.int64)
    return Counts(whole["term"].combine_chunks(), one * group, np.arange(len(whole)), whole["n_sum"].to_numpy(), one)


def _counts(batches: Iterator[pa.RecordBatch], by: list[str], ids: dict[tuple[bytes, ...], int], limit: int) -> Iterator[Counts]:
    """Counts of texts, part by part. ids: gets a number for each group, which is a value of each column in `by`."""
    for batch in _chunks(batches, limit):
        group = np.fromiter((ids.setdefault(x, len(ids)) for x in zip(*(texts(batch, c) for c in by), strict=True)), np.int64, batch.num_rows)
        if batch.num_rows == 1 and _length(batch.column("text")) > limit:
            yield _counted_long(texts(batch)[0], int(group[0]), limit)
        else:
            yield _counted(batch.column("text"), group)


def _cells_of(counts: Counts, ids: dict[tuple[bytes, ...], int], width: int) -> np.ndarray:
    """Cells of the terms of the groups, whose first value is the language."""
    terms = counts.terms
    data, at = b"", [0]
    if len(terms):  # to_pylist() takes several times as long
        data, at = terms.buffers()[2].to_pybytes(), np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].tolist()
    return _cells(_hashes([data[x:y] for x, y in pairwise(at)])[counts.place], _hashes([g[0] for g in ids])[counts.group], width)


def possible_terms(docs: DataFrame, min_docs: int, width: int) -> np.ndarray:
    """Whether each cell of the merged sketch reaches min_docs, packed into bits. docs: text, lang."""
    limit = CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH * width, np.uint32)
        ids: dict[tuple[bytes, ...], int] = {}
        for counts in _counts(batches, ["lang"], ids, limit):
            for row in _cells_of(counts, ids, width):
                np.add.at(total, row, counts.docs.astype(np.uint32))
        yield sliced(total)
        pa.default_memory_pool().release_unused()  # the worker stays

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": [np.packbits(large(data) >= min_docs).tobytes()]})

    rows = summed(docs.mapInArrow(count, "slice int, sender int, counts binary"), partitions_for(docs))
    bits = {r.slice: r.bits for r in rows.mapInArrow(reached, "slice int, bits binary").collect()}
    return np.frombuffer(b"".join(bits.get(k, b"\0" * (DEPTH * width // SLICES // 8)) for k in range(SLICES)), np.uint8)


def term_counts(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """lang, source, term, n (occurrences), docs, of the terms that the bits leave possible; and each group once with term '' and 0.

    All rows of a language's term are in one partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    limit, most = CHUNK, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least = shared.value
        ids: dict[tuple[bytes, ...], int] = {}
        held: list[pa.Table] = []

        def sent() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            if len(held) > 1:
                table = table.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            held.clear()
            names = [pa.array([g[k] for g in ids], pa.binary()).cast(pa.string()) for k in (0, 1)]
            for batch in table.to_batches(max_chunksize=50_000):
                columns = [*(x.take(batch.column(0)) for x in names), batch.column(1).cast(pa.string()), batch.column(2), batch.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for counts in _counts(batches, ["lang", "source"], ids, limit):
            at = _cells_of(counts, ids, width)
            keep = np.flatnonzero((at_least[at >> 3] >> (7 - (at & 7)) & 1).all(0))
            held.append(pa.table({"group": counts.group[keep], "term": counts.terms.take(pa.array(counts.place[keep])), "n": counts.n[keep], "docs": counts.docs[keep]}))
            del at, keep, counts
            if sum(map(len, held)) > most:
                yield from sent()
        none = np.zeros(len(ids), np.int64)
        held.append(pa.table({"group": np.arange(len(ids)), "term": pa.array([b""] * len(ids), pa.binary()), "n": none, "docs": none}))
        yield from sent()
        pa.default_memory_pool().release_unused()  # the worker stays

    rows = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exactly: counts may be so large that the product is no long."""
    whole = f"({total} + 2 * {kept})"
    exact = f"CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0)) div CAST({whole} AS DECIMAL(20, 0))"
    return F.expr(f"1 + CASE WHEN {whole} <= 0 THEN 0 WHEN {count} <= 9000000000 THEN {UNIT}L * ({count} + 2) div {whole} ELSE {exact} END")


def _far(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _dealt(rows: DataFrame, blocks: int, left: bool) -> DataFrame:
    """Rows with the blocks in which each meets the other side's."""
    own, other = ("block_x", "block_y") if left else ("block_y", "block_x")
    mine = F.pmod(F.xxhash64(F.lit(3), "source"), F.lit(blocks)).cast("int")
    return rows.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], where: str, value: str, blocks: int) -> DataFrame:
    """lang, a, b (a < b) and a value for each row of the left side (x) with one of the right side (y) that has the same keys.

    Undealt sides that are the same table are shuffled once.
    """
    if blocks > 1:
        left, right, keys = _dealt(left, blocks, True), _dealt(right, blocks, False), [*keys, "block_x", "block_y"]
    met = left.alias("x").join(right.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]).where(where)
    return met.select("x.lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), F.expr(value).cast("long").alias("value"))


def divergence_audit(docs: DataFrame, min_docs: int = 10, top: int = 10, width: int | None = None) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. docs: text, lang, source.

    min_docs: documents of a language in which a term must be. top: ranks of terms; pairs have them all. width: cells in a row of the sketch; 128 at least;
    it changes what is sent and not the result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    width = width or sketch_width(docs)
    term, lang = Window.partitionBy("lang", "term"), Window.partitionBy("lang")
    counts = term_counts(docs, possible_terms(docs, min_docs, width), width)
    counts = counts.withColumns({"n_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term), "first": F.min("source").over(term) == F.col("source")})
    counts = stored(counts.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.expr("first AND term != ''")).alias("v"))
    groups = groups.withColumns({"total_lang": F.sum("total").over(lang), "v": F.sum("v").over(lang)})
    groups = stored(groups.withColumn("p0", _share("0", "total", "v")), "groups")
    shares = counts.where("term != ''").join(small_side(groups), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    shares = shares.withColumn("q", _share("n_lang", "total_lang", "v")).select("lang", "source", "term", "n", "p", "q", "p0")

    blocks = 1 + groups.count() // BLOCK
    bare, own = groups.select("lang", "source", "p0", "v"), shares.select("lang", "source", "term", "p", "p0")
    neither = _pairs(bare, bare, ["lang"], "x.source < y.source", f"x.v * {_far('x.p0', 'y.p0')}", blocks)
    by_count = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    one = _pairs(by_count, bare, ["lang"], "x.source != y.source", f"x.k * ({_far('x.p', 'y.p0')} - {_far('x.p0', 'y.p0')})", blocks)
    both = _pairs(own, own, ["lang", "term"], "x.source < y.source", f"{_far('x.p', 'y.p')} - {_far('x.p', 'y.p0')} - {_far('x.p0', 'y.p')} + {_far('x.p0', 'y.p0')}", blocks)
    sums = stored(neither.union(one).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = shares.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_far("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).union(terms.withColumn("part", F.lit("term")).select(*out))
