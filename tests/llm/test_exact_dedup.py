"""The index by itself, and rows against grouping by the normalised text."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from cueline.llm.exact_dedup import ExtendibleIndex, _owned, drop_exact_copies, exact_dedup, normalised, place_of


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def test_normalised():
    for t in ["", " ", "a", " a", "a\t\n", "\x0b\x0c a  b\r\n c", "\xa0x y\x1cz", "\x85"]:
        assert normalised(t.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()


@pytest.mark.parametrize("in_order", [False, True])
def test_index(in_order):
    rng = random.Random(1)
    index = ExtendibleIndex(capacity=4)
    keys = [rng.getrandbits(64) for _ in range(500)] + [7, 7 | 1 << 63]
    for k in sorted(keys + keys) if in_order else keys + keys:
        index.insert(k, k, b"%d" % k, k % 5, 1)
    for b in index.directory:
        assert len(b.chains) <= 4 and b.depth <= index.depth
        assert all(b.depth == 0 or k >> (64 - b.depth) == b.bits for k in b.chains)
    assert len(index.directory) == 1 << index.depth and all(index.bucket(k).chains[k][0].count == 2 for k in keys)
    seen = [k for b in index.complete(None) for k in b.chains]
    assert sorted(seen) == sorted(keys) and index.written == len({x for x in index.slots() if x >= 0})


def test_buckets_go_when_they_are_complete():
    """Of texts in order a bucket or two are held; each text is written once, in the bucket to which the directory points."""
    rng = random.Random(4)
    keys = sorted(rng.getrandbits(64) for _ in range(3000))
    rows = [(place_of(k, 3)[0], k - (1 << 63), 1, 1, b"%d" % k, None) for k in keys]
    schema = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("low", pa.int64()), ("count", pa.int64()), ("body", pa.binary()), ("payload", pa.null())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    where, held, directories = {}, [], {}
    for owner, index, bucket in _owned(iter([batch]), 3, lambda: ExtendibleIndex(8)):
        if bucket is None:
            directories[owner] = (index.depth, index.slots())
        else:
            held.append(sum(len(b.chains) for b in {id(b): b for b in index.directory}.values()))
            for chain in bucket.chains.values():
                for e in chain:
                    assert e.text not in where
                    where[e.text] = (owner, bucket.number)
    assert len(where) == 3000 and max(held) <= 24 and sorted(directories) == [0, 1, 2]
    for k in keys:
        owner, place = place_of(k, 3)
        depth, slots = directories[owner]
        assert where[b"%d" % k] == (owner, slots[place >> (64 - depth)])


def test_colliding_keys_are_chained():
    index = ExtendibleIndex(capacity=1)
    for text in (b"a", b"b", b"a"):
        index.insert(5, 5, text, 0, 1)
    assert [(e.text, e.count) for e in index.bucket(5).chains[5]] == [(b"a", 2), (b"b", 1)]


def test_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["x", "y", "é"], k=rng.randrange(6))) for _ in range(30)]
    rows = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n\t"]))) for i in range(400)]
    rows += [(500 + i, "hot text") for i in range(300)] + [(900, None), (901, ""), (902, " "), (None, "hot text"), (None, "alone"), (3, rows[3][1]), (3, rows[3][1]), (950, "word " * 200_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, kept string, key int").repartition(7)
    got = exact_dedup(df, capacity=8, memory_mb=1, bucket_mb=1).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted((str(a), str(b), c, d) for a, b, c, d in brute(rows))
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and next(r.doc_id for r in g if r.kept) == g[0].keep_id for g in by.values())
    left = drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(g[0].keep_id) for g in by.values())
    assert {r.text for r in left.collect()} <= {r[1] for r in rows}
    assert exact_dedup(df.limit(0)).count() == 0 and drop_exact_copies(df.limit(0)).count() == 0
