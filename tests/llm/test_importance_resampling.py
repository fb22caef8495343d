"""Buckets, weights, the k-th key and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import importance_resampling as R


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for doc_id, text in rows:
        n, f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(drawn):
        r[4] = k + 1 if k < percent * len(drawn) // 100 else None
    return [tuple(r[:4]) + (r[4] if r in drawn else None,) for r in out]


def test_appended():
    rng = random.Random(1)
    for length in (0, 1, 5, 63, 64, 65, 200, 100_000):
        a, b = rng.randbytes(9), rng.randbytes(length)
        got = R.appended(np.array([zlib.crc32(a)], np.uint32), np.array([length]))
        assert int(got[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("stretch", [3, 40, 1 << 20])
@pytest.mark.parametrize("words", [1, 7, 200_000])
def test_buckets(monkeypatch, stretch, words):
    monkeypatch.setattr(R, "STRETCH", stretch)
    monkeypatch.setattr(R, "WORDS", words)
    rng = random.Random(words)
    batch = ["", "One", "a b", "É x.y_z \U0001f600 9a", "-- --", "w" * 500 + " v", *(" ".join(rng.choices(["a", "Bc", "d1", "x" * 70, "é"], k=rng.randrange(40))) for _ in range(30))]
    want = [(k, bucket(f)) for k, t in enumerate(batch) for f in features(t)[1]]
    got = [(int(o), int(b)) for owner, found in R.text_buckets([t.encode() for t in batch], R.WordCrc(5)) for row in found for o, b in zip(owner, row, strict=True) if b >= 0]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("digit", [3, 16])
def test_kth_key(spark, digit):
    rng = random.Random(digit)
    keys = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, -5, 7]), rng.randrange(2), rng.choice([-3, 0, 1 << 40, -(1 << 62)]), rng.randrange(3)) for _ in range(300)]
    rows = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in R.KEY))
    keys.sort()
    for k in (1, 2, 77, 150, 299, 300):
        found, due = R.kth_key(rows, k, digit)
        assert tuple(found) == keys[k - 1] and due == k - keys.index(keys[k - 1])


def test_documents(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Öl", "x9"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 25, 80])))) for k in range(400)]
    rows += [(None, " ".join(words)), (None, None), (7, rows[9][1]), (-4, "q " * 50_000), (1 << 40, "."), *[(900, " ".join(words[:30]))] * 30]
    target = [" ".join(rng.choices(words[:9], k=30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, n_words int, score string, rank double").repartition(5)
    got = R.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, target)))
    empty = docs.limit(0)
    assert R.importance_resample(empty, empty).count() == 0
    assert sorted(map(str, map(tuple, R.importance_resample(docs, empty).collect()))) == sorted(map(str, brute(rows, [])))


def test_equal_rows(spark):
    """Very many rows of one key, of which a part is due."""
    rows = [(5, " ".join(["same"] * 25))] * 500 + [(k, " ".join(["other"] * 25)) for k in range(20)]
    got = R.importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same same",)], "text string"), percent=40).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, ["same same"], 40)))


def test_only_drawn_rows_are_sorted(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c " * 10).alias("text"))
    ranks = sorted(r.rank for r in R.importance_resample(docs, docs).collect() if r.rank is not None)
    assert ranks == list(range(1, 16))
