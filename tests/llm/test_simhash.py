"""Fingerprints, pairs and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cueline.llm.shared import U64, stretches
from cueline.llm.simhash import Groups, fingerprint, join_near, near_links, routes, simhash_duplicates, upper_tree


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, bits=2):
    """The smallest number in each one's group."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(prints):
        for j in range(i):
            if (int(x) ^ int(prints[j])).bit_count() <= bits:
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return [top(k) for k in range(len(prints))]


def clustered(rng, n, spread=5):
    """Distinct fingerprints, of which many are near others."""
    base = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), U64)


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "One  two", "a b c", "A\x0bb\x0cC a b c a b c", "É é \U0001f600 x y z", "x\x1fy \x85 z\xa0 w", "w " * 5000, "lone" * 1000])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == slow_print(text)


def test_stretches():
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "bc", " ", "\n", "def", "  "]) for _ in range(3000)).encode()
    for limit in (1, 5, 64, 10_000):
        for overlap in (0, 2):
            words, seen = [], 0
            for s in stretches(text, overlap, limit):
                assert s[: min(overlap, seen)] == (words[-overlap:] if overlap else [])
                words += s[min(overlap, seen) :]
                seen = len(words)
            assert words == text.split()


@pytest.mark.parametrize("levels", [0, 1, 4, 7])
def test_routes_lose_no_pair(levels):
    rng = random.Random(levels)
    x = clustered(rng, 700)
    tree = upper_tree(x[::9], levels, 2)
    shard, who, home = routes(tree, x, 2)
    at_home = {int(w): s for s, w, h in zip(shard, who, home, strict=True) if h}
    assert sorted(at_home) == x.tolist()  # each lives in one shard
    there = {(int(s), int(w)) for s, w in zip(shard, who, strict=True)}
    for i, a in enumerate(x.tolist()):
        for b in x[:i].tolist():
            if (a ^ b).bit_count() <= 2:
                assert (at_home[a], b) in there or (at_home[b], a) in there


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_join_near(bits):
    x = clustered(random.Random(bits), 900, 4)
    groups = join_near(x, len(x), bits, leaf=16)
    tops = groups.tops(np.arange(len(x)))
    want = slow_groups(x, bits)
    assert {(a, b) for a, b in zip(tops.tolist(), want, strict=True)} == {(b, b) for b in want}


def test_ball():
    """All at most two bits from one, which no radius parts well."""
    center = 0x123456789ABCDEF0
    x = np.array([center] + [center ^ 1 << i for i in range(64)] + [center ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)], U64)
    assert (join_near(x, len(x), 2).tops(np.arange(len(x))) == 0).all()


def test_groups():
    g = Groups(10)
    g.join(np.array([1, 3, 5, 9]), np.array([3, 5, 7, 9]))
    g.join(np.empty(0, int), np.empty(0, int))
    assert g.tops(np.arange(10)).tolist() == [0, 1, 2, 1, 4, 1, 6, 1, 8, 9]


@pytest.mark.parametrize("shards", [1, 16])
def test_links(spark, shards):
    x = clustered(random.Random(shards), 600)
    rows = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fingerprint long")
    at = {int(v): k for k, v in enumerate(x.view(np.int64))}
    g = Groups(len(x))
    for r in near_links(rows, 2, homes=50, shards=shards).collect():
        g.join(np.array([at[r.a]]), np.array([at[r.b]]))
    assert g.tops(np.arange(len(x))).tolist() == slow_groups(x)


def test_documents(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([1, 2, 4, 30, 900]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            t = list(base)
            if rng.random() < 0.6:
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += [None, "", "  ", rows[0].upper(), rows[0], "long " * 200_000]
    ids = [k * 7 % 1009 for k in range(len(rows))]
    ids[3] = None
    ids[5] = ids[6] = 11
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, fingerprint string, component_id double")
    prints = [slow_print(t) for t in rows]
    tops = slow_groups(prints)
    lows = {k: min((i for i, t in zip(ids, tops, strict=True) if t == k and i is not None), default=None) for k in set(tops)}
    want = sorted((str(i), f"{p:016x}", lows[t]) for i, p, t in zip(ids, prints, tops, strict=True))
    got = simhash_duplicates(table, homes=20)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash_duplicates(table.limit(0)).count() == 0


def test_only_without_ids(spark):
    got = simhash_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.doc_id is None) == [(True, None)] * 2
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id == 4] == [("0" * 16, 4)]
