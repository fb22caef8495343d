"""Signatures, pairs and groups against brute force."""

import random
import re

import numpy as np
import pytest

from cueline.llm.near_dedup import SIZE, components, early_shingles, keep_one_of_each, near_duplicates, shingle_set, super_minhash
from cueline.llm.shared import U64, WordHash


def brute(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def slow_signature(elements, size):
    """SuperMinHash, one element after the other, with the same draws."""
    from cueline.llm.near_dedup import draws

    h = [float("inf")] * size
    for e in elements:
        p = list(range(size))
        for j in range(size):
            place, r = draws(np.array([e], U64), j, size)
            k = int(place[0])
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], float(r[0]) + j)
    return h


def test_signatures():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(U64)) for n in (1, 2, 7, 60, 400, 3000)]
    got = super_minhash(sets, 32, held=200)
    for s, row in zip(sets, got, strict=True):
        np.testing.assert_allclose(row, slow_signature(s, 32))
    a = np.unique(rng.integers(0, 1 << 63, 4000).astype(U64))
    v = super_minhash([a[:3000], a[1000:]])
    assert abs((v[0] == v[1]).mean() - 0.5) < 0.15 and v.shape == (2, SIZE)


def test_shingles():
    h = WordHash()
    assert len(shingle_set(b"", h)) == 0 and len(shingle_set(b" \n", h)) == 0
    assert len(shingle_set(b"a B", h)) == 1 and shingle_set(b"a B", h)[0] == shingle_set(b" A\tb ", h)[0] != shingle_set(b"b a", h)[0]
    assert len(shingle_set(b"a b c d e a b c d e", h)) == 5


@pytest.mark.parametrize("few", [0, 40, 1_000_000])
def test_components(spark, few):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)] + [(5000, 6000 + i) for i in range(50)]
    got = {r.doc_id: r.component_id for r in components(spark.createDataFrame([(min(a, b), max(a, b)) for a, b in links if a != b], "a long, b long").repartition(9), few).collect()}
    up = {}
    for a, b in links:
        if a != b:
            x, y = up.setdefault(a, {a}), up.setdefault(b, {b})
            if x is not y:
                x |= y
                for n in y:
                    up[n] = x
    assert got == {n: min(g) for n, g in up.items()}


def test_groups(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: " ".join(rng.choices(words, k=n))
    change = lambda t, n: " ".join(w if rng.random() > n / len(t.split()) else "zz" for w in t.split())
    base = [fresh(rng.randrange(3, 160)) for _ in range(60)]
    passage = fresh(40)
    texts = base + [change(rng.choice(base), rng.choice([0, 1, 2, 5])) for _ in range(160)] + [passage + " " + fresh(rng.randrange(5, 60)) for _ in range(40)] + [base[0].upper()] * 40
    texts += [None, "", "one", "ONE", "one two three four", "one two three four five", " " * 5, "é " * 30_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, kept string, a int").repartition(6)
    want = brute(rows)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})
    odd = spark.createDataFrame([(None, base[1]), (None, base[1]), (7, base[1]), (7, base[1]), (9, base[1])], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_duplicates(odd).collect()) == sorted(map(str, [(None, None, True)] * 2 + [(7, 7, True)] * 2 + [(9, 7, False)]))
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


def test_common_passage(spark):
    """Ten near duplicates far apart in buckets that a passage of a thousand other documents fills."""
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(79)
    rows = [(i, f"{passage} {fresh(10 if i % 100 == 55 else 30)}") for i in range(1010)]
    want = brute(rows)
    assert sum(c == 55 for _, c in want.values()) == 10
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_early_shingles():
    """Sets at and about the threshold meet in a list, whatever the counts of their shingles."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = sorted(rng.integers(1, 120, 2))
        both = min(n, -(-75 * (n + m) // 175))
        pool = np.unique(rng.integers(0, 1 << 63, 400).astype(U64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[200 : 200 + m - both]]))
        small, large = ({(c, t) for c, big, tokens, _ in early_shingles(s, rng_counts, 75) if big == role for t in tokens} for rng_counts in [rng.integers(2, 9, 64)] for s, role in ((x, False), (y, True)))
        if 100 * both >= 75 * (n + m - both):
            assert small & large


@pytest.mark.parametrize("strangers", [400, 1500])
def test_boilerplate(spark, strangers):
    """Planted pairs just above the threshold among strangers that share a passage below it; buckets as one and in parts."""
    rng = random.Random(strangers)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(61)
    texts = [f"{passage} {fresh(40)}" for _ in range(strangers)]
    for _ in range(60):  # the two share 67 of their 76 shingles, and 57 with each stranger
        own = fresh(10)
        texts += [f"{passage} {own} {fresh(9)}", f"{passage} {own} {fresh(9)}"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(c != d for d, (_, c) in want.items()) >= 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for heads in (10**6, 100 if strangers == 400 else 10**6):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, heads_a_salt=heads).collect()} == want


def test_clashing_names(spark):
    rows = [(i, f"{'a b c d e f g h ' * 3}{i % 2}", i * 7, "x", 2.0, "y") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_id__ long, component_id string, document double, salt_of_part string")
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [rows[0]]
