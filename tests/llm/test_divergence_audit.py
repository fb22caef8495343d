"""The sketch's promise, and all values in exact integers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cueline.llm import divergence_audit as A


def terms_of(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top):
    rows = [(t or "", x or "", s or "") for t, x, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        df = Counter(w for t, _, _ in mine for w in set(terms_of(t)))
        kept = [w for w, n in df.items() if n >= min_docs]
        counts = {s: Counter(w for t, _, x in mine if x == s for w in terms_of(t)) for s in {r[2] for r in mine}}
        whole = sum(counts.values(), Counter())

        def share(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}  # noqa: B023

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted(((-sum(far(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-far(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(terms[:top])]
    return sorted(out)


def corpus(rng, n=400):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Öl", "É", "x\U0001f600"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "a", "a", "B", "é", None, ""])
        mine = words if source == "a" else words[::-1]
        rows.append((" ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(mine, weights, k=rng.randrange(30))) + rng.choice(["", ".", " 12-x"]), rng.choice(["en", "fr", None]), source))
    return rows + [(None, "en", "only"), ("", "xx", "a"), ("alone", "xx", "b"), ("one two", "solo", "s"), *[("dup dup", "solo", "s")] * 12]


@pytest.mark.parametrize("width", [128, 1 << 16])
def test_against_exact_integers(spark, monkeypatch, width):
    rows = corpus(random.Random(width))
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(6)
    got = A.divergence_audit(docs, 10, 10, width)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_dealt_groups_and_few_terms_held(spark, monkeypatch):
    """Groups dealt over blocks; counts passed on again and again."""
    monkeypatch.setattr(A, "BLOCK", 3)
    monkeypatch.setattr(A, "HELD", 20)
    rows = corpus(random.Random(9), 200)
    assert sorted(map(tuple, A.divergence_audit(spark.createDataFrame(rows, "text string, lang string, source string"), 3, 4).collect())) == brute(rows, 3, 4)


def test_empty(spark):
    assert A.divergence_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_sketch_never_underestimates(spark):
    rng = random.Random(2)
    rows = corpus(rng, 300)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    df = Counter((x or "", w) for t, x, _ in rows for w in set(terms_of(t)))
    for width in (128, 1 << 12):
        bits = A.possible_terms(docs, 10, width)
        assert len(bits) == A.DEPTH * width // 8
        passed = {}
        for (lang, w), n in df.items():
            at = A.cells([w.encode()], lang.encode(), width)
            passed[lang, w] = bool((bits[at >> 3] >> (7 - (at & 7)) & 1).all())
            assert passed[lang, w] or n < 10
    assert sum(passed.values()) == sum(n >= 10 for n in df.values())  # of the wide one, nothing that is impossible


def test_large_counts(spark):
    """Products beyond a long."""
    n = 40_000_000_000
    got = spark.range(1).selectExpr(f"{n}L AS c", f"{3 * n}L AS t", "7L AS v").select(A._share("c", "t", "v").alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (n + 2) // (3 * n + 14)
    assert spark.range(1).selectExpr("0L AS c", "0L AS t", "0L AS v").select(A._share("c", "t", "v").alias("p")).first().p == 1


def test_width():
    assert np.log2(A.LEAST_CELLS) % 1 == 0 and A.DEPTH * A.LEAST_CELLS % (8 * A.SLICES) == 0


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_counts_by_arrays(chunk):
    """Texts that touch, slices of a column, nulls, and texts longer than what is counted at once."""
    rng = random.Random(chunk)
    rows = [(None, "a"), ("x", "a"), ("y", "b"), ("", "a"), ("Éa!éa", "b"), (" x", "b"), ("x ", "a"), *[(" ".join(rng.choices(["q", "Q", "rs", "ü", "-", "x1y"], k=rng.randrange(60))), rng.choice("ab")) for _ in range(80)], (None, "b")]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r[0] for r in rows], pa.string()), "source": [r[1] for r in rows]})
    n, docs, ids = Counter(), Counter(), {}
    for c in A._counts(iter([batch.slice(0, 30), batch.slice(30, 0), batch.slice(30)]), ["source"], ids, chunk):
        groups, terms = list(ids), c.terms.to_pylist()
        for g, k, many, rows_ in zip(c.group.tolist(), c.place.tolist(), c.n.tolist(), c.docs.tolist(), strict=True):
            n[groups[g][0].decode(), terms[k].decode()] += many
            docs[groups[g][0].decode(), terms[k].decode()] += rows_
    assert n == Counter((s, w) for t, s in rows for w in terms_of(t))
    assert docs == Counter((s, w) for t, s in rows for w in set(terms_of(t)))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 50)
    rows = corpus(random.Random(5), 150)
    assert sorted(map(tuple, A.divergence_audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), 5, 6).collect())) == brute(rows, 5, 6)


def test_counts_are_written_and_shuffled_once(spark, monkeypatch):
    """What is as large as the input's distinct terms is written as one table, and both sides of its join with itself come from one shuffle."""
    written, plans = [], []

    def stored(df, name):
        written.append(name)
        back = keep(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return back

    keep = A.stored
    monkeypatch.setattr(A, "stored", stored)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # the plan as it is run
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        A.divergence_audit(spark.createDataFrame(corpus(random.Random(3), 100), "text string, lang string, source string"), 5, 5).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert written == ["counts", "groups", "pairs"]
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert re.search(r"ReusedExchange \[.*\], Exchange hashpartitioning\(lang#\d+, term#\d+", plans[2])
