"""The sum-of-squares identity, gradients, and held-out accuracy."""

import random

import numpy as np

from cueline.llm.quality_classifier import Machine, Rows, fit_machine, held_out_quality


def test_identity():
    rng = np.random.default_rng(0)
    m = Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)).astype(np.float32), 9)
    rows = Rows(np.array([0, 3]), np.array([0, 4, 8, 1, 2, 3, 7]), rng.normal(size=7))
    for got, (a, b) in zip(m.margins(rows), ((0, 3), (3, 7)), strict=True):
        i, x = rows.index[a:b], rows.value[a:b]
        pairs = sum(m.factors[i[p]] @ m.factors[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(got - (0.3 + m.linear[i] @ x + pairs)) < 1e-5


def test_pairs_are_learned():
    rng = np.random.default_rng(4)
    pick = rng.integers(0, 2, (400, 2))
    index = np.c_[pick[:, 0], 2 + pick[:, 1]]  # the label is whether both agree: no linear rule tells it
    m = fit_machine(Rows(np.arange(0, 800, 2), index.ravel(), np.ones(800)), (pick[:, 0] == pick[:, 1]).astype(float), 4, epochs=60)
    assert ((m.scores(Rows(np.arange(0, 800, 2), index.ravel(), np.ones(800))) > 0.5) == (pick[:, 0] == pick[:, 1])).mean() > 0.95


def test_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)) for _ in range(5))
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(50))
    rows = [(i, good() if i % 3 else bad(), "en", i, "k") for i in range(400)]
    rows += [(900, None, None, None, "k"), (901, "", "en", 0, "k"), (1, rows[1][1], "en", 1, "k"), (None, good(), "en", 9, "k"), (902, "word " * 50_000, "en", 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = held_out_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert held_out_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in held_out_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    from cueline.llm import quality_classifier as Q

    seen = []
    fit = Q.fit_machine
    monkeypatch.setattr(Q, "fit_machine", lambda rows, labels, slots: seen.append(len(labels)) or fit(rows, labels, slots))
    docs = spark.createDataFrame([(i % 5, f"word{i} and {'more ' * (i % 9)}", i) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    Q.train_machine(docs, labels, train_rows=40)
    assert seen == [40]


def test_scores_against_brute_force(spark):
    """The query's scores are the sum over all pairs of features, written out."""
    from cueline.llm import quality_classifier as Q

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["fine", "words", "here", "BAD", "##", "x1"], k=rng.randrange(0, 12))), i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int("BAD" not in t)) for i, t, _ in rows], "doc_id long, quality int")
    m = Q.train_machine(docs, labels.where(~Q._held(labels.doc_id)))
    for r in held_out_quality(docs, labels).collect():
        f = Q.featurise([rows[r.doc_id][1].encode()], [rows[r.doc_id][2]], m.slots, Q.WordHash())
        i, x = f.index, f.value
        margin = m.bias + m.linear[i] @ x + sum(float(m.factors[i[p]] @ m.factors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-4
