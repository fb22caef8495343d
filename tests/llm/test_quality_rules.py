"""Counts against brute force; the verdict on planted good and bad documents."""

import random
import re
from collections import Counter

import numpy as np

from cueline.llm.quality_rules import fit_ratios, keep_good, quality_rules, quality_stats


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


def test_rules(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices("the a of and on is it was by to".split(), k=60)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices("the a of and on is it was by to".split(), k=60)) for _ in range(30)]
    odd = [None, "", " \n\t", "é ñ " * 30, "a\nb\na\n\n\na \n b", "x y z" * 9, "#$ <b> & | * %" * 10, "one two three four five six seven eight " * 3 + "nine ten", "w" * 100_000, "a\x0bb\x0cc\r\n" * 20]
    rows = [(i, t, 1, "k") for i, t in enumerate(good + bad + odd)] + [(None, good[0], 1, "k"), (0, good[0], 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, kept string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels, buckets=1 << 12).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        n, chars, symbols, dup, repeat, failed = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed), r
        if r.doc_id is not None and r.doc_id < 60 and not failed:
            assert r.kept
        if r.doc_id is not None and 60 <= r.doc_id < 90:
            assert not r.kept
    kept = keep_good(docs, labels, buckets=1 << 12)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    empty = quality_rules(docs.limit(0), labels)
    assert empty.count() == 0
    assert all(r.kept == (not r.base_failed) for r in quality_rules(docs, labels.limit(0)).collect())


def test_every_label_counts(spark):
    """With all documents trusted nothing tells the target from the corpus, however many there are."""
    docs = spark.range(20_300).selectExpr("id AS doc_id", "concat('w', id, ' v', id) AS text")
    assert not fit_ratios(docs, docs.selectExpr("doc_id", "1 AS quality"), buckets=1 << 12).any()


def test_size_of_input(spark):
    """The same documents 1, 8 and 64 times over get the same verdicts, by the query's own parameters."""
    rng = random.Random(5)
    plain, junk = [f"w{k}" for k in range(200)], [f"zz{k}" for k in range(40)]
    rows = []
    for i in range(200):
        part = 0 if i < 100 else (i % 4) / 4  # junk from none to three quarters
        rows.append((i, " ".join(rng.choice(junk if rng.random() < part else plain) for _ in range(60)), int(i < 100)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    kept, scores = [], []
    for copies in (1, 8, 64):
        got = quality_rules(docs.crossJoin(spark.range(copies)).select("doc_id", "text"), docs).select("doc_id", "kept", "score").distinct().collect()
        kept.append({r.doc_id for r in got if r.kept})
        scores.append([s for _, s in sorted({(r.doc_id, round(r.score, 6)) for r in got})])
    assert kept[0] == kept[1] == kept[2] and scores[0] == scores[1] == scores[2]
    assert kept[0] == {i for i, _, _ in rows if i < 100 or i % 4 == 0}


def test_ratio_by_hand(spark):
    """Scores against counters over words and pairs; sums in one level or in several."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30 + 10 * (i % 2))], k=40))) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(9), spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    grams = lambda t: (w := t.split()) + list(zip(w, w[1:]))
    total, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows[:100] if i % 2 for g in grams(t))
    whole, part, prior = total.total(), target.total(), 1e-4
    want = {i: np.mean([np.log((target[g] / part + prior) / (total[g] / whole + prior)) for g in grams(t)]) for i, t in rows}
    for fan in (64, 2):
        stats = quality_stats(docs, fit_ratios(docs, labels, buckets=1 << 22, fan=fan))
        off = [abs(r.score - want[r.doc_id]) for r in stats.collect()]
        assert np.median(off) < 1e-6 and max(off) < 0.02  # a slot may hold two n-grams
