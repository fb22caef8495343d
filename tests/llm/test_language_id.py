"""Held-out accuracy, spans of mixed text, and Viterbi against all labellings."""

import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from cueline.llm.language_id import SCRIPTS, UNKNOWN, Labeller, Languages, grams, held_out_language_id, label_languages, learn_languages, letters_of, words_of

WORDS = {"en": "the of and house water time people with there which about".split(), "fr": "le de et maison eau temps gens avec où lequel étaient".split(), "ru": "и в не на дом вода время люди который они".split()}


def text(rng, lang, n=30):
    return " ".join(rng.choices(WORDS[lang], k=n))


def test_held_out(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang, "k") for i, lang in enumerate(rng.choices(["en", "fr", "ru"], k=300))]
    rows += [(500, None, "en", "k"), (501, "", None, "k"), (501, " 12 .. \n", "fr", "k"), (None, text(rng, "fr"), None, "k"), (502, text(rng, "en", 20000), None, "k"), (503, "日本語 中文", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = held_out_language_id(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:300]}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert by[500].lang_pred == by[501].lang_pred == "und" and by[None].lang_pred == "fr" and by[502].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert held_out_language_id(docs.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, text(rng, "en", 20) + " " + text(rng, "ru", 10) + " " + text(rng, "fr", 15))], "doc_id long, text string")
    spans = label_languages(mixed, learn_languages(docs)).first().spans
    assert [(s.first, s.end, s.lang) for s in spans] == [(0, 20, "en"), (20, 30, "ru"), (30, 45, "fr")]


def test_viterbi():
    rng = np.random.default_rng(1)
    labeller = Labeller(Languages(["a", "b", "c"], np.zeros((8, 3), np.float32), np.ones((len(SCRIPTS), 3), bool)), 1.5, 3.0)
    labeller.scores = rng.normal(scale=2, size=(40, 3)).astype(np.float32)
    counts = np.array([0, 5, 1, 7, 3])
    at = rng.integers(0, 40, counts.sum())
    labels = labeller.label(at, counts)
    for begin, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        total = lambda y: sum(labeller.scores[at[begin + k], v] for k, v in enumerate(y)) - 1.5 * sum(a != b for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=total)
        assert abs(total(tuple(labels[begin : begin + n])) - total(best)) < 1e-4


def test_grams():
    g = grams(["ab", "c"], 1 << 30)
    assert np.bincount(g.words).tolist() == [2 + 3 + 2, 1 + 2 + 1]


def test_words_end_where_the_script_changes():
    assert words_of("one (two) трое[x] été") == ["one", "(two)", "трое[", "x]", "été"]
    assert words_of("日本語はPythonで東京") == ["日本語", "は", "Python", "で", "東京"]
    assert words_of("") == [] and words_of("数") == ["数"]


def test_spans_without_blanks(spark):
    rng = random.Random(4)
    run = lambda letters, n: "".join(rng.choices(letters, k=n))
    rows = [(i, run("天地人日月水火山", 20) if i % 2 else run("กขคงจฉชซ", 20), "zh" if i % 2 else "th") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, run("天地人日月水火山", 12) + run("กขคงจฉชซ", 9))], "doc_id long, text string")
    assert [(s.first, s.end, s.lang) for s in label_languages(mixed, learn_languages(docs)).first().spans] == [(0, 1, "zh"), (1, 2, "th")]


def test_stray_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, "some words", "en" if i % 2 else f"stray {i}") for i in range(100)], "doc_id long, text string, lang string")
    learned = learn_languages(docs, most_languages=3)
    assert len(learned.names) == 3 and "en" in learned.names


def test_query_against_brute_force(spark):
    """Counts, scores of words, the best labelling and the score of a text, all written out."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS[a] + WORDS[b][:2], k=rng.randrange(0, 7))), a) for i, (a, b) in enumerate((rng.choice(["en", "fr", "ru"]), rng.choice(["en", "fr", "ru"])) for _ in range(80))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    slots, full = 1 << 15, (1 << 64) - 1

    def finish(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def slots_of(word):
        padded, out = f" {word} ", []
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                if n > 1 or padded[k] != " ":
                    total = n
                    for c in padded[k : k + n]:
                        total = (total * 0x9E3779B97F4A7C15 + ord(c)) & full
                    out.append(finish(total) % slots)
        return out

    counts, latin = {}, {}
    for i, t, lang in rows:
        if not held(i):
            for w in t.split():
                for s in slots_of(letters_of(w)):
                    counts.setdefault(lang, Counter())[s] += 1
                latin.setdefault(lang, Counter())[w[0] < "\u0370"] += 1
    names = sorted(counts)
    logs = {k: lambda s, k=k: math.log((counts[k][s] + 0.5) / (sum(counts[k].values()) + 0.5 * slots)) for k in names}
    uses = {k: {x for x in (True, False) if latin[k][x] >= 0.01 * sum(latin[k].values())} for k in names}

    def scores_of(word):
        raw = {k: sum(logs[k](s) for s in slots_of(letters_of(word))) for k in names if (word[0] < "\u0370") in uses[k]}
        return [max(raw[k] - max(raw.values()), -3.0) if k in raw else -1e4 for k in names]

    got = {r.doc_id: r for r in held_out_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        words = t.split()
        assert got[i].held_out == held(i)
        if not words:
            assert (got[i].lang_pred, got[i].score) == (UNKNOWN, 0.0)
            continue
        each = [scores_of(w) for w in words]
        value = lambda y: sum(e[v] for e, v in zip(each, y, strict=True)) - 5.0 * sum(a != b for a, b in itertools.pairwise(y))  # noqa: B023, E731
        ranked = sorted(itertools.product(range(len(names)), repeat=len(words)), key=value, reverse=True)
        if value(ranked[0]) - value(ranked[1]) < 1e-3:
            continue  # a tie, but for rounding
        by = Counter()
        for w, v in zip(words, ranked[0], strict=True):
            by[v] += len(w)
        winner = max(by, key=lambda v: (by[v], -v))
        mean = [sum(max(e[k], -3.0) for e, v in zip(each, ranked[0], strict=True) if v == winner) for k in range(len(names))]
        assert got[i].lang_pred == names[winner]
        assert abs(got[i].score - by[winner] / sum(by.values()) / sum(math.exp(m - mean[winner]) for m in mean)) < 1e-3


def test_stretches_and_many_languages():
    """A text in stretches has the labels of one that is read at once; hundreds of languages stay within the cells."""
    rng = np.random.default_rng(7)
    few = Languages(["a", "b", "c"], rng.normal(0, 2, (64, 3)).astype(np.float32), np.ones((len(SCRIPTS), 3), bool))
    words = ["".join(random.Random(k).choices("abcdefgh", k=1 + k % 7)) for k in range(90)]
    text = " ".join(random.Random(1).choices(words, k=3000)) + "  "
    whole = Labeller(few, 2.5, 3.0).texts([text, "", text[:50]])
    for cells in (30, 900, 5000):
        got = Labeller(few, 2.5, 3.0, cells=cells).texts([text, "", text[:50]])
        assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in whole]
        np.testing.assert_allclose([g[1] for g in got], [w[1] for w in whole], atol=1e-6)
    many = Languages([f"l{k}" for k in range(400)], rng.normal(0, 2, (64, 400)).astype(np.float32), np.ones((len(SCRIPTS), 400), bool))
    tracemalloc.start()
    assert len(Labeller(many, 5.0, 3.0, cells=1 << 20).texts([text * 5, text[:90]])) == 2
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert Labeller(few, 2.5, 3.0, cells=10).texts([" " * 500, "1 2 3 " * 90]) == [(UNKNOWN, 0.0, [])] * 2


def test_languages_beyond_the_bound_are_told(spark):
    docs = spark.createDataFrame([(k, f"word{k}", f"l{k % 5}") for k in range(20)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="2 languages with 8 rows"):
        learn_languages(docs, most_languages=3)
