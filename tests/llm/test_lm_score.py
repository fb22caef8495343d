"""Counts, base score and Kneser-Ney probabilities against a model in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from cueline.llm.lm_score import END, START, discounts, held_out_scores, train_model
from cueline.llm.shared import U64, WordHash


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(train, texts):
    pairs, words = Counter(), Counter()
    for t in train:
        before = ""
        for w in tokens(t):
            pairs[before, w] += 1
            words[w] += 1
            before = w
    n, v = sum(words.values()), len(words)
    contexts = Counter(w for _, w in pairs)
    of = lambda counts: discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])
    d, e = of(pairs), of(contexts)
    kinds, total = defaultdict(lambda: [0, 0, 0]), Counter()
    for (c, _), x in pairs.items():
        kinds[c][min(x, 3) - 1] += 1
        total[c] += x
    left = sum(e[min(c, 3) - 1] for c in contexts.values()) / len(pairs) if pairs else 1.0

    def p(c, w):
        alone = (max(contexts[w] - e[min(contexts[w], 3) - 1], 0) / len(pairs) if contexts[w] else 0) + left / (v + 1)
        if not total[c]:
            return alone
        x = pairs[c, w]
        return ((max(x - d[min(x, 3) - 1], 0) if x else 0) + sum(a * b for a, b in zip(d, kinds[c], strict=True)) * alone) / total[c]

    out = []
    for t in texts:
        ts = tokens(t)
        out.append((len(ts), sum(words[w] > 0 for w in ts), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), sum(math.log10(p(c, w)) for c, w in zip(["", *ts], ts, strict=False))))
    return out, p, [*words, "unseen"], total


def test_scores(spark):
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(40))) for _ in range(200)]
    texts += [None, "", " \n", "The THE the É é", "x " * 700, texts[0], texts[0]]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "null id", "k"), (3, texts[3], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    want, p, words, total = brute([t for d, t, _ in rows if not held(d)], [t for _, t, _ in rows])
    got = held_out_scores(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got) == sorted(key((d, held(d), *w)) for (d, _, _), w in zip(rows, want, strict=True))
    for c in ["", "w0", "w7", "unseen"]:
        assert abs(sum(p(c, w) for w in words) - 1) < 1e-9
    assert held_out_scores(docs.limit(0)).count() == 0


def test_split_contexts(spark):
    docs = spark.createDataFrame([(i, "a b%d a c%d d" % (i % 9, i % 4)) for i in range(60)], "doc_id long, text string")
    some, all_ = train_model(docs, hot_share=0.9), train_model(docs, hot_share=0.001)
    assert len(some.hot) == 1 and len(all_.hot) > 10
    h = WordHash()
    words = np.r_[h.of([b"a", b"b1", b"c2", b"d", b"zz"]), END]
    context, word = np.repeat(np.r_[words[:-1], START], len(words)), np.tile(words, len(words)).astype(U64)
    np.testing.assert_allclose(some.logs(context, word)[0], all_.logs(context, word)[0], rtol=1e-12)
