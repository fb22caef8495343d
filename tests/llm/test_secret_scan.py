"""Base spans against plain matching, Viterbi against all labellings, and what the field finds by itself."""

import hashlib
import itertools
import random
import re

import numpy as np

from cueline.llm.secret_scan import BEGIN, BLOCKS, Field, best_labels, field_spans, find_secrets, scan, secret_spans, span_digests, tokens, train_field, weak_labels, windows


def plain(text):
    out = []
    for rank, (kind, pattern, flags, group, least) in enumerate(
        [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 0, 20), ("hex", r"[0-9a-f]+", 0, 0, 24)]
    ):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_viterbi():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        field = Field(np.zeros((sum(BLOCKS), 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32))
        scores = rng.normal(scale=4, size=(n, 3)).astype(np.float32)
        total = lambda y: sum(scores[k, v] for k, v in enumerate(y)) + sum(field.moves[a, b] for a, b in itertools.pairwise((0, *y, 0)))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=total)
        assert tuple(best_labels(field, scores, np.zeros(n, int))) == best


def test_tokens():
    t = tokens([b"a=\"b.c\" \xc3\xa9x", b"", b" ", b"token : 0123456789abcdef01234567"])
    assert list(zip(t.text, t.start, t.end, strict=True)) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 6), (0, 6, 7), (0, 8, 11), (3, 0, 5), (3, 6, 7), (3, 8, 32)]
    assert t.long_hex.tolist() == [False, False, False, True]


def test_queries(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(2, 9)))
    code = lambda n=20: "".join(rng.choices("0123456789abcdef", k=n))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{prose(40)} password={code()} {prose(30)}" if i % 3 == 0 else f'{prose(30)} token = "{code(40)}" {prose(9)}' if i % 3 == 1 else prose(60), "k") for i in range(300)]
    rows += [(900, f"{prose(20)} passphrase={code()} {prose(20)}", "k"), (901, None, "k"), (902, "", "k"), (901, "API_KEY: 'abc' secret:short secret=AKIA" + "Z9" * 9, "k"), (None, "é" * 50 + " passwd\"='x" + "a1" * 20, "k"), (903, "ſecret=abcdefgh toKen=abcdefgh", "k"), (904, prose(50_000), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = span_digests(secret_spans(docs, train_field(docs.where("doc_id < 300")))).collect()
    assert len(got) == len(rows)
    expected = sorted((str(d), hashlib.sha256(",".join(plain(t or "")).encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == expected
    found = {r.doc_id: r for r in got}
    assert "crf" in found[900].spans, "the field finds a value whose key no base pattern knows"
    assert sum("crf" in r.spans for r in got if r.doc_id is not None and r.doc_id < 300) <= 6
    assert found[904].spans == ""
    assert span_digests(find_secrets(docs.limit(0))).count() == 0
    assert scan(["no secrets here"], None) == [[]]


def alone(texts, field):
    """(secrets that the field finds by itself, all secrets, spans of the field, those of them on a secret); a base match's value is a secret."""
    found = wanted = said = right = 0
    for text in texts:
        raw = text.encode()
        t = tokens([raw])
        y = weak_labels(text, raw, t)
        spans = field_spans(field, t)[0] if len(t.start) else []
        at = [(int(a), int(b)) for a, b in zip(t.start[y == BEGIN], t.end[y == BEGIN], strict=True)]
        meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
        found, wanted = found + sum(any(meets(a, s) for s in spans) for a in at), wanted + len(at)
        said, right = said + len(spans), right + sum(bool((y[(t.start < s[1]) & (t.end > s[0])] > 0).any()) for s in spans)
    return found, wanted, said, right


def test_field_alone(spark):
    """Recall and precision without the base patterns: documents, keys and shapes of values that training did not see."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9)))
    code = lambda letters, n: "".join(rng.choices(letters, k=n))
    prose = lambda n: " ".join(word() for _ in range(n))
    mixed_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = lambda: rng.choice(["password=", "token: ", 'secret = "', "api_key="]) + code(rng.choice(["0123456789abcdef", mixed_case]), rng.randrange(14, 32))
    texts = [f"{prose(rng.randrange(20, 60))} {known()} {prose(20)}" if i % 2 else prose(60) for i in range(600)]
    field = train_field(spark.createDataFrame(list(enumerate(texts[:400])), "doc_id long, text string"))
    found, wanted, said, right = alone(texts[400:], field)
    assert wanted == 100 and found >= 95 and right >= 0.95 * said
    keys = [f"{prose(30)} {k}={code(mixed_case, 20)} {prose(20)}" for k in ("passphrase", "credential", "auth", "client_key") for _ in range(25)]
    assert sum(any(k == "crf" for _, _, k in s) for s in scan(keys, field)) >= 80
    shapes = [f"{prose(30)} password={code('0123456789ABCDEF', 8)}-{code(mixed_case, 12)} {prose(20)}" for _ in range(50)]
    assert sum(bool(field_spans(field, tokens([x.encode()]))[0]) for x in shapes) >= 40
    assert sum(bool(s) for s in scan([prose(60) for _ in range(200)], field)) <= 2


def test_windows_are_drawn_from_the_whole_text():
    text = " ".join(f"token=abcdefgh{i:04d} {'word ' * 60}" for i in range(40)).encode()
    rows, labels = windows([text])
    assert len(rows) <= 7 and (labels > 0).any(1).sum() >= 5
    again = windows([text])
    assert (again[0] == rows).all() and (again[1] == labels).all()
    first = windows([text], per_text=40)[0]
    assert len({x.tobytes() for x in rows} - {x.tobytes() for x in first[:8]}) > 0
