"""Blocks, attempts and fallbacks of services; the choice of segments in order."""

import json
import random

from pyspark.sql import functions as F

from cueline.operators import services as S


def rows_of(spark, n=25):
    return spark.createDataFrame([(k % 2, k, 100 + k, None if k == 4 else f"line {k}", 1 + k) for k in range(n)] + [(7, 0, 900, "alone", None)], "doc long, pos long, line_id long, text string, word_count int")


def test_blocks(spark):
    got = {(r.doc, r.block): ([x.text for x in r.lines], r.before) for r in S.in_blocks(rows_of(spark), ["doc"], ["pos"], 5, 2).collect()}
    even = ["line 0", "line 2", "", *(f"line {k}" for k in range(6, 25, 2))]
    odd = [f"line {k}" for k in range(1, 25, 2)]
    want = {(d, b): (t[5 * b : 5 * b + 5], t[max(0, 5 * b - 2) : 5 * b]) for d, t in ((0, even), (1, odd), (7, ["alone"])) for b in range(-(-len(t) // 5))}
    assert got == want


def test_attempts(spark, tmp_path):
    log = tmp_path / "log"

    def busy(texts, before):
        with log.open("a") as f:
            f.write("x")
        raise RuntimeError("429 busy")

    lines = rows_of(spark)
    got = S.tag_lines(lines, ["doc"], ["pos"], {"a": busy}, attempts=3, pause=lambda attempt, error: 0.0)
    assert {(r.tag_source, r.scene) for r in got.collect()} == {("rule", "daily")} and got.count() == 26
    assert len(log.read_text()) == 3 * (2 + 2 + 1)
    assert {r.tag_source for r in S.tag_lines(lines, ["doc"], ["pos"], {}).collect()} == {"rule"}
    assert S.tag_lines(lines.limit(0), ["doc"], ["pos"], {"a": busy}).count() == 0
    kept = {r.line_id: r.zh_text for r in S.translate_lines(lines, ["doc"], ["pos"], busy, pause=lambda attempt, error: 0.0).collect()}
    assert kept == {r.line_id: r.text or "" for r in lines.collect()}


def test_lists_in_answers(spark):
    item = {"scene": "work"}
    answers = [json.dumps([item]), json.dumps({"tags": [item]}), json.dumps({"z": [item], "a": 1}), json.dumps({"a": 1, "z": [item]}), "{}", "[", "", None, "null", "7", json.dumps({"data": 3, "items": []})]
    got = spark.createDataFrame(list(enumerate(answers)), "k int, a string").select("k", F.size(S.tags_by_position(F.col("a"))).alias("n")).collect()
    assert {r.k: r.n for r in got} == dict(enumerate([1, 1, 1, None, 0, None, None, None, None, None, 0]))
    odd = ['{"scene": 5, "keywords": "x"}', '{"emotion": "happy", "keywords": ["a", "", null, "b", "c", "d", "e"]}', '"text"', "null", "[]", "{}"]
    t = spark.createDataFrame(list(enumerate(odd)), "k int, a string").select("k", S.tag_of(F.parse_json("a"), F.lit("ai"), F.lit(30)).alias("t")).collect()
    assert {r.k: (r.t.scene, r.t.emotion, r.t.keywords, r.t.tag_source, r.t.difficulty) for r in t} == {
        0: ("daily", "neutral", [], "ai", "intermediate"), 1: ("daily", "happy", ["a", "b", "c"], "ai", "intermediate"),
        **{k: ("daily", "neutral", [], "rule", "advanced") for k in (2, 3, 4)}, 5: ("daily", "neutral", [], "ai", "intermediate"),
    }


def test_choice_in_order():
    """Against sorting all of a node's free candidates."""
    from cueline.operators.clips import choose_in_order
    from cueline.params import DEFAULT as p

    rng = random.Random(2)
    rows = []
    for node in range(60):
        for seq in sorted(rng.sample(range(40), rng.randrange(0, 6))):
            rows.append(("s", "e", float(node // 3), node, seq, seq * 2.0, seq * 2.0 + 1, f"t{seq}", rng.choice([2, 5, 9]), rng.choice([0.2, 0.45, 0.6, 0.8, 0.95, 1.0]), rng.choice([0.0, 0.0, 0.7])))
    used, cursor, want = set(), -1, []
    for node in range(60):
        own = [r for r in rows if r[3] == node and r[4] not in used]
        score = lambda r: (p.weight_text * r[9] + p.weight_vector * r[10] if r[10] > 0 else (p.weight_text + p.weight_vector) * r[9]) + (p.order_bonus if r[4] > cursor else -p.order_penalty)  # noqa: B023, E731
        own.sort(key=lambda r: -score(r))
        if not own:
            continue
        r, margin = own[0], score(own[0]) - (score(own[1]) if len(own) > 1 else 0.0)
        sure = (p.weight_text * r[9] + p.weight_vector * r[10]) / (p.weight_text + p.weight_vector) if r[10] > 0 else r[9]
        if (r[8] <= p.short_words and r[9] < p.short_similarity) or r[9] < p.least_similarity or sure < p.least_confidence:
            continue
        want.append((node, r[4], round(sure, 4), round(margin, 4), "ambiguous" if margin < p.ambiguous_margin else "seq"))
        used.add(r[4])
        cursor = max(cursor, r[4])
    got = [(x[2], x[3], x[6], x[9], x[10]) for x in choose_in_order(iter(rows))]
    assert got == want and len(want) > 15
