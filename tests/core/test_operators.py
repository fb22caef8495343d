"""Operators against plain Python, and what SQL does not reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.functions import text as X
from cueline.operators import clips as C
from cueline.operators import duplicates as D
from cueline.operators import folds as O
from cueline.operators import search as S
from cueline.operators import vectors as V
from cueline.params import Params
from cueline.sources import captions


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        Params(weight_zh=0.5)


def test_continues():
    assert O.continues("I was going...", "Home")
    assert not O.continues("I went home.", "and slept")
    assert O.continues("I went", "home")
    assert O.continues("He said that", "We won")
    assert not O.continues("He won", "We won")
    assert O.continues("He won", "We won", [1.0, 0.0], [1.0, 0.1])
    assert not O.continues("He won", "We won", [1.0, 0.0], [0.0, 1.0])
    assert not O.continues("", "x") and not O.continues("x", "")


def test_indel_ratio(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abc ", k=rng.randrange(12))), "".join(rng.choices("abc ", k=rng.randrange(12)))) for _ in range(60)]
    import pandas as pd

    fast = C.indel_ratios(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])).tolist()
    slow = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(X.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(fast, slow)


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(900, None)], "node_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r.node_id) for r in V.nearest(nodes.where("node_id < 10").withColumnRenamed("node_id", "query_id"), nodes, 4).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == {(q, int(n)) for q in range(10) for n in np.argsort(-(u @ u[q]))[:4]}
    assert V.nearest(nodes.limit(0).withColumnRenamed("node_id", "query_id"), nodes, 4).count() == 0


def test_encode(spark):
    df = spark.createDataFrame([(1, " Hello "), (2, None), (3, "hello")], "id int, text string")
    got = {r.id: r.embedding for r in V.encode(df, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()}
    assert got == {1: [5.0, 1.0], 2: [0.0, 0.0], 3: [5.0, 1.0]}


def test_edit_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcde f", k=rng.randrange(1, 40))) for _ in range(40)]
    edit = lambda t: "".join(c if rng.random() > 0.08 else rng.choice("xyz") for c in t)
    lines = spark.createDataFrame([(i, edit(rng.choice(base))) for i in range(80)], "line_id long, text string")
    nodes = spark.createDataFrame(list(enumerate(base)), "node_id long, text string")
    got = {(r.line_id, r.node_id) for r in D.edit_duplicates(lines, nodes).collect()}
    pairs = lines.crossJoin(nodes.withColumnRenamed("text", "other")).where(X.edit_distance(X.for_duplicates(F.col("text")), X.for_duplicates(F.col("other"))) < 0.15)
    assert got == {(r.line_id, r.n) for r in pairs.groupBy("line_id").agg(F.min("node_id").alias("n")).collect()}


def test_alignment_of_random_words(spark):
    rng = random.Random(42)
    words = [f"word{i}" for i in range(200)]
    segments = [("s", "e", i, " ".join(rng.choices(words, k=8)), i * 2.0, i * 2.0 + 1.5) for i in range(500)]
    nodes = [("s", "e", k, segments[k * 5][3], segments[k * 5][4]) for k in range(100)]
    out = C.align(spark.createDataFrame(nodes, "show_name string, episode string, node_id long, en_text string, start_time double"), spark.createDataFrame(segments, "show_name string, episode string, seq_index long, text string, start_time double, end_time double")).collect()
    assert len(out) > 80 and all(r.seq_index == r.node_id * 5 for r in out)


def test_alignment_takes_each_segment_once(spark):
    segments = spark.createDataFrame([("s", "e", 0, "one two three four", 1.0, 2.0), ("s", "e", 1, "five six seven eight", 3.0, 4.0)], "show_name string, episode string, seq_index long, text string, start_time double, end_time double")
    nodes = spark.createDataFrame([("s", "e", k, "one two three four", 1.0 + k / 10) for k in range(3)], "show_name string, episode string, node_id long, en_text string, start_time double")
    assert [(r.node_id, r.seq_index) for r in C.align(nodes, segments).collect()] == [(0, 0)]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, "a", False)], "id int, k string, has boolean")
    assert S.all_of(df).count() == 3 and S.all_of(df, {"k": "a"}).count() == 2 and S.all_of(df, {"k": "a", "id": None}, {"has": True}).count() == 1 and S.all_of(df, has={"has": False}).count() == 3


def test_files(spark, tmp_path):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nI was going to\n\n2\n00:00:02,100 --> 00:00:03,000\nthe store 你好\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/utf8.srt").write_text("﻿" + srt, encoding="utf-8")
    (tmp_path / "in/gbk.SRT").write_bytes(srt.encode("gbk"))
    (tmp_path / "in/utf16.srt").write_text(srt, encoding="utf-16")
    (tmp_path / "in/other.txt").write_text("no")
    rows = captions.read_subtitles(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 3 and {(r.en_text, r.word_count, r.parts) for r in rows} == {("I was going to", 4, 1)} or {r.en_text for r in rows} == {"I was going to the store 你好"}
    cues = spark.createDataFrame([("f", 1, 1000, 2000, "Hello", "你好"), ("f", 2, 3000, 4000, "there", "")], "name string, idx int, start_ms long, end_ms long, text string, zh_text string")
    captions.write_srt(cues, ["name"], str(tmp_path / "out"))
    text = next((tmp_path / "out/name=f").glob("part*")).read_text("utf-8")
    assert text.startswith("﻿1\n00:00:01,000 --> 00:00:02,000\nHello\n你好\n\n2\n")
    captions.save_table(cues, str(tmp_path / "table"), ["name"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_streams(spark, tmp_path):
    from cueline.streaming.feedback import feedback_windows, first_sources, ingest_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nI'm gonna figure out what's going on\n\n2\n00:00:03,000 --> 00:00:04,000\nHello\n")
    got = []
    ingest_files(spark, str(tmp_path / "in"), lambda rows, n: got.extend(rows.select("en_text", "filter_status").collect()), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.filter_status for r in got) == ["passed", "rejected_blacklist"]
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "click", 1.0, i % 2, "s", "e") for i in range(12)], "event_id int, t string, event_type string, value double, node_id int, show_name string, episode string").withColumn("ts", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, df, mode in (("windows", feedback_windows(stream()), "complete"), ("sources", first_sources(stream()), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 12 and spark.table("sources").count() == 2


def test_edit_pairs(spark):
    """All pairs within the distance, for texts of all lengths and of few letters, against comparing each with each."""
    import random

    from cueline.operators.duplicates import edit_pairs

    rng = random.Random(4)
    texts = ["", "a", "ab", "é", "\U0001f600a b"] + ["".join(rng.choices("ab c", k=rng.randrange(1, 90))) for _ in range(120)]
    for t in list(texts):
        edited = list(t)
        for _ in range(rng.randrange(0, 1 + len(t) // 6)):
            k = rng.randrange(len(edited) + 1)
            edited[k : k + rng.randrange(2)] = rng.choice(["x", "", "yz"])
        texts.append("".join(edited))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            row, last = [i + 1], row
            for j, q in enumerate(b):
                row.append(min(last[j] + (p != q), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a == b or (max(len(a), len(b)) and abs(len(a) - len(b)) / max(len(a), len(b)) < 0.15 and distance(a, b) / max(len(a), len(b)) < 0.15)}
    rows = list(enumerate(texts))
    got = edit_pairs(spark.createDataFrame(rows, "x_id long, x string"), spark.createDataFrame(rows, "y_id long, y string"))
    assert sorted((r.x_id, r.y_id) for r in got.collect()) == sorted(want) and len(want) > 300


def test_encodings():
    from cueline.sources.captions import decode_captions as _decode

    for text, name in (("naïve café déjà", "cp1252"), ("你好，世界", "gb18030"), ("你好，世界", "utf-8"), ("你好", "utf-16"), ("plain", "ascii"), ("你好", "utf-8-sig")):
        assert _decode(text.encode(name)) == text


def test_first_in_order(spark):
    """In rounds, in one task, and both, against taking the lines one by one."""
    from cueline.operators.lifecycle import first_in_order

    rng = random.Random(6)
    pairs = sorted({(a, a + rng.randrange(1, 12)) for a in range(0, 300) for _ in range(rng.randrange(3))} | {(k, k + 1) for k in range(1000, 1040)})
    made, into = set(), {}
    for line in sorted({x for p in pairs for x in p}):
        before = [a for a, b in pairs if b == line and a in made]
        if before:
            into[line] = min(before)
        else:
            made.add(line)
    rows = spark.createDataFrame(pairs, "earlier long, line_id long").repartition(5)
    for few in (1_000_000, 30, 0):
        assert {r.line_id: r.merged_into for r in first_in_order(rows, few).collect()} == into
    assert first_in_order(rows.limit(0)).count() == 0


def test_promote_in_order(spark):
    from cueline.operators.lifecycle import promote_in_order

    rows = [(0, 1, "hello brave new world"), (0, 2, "hello brave new worlds"), (0, 3, "hello brave new worldly"), (0, 4, "something else entirely"), (1, 5, "hello brave new world"), (1, 6, "known text of a node"), (0, 7, "hello brave new worldss"), (0, 8, "Hello, brave new world!"), (0, 9, None), (0, 10, None)]
    got = promote_in_order(spark.createDataFrame(rows, "batch int, line_id long, text string"), spark.createDataFrame([(70, "known text of a node!")], "node_id long, text string"))
    want = [(1, None, None, "created"), (2, None, 1, "repeated"), (3, None, 1, "repeated"), (4, None, None, "created"), (5, None, None, "created"), (6, 70, None, "merged"), (7, None, 1, "repeated"), (8, None, 1, "repeated"), (9, None, None, "created"), (10, None, None, "created")]
    assert sorted(map(tuple, got.collect())) == want


def test_rarest_pieces():
    """The least cost of disjoint pieces, against trying all."""
    from itertools import combinations

    import numpy as np

    from cueline.operators.edit_join import rarest_pieces

    rng = np.random.default_rng(3)
    for size, most, n in ((2, 3, 9), (3, 2, 8), (1, 4, 6)):
        costs = rng.integers(1, 20, (5, n - size + 1)).astype(float)
        costs[0, -1:] = np.inf
        wanted = np.array([most, most, most - 1, 1, most])
        for row, places, m in zip(costs, rarest_pieces(costs, size, wanted), wanted, strict=True):
            assert len(places) == m and all(b - a >= size for a, b in zip(places, places[1:]))
            assert sum(row[places]) == min(sum(row[list(c)]) for c in combinations(range(len(row)), m) if all(b - a >= size for a, b in zip(c, c[1:])))


def test_term_counts_of_long_texts(spark):
    """Time that grows with a text's length and not with its square."""
    import time

    from cueline.operators.quality import tfidf_scores

    took = {}
    for n in (2_000, 8_000, 32_000):
        rows = spark.createDataFrame([(k, " ".join(f"word{chr(97 + (i * 7 + k) % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(n))) for k in range(4)], "line_id long, en_text string")
        began = time.perf_counter()
        assert tfidf_scores(rows).count() == 4
        took[n] = time.perf_counter() - began
    assert took[32_000] < 4 * took[8_000] + 3


def test_share_enough():
    """No pair within the bound is left out, and of texts of the same letters few stay."""
    from cueline.operators.edit_join import most_edits, share_enough

    rng = random.Random(5)
    xs = ["".join(rng.choices("abc é", k=rng.randrange(0, 300))) for _ in range(400)]
    ys = []
    for x in xs:
        edited = list(x)
        for _ in range(rng.randrange(most_edits(max(1, len(x)), 0.15) + 1)):
            k = rng.randrange(len(edited) + 1)
            edited[k : k + rng.randrange(2)] = rng.choice(["x", "a", ""])
        ys.append("".join(edited))
    bounds = lambda a, b: np.array([most_edits(max(1, len(x), len(y)), 0.15) for x, y in zip(a, b, strict=True)])
    wide = np.maximum(bounds(xs, ys), bounds(xs, xs))  # as many edits as were made, where these left a shorter text
    assert share_enough(xs, ys, wide).all() and share_enough(ys, xs, wide).all()
    words = ["".join(rng.choices("abcdefghijklmno", k=6)) for _ in range(1000)]
    a, b = ([" ".join(rng.choices(words, k=60)) for _ in range(300)] for _ in range(2))
    assert share_enough(a, b, bounds(a, b)).mean() < 0.02 and share_enough([], [], np.array([], int)).size == 0


def test_near_each_other(spark):
    """A table with itself: each two texts are a candidate once, and the pairs are those of two tables."""
    from cueline.operators.edit_join import met
    from cueline.workers import stored

    rng = random.Random(9)
    base = ["".join(rng.choices("abcd e", k=rng.randrange(1, 60))) for _ in range(60)]
    texts = sorted({"".join(c if rng.random() > 0.06 else rng.choice("xy") for c in rng.choice(base)) for _ in range(200)} | {""})
    rows = stored(spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "batch int, id long, text string"))
    found = [tuple(sorted((r.long_id, r.short_id))) for r in met(rows, rows, ["batch"], own=True).collect()]
    assert len(found) == len(set(found)) and all(a != b for a, b in found)
    got = sorted((r.x_id, r.y_id) for r in D.near_each_other(rows, ["batch"]).collect())
    want = sorted((r.x_id, r.y_id) for r in D.near_texts(rows, rows, ["batch"]).collect())
    slow = rows.alias("a").join(rows.alias("b"), "batch").where(X.edit_distance(F.col("a.text"), F.col("b.text")) < 0.15).select(F.col("a.id"), F.col("b.id"))
    assert got == want == sorted(map(tuple, slow.collect())) and len(got) > len(texts) + 20


def test_top_pairs():
    """The k highest of each row with ties to the lower name, as sorting all products gives them, with copies and vectors that differ by less than single precision."""
    rng = np.random.default_rng(7)
    for copies, near, k, size in ((0, 0, 5, 400), (150, 0, 4, 400), (0, 40, 3, 400), (3, 300, 700, 400), (90, 20, 16, 1100)):
        n = rng.normal(size=(size, 16))
        n[:copies] = n[0]
        n[50 : 50 + near] = n[50] + rng.normal(size=(len(n[50 : 50 + near]), 16)) * 1e-8
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        q, names = np.concatenate([n[:60], -n[:5], np.zeros((1, 16)), np.full((1, 16), np.nan)]), rng.permutation(size)
        scores = np.round(np.stack([(n * x).sum(1) for x in q]), 12)
        order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
        rows, columns, found = V.top_pairs(q, n, names, k)
        assert {(int(r), int(names[c])) for r, c in zip(rows, columns)} == {(r, int(c)) for r in range(len(q)) for c in names[order[r]]} and len(rows) == order.size
        assert np.allclose(found, scores[rows, columns], equal_nan=True)


def test_pieces_that_are_nowhere():
    """Texts whose pieces no other text has choose none, and what others have is still chosen."""
    from cueline.operators.edit_join import SLOTS, _slots, choose, codes, piece_hashes

    counts = np.zeros(SLOTS, np.int32)
    texts = [codes("the quick brown fox jumps over the lazy dog while seven old wizards brew a mighty potion and judge my vow of black quartz"), codes("something else that nobody has said before now")]
    counts[_slots(piece_hashes(texts[0], 6))] = 2
    assert [k for k, *_ in choose(texts, counts, 0.15)] == [0]
    few = np.zeros(SLOTS, np.int32)
    few[_slots(piece_hashes(texts[0][:90], 6))] = 1
    (_, edits, places, hashes), = choose(texts[:1], few, 0.15)
    assert 0 < len(places) < edits + 1 and (few[_slots(hashes)] > 0).all()


def test_nodes_are_read_once(spark):
    """A batch is held against its nodes several times, and these are computed once."""
    from cueline.operators import lifecycle as M

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    nodes = spark.createDataFrame([(k, f"node number {k} says so", [float(k), 1.0]) for k in range(7)], "node_id long, t string, embedding array<float>")
    nodes = nodes.select("node_id", counted.asNondeterministic()("t").alias("text"), "embedding", F.lit(True).alias("is_active"), F.lit(None).cast("long").alias("subtitle_id"))
    lines = spark.createDataFrame([(k, f"I really think we should go home now {k}", 9, "s", "e", float(k), [1.0, float(k)]) for k in range(9)], "line_id long, text string, word_count long, show_name string, episode string, start_time double, embedding array<float>")
    assert M.ingest(lines, nodes).count() == 9 and calls.value == 7
    gated = lines.withColumn("filter_status", F.lit("passed"))
    assert M.sync_episode(gated, nodes).count() == 9 and calls.value == 14
