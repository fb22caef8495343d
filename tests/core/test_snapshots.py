"""Tables that change together, the index that grows, and repairs at the edges."""

import random

import pytest
from pyspark.sql import functions as F

from cueline.operators import maintenance as R
from cueline.operators import services
from cueline.operators.vectors import nearest
from cueline.sources import segments as I
from cueline.sources import snapshots as S


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string")


def content(spark, path, name, version=None):
    return sorted((r.id, r.name) for r in S.read_table(spark, path, name, version).collect())


def folders(tmp_path):
    return sorted(x.name for t in tmp_path.iterdir() if t.name != "manifests" for x in t.iterdir())


def test_versions(spark, tmp_path):
    path = str(tmp_path)
    assert S.versions(spark, path) == [] and S.last_version(spark, f"{path}/none") == 0 and S.manifest(spark, path) == {}
    a, b = table(spark, (1, "a"), (2, None)), table(spark, (3, "b"))
    assert S.commit(spark, path, {"a": a, "b": b}, 0) == 1
    assert S.commit(spark, path, {"b": b.where(F.lit(False))}, 1, {"a": b}) == 2
    assert content(spark, path, "a") == [(1, "a"), (2, None), (3, "b")] and content(spark, path, "b") == []
    assert content(spark, path, "a", 1) == [(1, "a"), (2, None)] and content(spark, path, "b", 1) == [(3, "b")]
    # a table made of what it was
    assert S.commit(spark, path, {"a": S.read_table(spark, path, "a").where("id > 1")}, 2) == 3
    assert content(spark, path, "a") == [(2, None), (3, "b")]
    with pytest.raises(KeyError):
        S.read_table(spark, path, "c")
    assert S.restore(spark, path, 1, 3) == 4 and content(spark, path, "b") == [(3, "b")]
    assert S.drop_versions(spark, path, 2) == 1 and S.versions(spark, path) == [3, 4]
    assert content(spark, path, "a", 3) == [(2, None), (3, "b")] and content(spark, path, "a") == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        S.drop_versions(spark, path, 0)


def test_failures_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    S.commit(spark, path, {"a": table(spark, (1, "a")), "b": table(spark, (2, "b"))}, 0)
    there = folders(tmp_path)
    broken = table(spark, (5, "x")).withColumn("name", F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        S.commit(spark, path, {"a": table(spark, (9, "new")), "b": broken}, 1)
    assert S.versions(spark, path) == [1] and content(spark, path, "a") == [(1, "a")] and folders(tmp_path) == there
    with pytest.raises(ValueError, match="other columns"):
        S.commit(spark, path, {}, 1, {"a": table(spark, (1, "a")).withColumn("more", F.lit(1))})
    assert folders(tmp_path) == there


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    S.commit(spark, path, {"a": table(spark, (1, "a"))}, 0)
    S.commit(spark, path, {"a": table(spark, (2, "first"))}, 1)
    there = folders(tmp_path)
    with pytest.raises(S.Conflict):
        S.commit(spark, path, {"a": table(spark, (3, "late"))}, 1)
    # the other writer switches while this one writes
    monkeypatch.setattr(S, "last_version", lambda *_: 1)
    with pytest.raises(S.Conflict):
        S.commit(spark, path, {"a": table(spark, (3, "late"))}, 1)
    monkeypatch.undo()
    assert content(spark, path, "a") == [(2, "first")] and folders(tmp_path) == there
    assert sorted(x.name for x in (tmp_path / "manifests").iterdir() if not x.name.endswith(".crc")) == ["000000000001.json", "000000000002.json"]


def test_index_against_a_dict(spark, tmp_path):
    """A hundred changes by chance, held against a plain dictionary."""
    rng, path, want = random.Random(5), str(tmp_path), {}
    vectors = lambda ids: {n: [rng.uniform(-1, 1) for _ in range(4)] for n in ids}
    rows = lambda d: spark.createDataFrame([(n, v) for n, v in d.items()], "node_id long, embedding array<float>")
    want.update(vectors(range(12)))
    I.create_index(rows(want), path)
    for _ in range(6):
        new = vectors(rng.sample(range(20), 5))
        I.add_vectors(rows(new), path)
        want.update(new)
        out = rng.sample(range(25), 4)
        I.retire(spark.createDataFrame([(n,) for n in [*out, out[0], None]], "node_id long"), path)
        want = {n: v for n, v in want.items() if n not in out}
    got = {r.node_id: r.embedding for r in I.indexed(spark, path).collect()}
    near = lambda a, b: all(abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True))
    assert got.keys() == want.keys() and all(near(got[n], want[n]) for n in got)
    total = 12 + 6 * 5
    assert I.dead_share(spark, path) == pytest.approx(1 - len(want) / total)
    before = S.last_version(spark, path)
    asked = rows({0: [1.0, 0.5, 0.0, 0.2]}).withColumnRenamed("node_id", "query_id")
    hits = lambda v: [(r.node_id, round(r.similarity, 6)) for r in nearest(asked, I.indexed(spark, path, v), 3).orderBy("rank").collect()]
    assert I.compact(spark, path) == before + 1 and I.dead_share(spark, path) == 0.0
    assert {r.node_id for r in I.indexed(spark, path).collect()} == want.keys() == {r.node_id for r in I.indexed(spark, path, before).collect()}
    assert len(S.manifest(spark, path)[I.VECTORS]["folders"]) == 1
    assert hits(before) == hits(before + 1) and len(hits(before)) == 3


def test_sync_of_an_index(spark, tmp_path):
    path = str(tmp_path)
    nodes = spark.createDataFrame([(n, [float(n), 1.0], n % 10 != 3) for n in range(40)] + [(90, None, True), (91, [1.0, 1.0], None)], "node_id long, embedding array<float>, is_active boolean")
    active = {n for n in range(40) if n % 10 != 3}
    ids = lambda: {r.node_id for r in I.indexed(spark, path).collect()}
    assert I.sync_index(nodes, path) == 1 and ids() == active
    assert I.sync_index(nodes, path) == 2 and ids() == active, "nothing to do"
    one_less = nodes.withColumn("is_active", F.col("is_active") & (F.col("node_id") != 7))
    assert I.sync_index(one_less, path) == 3 and ids() == active - {7} and I.dead_share(spark, path) == pytest.approx(1 / 36), "few dead rows stay"
    assert I.sync_index(nodes, path) == 4 and ids() == active, "one that comes back"
    fewer = nodes.withColumn("is_active", F.col("is_active") & (F.col("node_id") > 9))
    assert I.sync_index(fewer, path) == 6 and ids() == {n for n in active if n > 9} and I.dead_share(spark, path) == 0.0, "compacted"
    assert I.sync_index(nodes.where(F.lit(False)), path, full=True) == 7 and ids() == set() and I.dead_share(spark, path) == 0.0
    assert I.sync_index(nodes, path) == 8 and ids() == active


def node_rows(spark):
    rows = [(1, "s", "e1", "one two", 0, "daily", "rule", None, True), (2, "s", "e2", None, None, "work", "ai", "promising", True), (3, "t", None, "x y z", 3, "work", "rule", None, False), (4, None, "", "", 0, "work", None, None, None)]
    return spark.createDataFrame([(*r[:6], "neutral", "beginner", ["k"], *r[6:]) for r in rows], "node_id long, show_name string, episode string, en_text string, word_count int, scene string, emotion string, difficulty string, keywords array<string>, tag_source string, speech_act string, is_active boolean")


def test_scope_of_tags(spark):
    asked = lambda texts, before: '[{"scene": "romance", "speech_act": "warning"}, {"scene": "romance"}]'
    nodes = node_rows(spark)
    hit = lambda t: {r.node_id for r in t.where("scene = 'romance'").collect()}
    assert hit(R.retag_nodes(nodes, {"m": asked})) == {1, 3}
    assert hit(R.retag_nodes(nodes, {"m": asked}, show="s", only_rule=False)) == {1, 2}
    assert hit(R.retag_nodes(nodes, {"m": asked}, show="s", episode="e2", only_rule=False)) == {2}
    assert hit(R.retag_nodes(nodes, {"m": asked}, show="", only_rule=False)) == {1, 2, 3, 4}
    assert hit(R.retag_nodes(nodes, {"m": asked}, show="none")) == set()
    by_rule = {r.node_id: (r.scene, r.difficulty, r.tag_source) for r in R.retag_nodes(nodes, {}).collect()}
    assert by_rule == {1: ("daily", "beginner", "rule"), 2: ("work", "beginner", "ai"), 3: ("daily", "beginner", "rule"), 4: ("work", "beginner", None)}
    acts = lambda **how: {r.node_id: r.speech_act for r in R.fill_speech_acts(nodes, {"m": asked}, **how).collect()}
    assert acts() == {1: "warning", 2: "promising", 3: None, 4: None}
    assert acts(everything=True) == {1: "warning", 2: "warning", 3: None, 4: None} and acts(show="t") == {1: None, 2: "promising", 3: None, 4: None}


def test_only_missing_vectors(spark):
    seen = []
    rows = [(1, "Ab ", None, [9.0]), (2, "kept", [5.0, 5.0], None), (3, "", None, None), (4, None, None, [1.0]), (5, "  ", None, None)]
    nodes = spark.createDataFrame(rows, "node_id long, zh_text string, zh_embedding array<float>, embedding array<float>")
    got = R.fill_zh_vectors(nodes, lambda texts: [[float(len(t)), float(t == t.lower())] for t in texts], 2)
    assert got.columns == nodes.columns and not seen
    assert {r.node_id: (r.zh_embedding, r.embedding) for r in got.collect()} == {1: ([2.0, 1.0], [9.0]), 2: ([5.0, 5.0], None), 3: (None, None), 4: (None, [1.0]), 5: ([0.0, 0.0], None)}


def test_durations(spark):
    rows = [(1, "matched", "/media/a/media/x.mp4", 2.0), (2, "matched", "media/b", 2.0), (3, "failed", "/media/c", None), (4, "matched", "", None), (5, None, "/media/d", 1.0), (6, "matched", None, 1.0), (7, "matched", "///gone", None), (8, "matched", "/media/e", None)]
    clips = spark.createDataFrame(rows, "clip_id long, clip_status string, stream_url string, duration double")
    known = {"a/media/x.mp4": 2.204, "b": 2.05, "e": 7.777}
    got = R.fill_durations(clips, known.__getitem__)
    assert [(r.clip_id, r.duration, r.probed) for r in got.orderBy("clip_id").collect()] == [(1, 2.2, "updated"), (2, 2.0, "kept"), (3, None, None), (4, None, None), (5, 1.0, None), (6, 1.0, None), (7, None, "skipped"), (8, 7.78, "updated")]
    assert R.duration_counts(got).first().asDict()["total"] == 4
    assert R.fill_durations(clips.limit(0), known.get).count() == 0


def test_videos_that_are_meant(spark):
    videos = spark.createDataFrame([(3, "s", "e1"), (2, "s", "e2"), (5, "s", "e1"), (1, None, "e1")], "video_id long, show_name string, episode string")
    asked = spark.createDataFrame([("s", "e1"), ("s", "e9"), ("s", None), ("s", ""), ("t", "e1"), ("s", "e1")], "show_name string, episode string")
    found = lambda by_show: {(r.show_name, r.asked): (r.video_id, r.episode) for r in R.videos_of(asked, videos, by_show).collect()}
    assert found(True) == {("s", "e1"): (3, "e1"), ("s", "e9"): (2, "e2"), ("s", ""): (2, "e2"), ("t", "e1"): (None, None)}
    assert found(False) == {("s", "e1"): (3, "e1"), ("s", "e9"): (None, None), ("s", ""): (None, None), ("t", "e1"): (None, None)}


def test_queries_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"

    def note(text):
        with log.open("a") as f:
            f.write("x")
        return {"a": "'A'", "b": None, "": '""'}[text]

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "query_id long, text string")
    got = services.expand_queries(queries, note)
    assert {r.query_id: (r.expanded_zh, r.candidate_en) for r in got.collect()} == {1: ("a", ["A"]), 2: ("b", []), 3: ("a", ["A"]), 4: ("", []), 5: ("", [])}
    assert len(log.read_text()) == 3
    long = services.expand_queries(queries.limit(1), None, lambda text: '{"expanded_zh": "' + "w" * 500 + '", "candidate_en": "not a list"}').first()
    assert (long.expanded_zh, long.candidate_en) == ("w" * 120, [])
    ready = services.encode_queries(services.expand_queries(queries, None, lambda text: '{"candidate_en": ["one", "three"]}' if text == "a" else "{}"), lambda texts: [[float(len(t))] for t in texts], 1)
    assert {r.query_id: (r.embedding, r.candidates) for r in ready.collect()} == {1: ([1.0], [[3.0], [5.0]]), 2: ([1.0], []), 3: ([1.0], [[3.0], [5.0]]), 4: ([0.0], []), 5: ([0.0], [])}
