"""Index versions, vector bytes, caption intake, and folds and comparisons against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import clips, folds, vectors
from cueline.sources import captions, index


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "node_id long, embedding array<float>")
    assert index.save_index(rows, path) == 1
    assert [r.node_id for r in index.load_index(spark, path).collect()] == [1]
    broken = rows.withColumn("embedding", vectors.checked(F.col("embedding"), 3))
    with pytest.raises(Exception, match="a vector of 3 numbers"):
        index.save_index(broken, path)
    assert index.load_index(spark, path).count() == 1, "a write that fails leaves the version before"
    assert index.save_index(rows.fillna(0).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))), path) == 2
    assert index.load_index(spark, path).count() == 2


def test_vector_bytes(spark):
    rows = spark.createDataFrame([(1, [0.5, -2.0, 3.25]), (2, None)], "id int, v array<float>")
    packed = rows.withColumn("b", vectors.to_bytes(F.col("v"), 3)).withColumn("again", vectors.from_bytes(F.col("b"), 3))
    got = {r.id: r for r in packed.collect()}
    assert bytes(got[1].b) == np.array([0.5, -2.0, 3.25], "<f4").tobytes() and got[1].again == [0.5, -2.0, 3.25] and got[2].again is None
    for wrong in (vectors.to_bytes(F.col("v"), 4), vectors.from_bytes(F.lit(b"12345678"), 3)):
        with pytest.raises(Exception, match="was expected"):
            rows.select(wrong).collect()


def test_other_files_are_errors(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello there\n\n2\n00:00:02,100 --> 00:00:03,000\nand on it goes.\n")
    stats = captions.merge_stats(captions.read_subtitles(spark, str(tmp_path))).first()
    assert (stats.before, stats.after, stats.merged) == (2, 1, 1)
    (tmp_path / "b.vtt").write_text("WEBVTT\n")
    (tmp_path / "c.txt").write_text("no")
    for path in (tmp_path, tmp_path / "b.vtt"):
        with pytest.raises(ValueError, match="b.vtt"):
            captions.read_subtitles(spark, str(path))
    with pytest.raises(ValueError, match="c.txt"):
        captions.read_subtitles(spark, str(tmp_path / "c.txt"))


def test_stretches_do_not_change_merges(spark, monkeypatch):
    rng = random.Random(7)
    say = ["go on...", "- and then", "it ends.", "so we", "We went and", "you see,", "", None, "Stop!"]
    rows, at = [], 0.0
    for n in range(400):
        at += rng.choice([0.2, 0.5, 1.5])
        rows.append(("a" if n < 350 else "b", n, at, at + 0.3, rng.choice(say), rng.choice(["", "zh"]), [rng.random(), rng.random()] if n % 3 else None))
        at += 0.3
    table = spark.createDataFrame(rows, "file string, n long, start_time double, end_time double, en_text string, zh_text string, embedding array<double>")
    plain = []
    for f in "ab":
        given = [{"n": r[1], "start_time": r[2], "end_time": r[3], "en_text": r[4] or "", "zh_text": r[5], "embedding": r[6]} for r in rows if r[0] == f]
        plain += [(f, r["n"], r["en_text"], r["zh_text"], r["parts"]) for r in folds.merge_rows(given, 1.0, vectors=True)]
    for size in (3, 4096):
        monkeypatch.setattr(folds, "STRETCH", size)
        got = folds.merge_lines(table, ["file"], ["n"], gap=1.0, vectors=True).collect()
        assert sorted((r.file, r.n, r.en_text, r.zh_text, r.parts) for r in got) == plain


def test_closest_segments(spark):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choices(["it's", "Go", "home,", "now", "we", "wait"], k=rng.randrange(0, 6)))
    segments = [("s", f"E{n % 2}", n, say(), float(n), n + 0.5) for n in range(40)]
    nodes = [("s", f"E{n % 3}", n, say()) for n in range(9)]
    got = clips.closest_segments(spark.createDataFrame(nodes, "show_name string, episode string, node_id long, en_text string"), spark.createDataFrame(segments, "show_name string, episode string, seq_index long, text string, start_time double, end_time double"), 3)

    def norm(t):
        return " ".join(re.sub(r"[^\w\s']", " ", t.lower()).split())

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    want = []
    for _, episode, node, text in nodes:
        best = sorted((-round(ratio(norm(text), norm(s[3])), 9), s[2]) for s in segments if s[1] == episode)[:3]
        want += [(node, seq, k + 1, -r) for k, (r, seq) in enumerate(best)]
    assert sorted((r.node_id, r.seq_index, r["rank"], round(r.similarity, 9)) for r in got.collect()) == sorted(want)


def test_caption_source(spark, tmp_path):
    """Files show at commit only; what failed or was aborted is not read; encodings and kinds as asked."""
    from cueline.sources.caption_source import register

    register(spark)
    folder = str(tmp_path / "captions")
    rows = spark.createDataFrame([(f"{k}.{kind}", f"{kind} {k} é") for k in range(7) for kind in ("srt", "VTT", "ass", "ssa")], "file string, text string").repartition(3)
    rows.write.format("captions").mode("append").save(folder)
    read = lambda **o: sorted((r.file.rsplit("/", 1)[1], r.kind, r.text) for r in spark.read.format("captions").options(**o).load(folder).collect())
    want = sorted((f"{k}.{x}", {"VTT": "vtt", "ssa": "ass"}.get(x, x), f"{x} {k} é") for k in range(7) for x in ("srt", "VTT", "ass", "ssa"))
    assert read() == want and read(kinds="ass") == [x for x in want if x[1] == "ass"]
    assert spark.read.format("captions").option("partitionBytes", 20).load(folder).rdd.getNumPartitions() > 5
    assert {t for _, _, t in read(encoding="ascii", kinds="srt")} == {f"srt {k} ��" for k in range(7)}

    bad = spark.createDataFrame([(f"new{k}.srt", "x") for k in range(5)] + [("none.txt", "y")], "file string, text string").repartition(4)
    with pytest.raises(Exception, match="none.txt"):
        bad.write.format("captions").mode("append").save(folder)
    assert read() == want  # a part that was written before is not named anywhere
    spark.createDataFrame([("only.srt", None)], "file string, text string").write.format("captions").mode("overwrite").save(folder)
    assert read() == [("only.srt", "srt", "")]
    loose = tmp_path / "loose"
    (loose / "deep").mkdir(parents=True)
    (loose / "deep" / "b.srt").write_bytes("naïve café".encode("cp1252"))
    (loose / "c.txt").write_text("no")
    assert [(r.kind, r.text) for r in spark.read.format("captions").load(str(loose)).collect()] == [("srt", "naïve café")]


def test_ass_groups_without_a_call_a_file(spark):
    """Events of many files, dealt over several tasks and Arrow batches, are grouped within their file, and no file costs a call of Python."""
    from cueline.sources.captions import parse_ass

    clock = lambda ms: f"0:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms // 10 % 100:02d}"
    starts = {f"f{k}": [(i * (37 + k)) % 700 * 10 for i in range(3 + k * 11 % 50)] for k in range(40)} | {None: [0, 50, 100, 300]}
    rows = [(f, "".join(f"Dialogue: 0,{clock(t)},{clock(t + 2000)},Default,,0,0,0,,line {i}\n" for i, t in enumerate(ts))) for f, ts in starts.items()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = parse_ass(spark.createDataFrame(rows, "file string, text string").repartition(5))
        plan = out._jdf.queryExecution().analyzed().toString()
        got = sorted(((str(r.file), r.block, r.en_text) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in plan
    want = []
    for f, ts in starts.items():
        blocks = []
        for t, i in sorted((t, i) for i, t in enumerate(ts)):
            if not blocks or t / 1000 - blocks[-1][0] >= 0.1:
                blocks.append((t / 1000, []))
            blocks[-1][1].append(f"line {i}")
        want += [(str(f), k, " ".join(texts)) for k, (_, texts) in enumerate(blocks)]
    assert got == sorted(want)
