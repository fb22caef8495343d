"""Queries of nearest-in-time joins, clip planning and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.operators import clips as C
from cueline.operators import folds as O
from cueline.operators import reports as R
from cueline.plans.base import NEEDS, VIEWS, lines, literal, nodes, query, segments, sql_values, table, values

# Lines of even documents stand for one language, those of the next document for the other.
VIEWS["pairs"] = "SELECT a.doc_id AS file, a.line_id, a.start_time, b.start_time AS other_start, b.en_text AS other_text, abs(b.start_time - a.start_time) AS off FROM lines a JOIN lines b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0"
NEEDS["pairs"] = ("lines0", "lines")


def _sides(spark, sf_dir):
    rows = lines(spark, sf_dir)
    en = rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "file")
    zh = rows.where("doc_id % 2 = 1").withColumn("file", F.col("doc_id") - 1)
    return en, zh


@query(
    "bilingual_nearest",
    """
    WITH b AS (SELECT line_id, other_text FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY off, other_start, other_text) AS r FROM pairs WHERE off <= 0.5) WHERE r = 1)
    SELECT line_id, md5(coalesce(other_text, '')) AS zh FROM lines LEFT JOIN b USING (line_id) WHERE doc_id % 2 = 0
    """,
    ("pairs",),
)
def bilingual_nearest(spark, sf_dir):
    en, zh = _sides(spark, sf_dir)
    out = C.bilingual_nearest(en.withColumn("zh_text", F.lit(None).cast("string")), zh.select("file", "start_time", F.col("en_text").alias("text")), ["file"])
    return out.select("line_id", F.md5(F.coalesce("zh_text", F.lit(""))).alias("zh"))


VIEWS["en"] = "SELECT doc_id AS file, pos AS idx, CAST(round(start_time * 1000) AS BIGINT) AS start_ms, CAST(round(end_time * 1000) AS BIGINT) AS end_ms, en_text AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE doc_id % 2 = 0"
VIEWS["zh"] = "SELECT doc_id - 1 AS file, pos AS idx, CAST(round(start_time * 1000) AS BIGINT) AS zs, CAST(round(end_time * 1000) AS BIGINT) AS ze, en_text AS zt, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY doc_id) AS m FROM lines WHERE doc_id % 2 = 1"
NEEDS["en"] = NEEDS["zh"] = ("lines0", "lines")


@query(
    "caption_alignment",
    """
    WITH s AS (SELECT file, max(m) AS m FROM zh GROUP BY file), e AS (SELECT en.*, n = coalesce(m, 0) AS same FROM en LEFT JOIN s USING (file)),
    p AS (SELECT e.file, e.idx, zt FROM e JOIN zh USING (file, place) WHERE same),
    h AS (SELECT file, idx, zt FROM (SELECT e.file, e.idx, zt, row_number() OVER (PARTITION BY e.file, e.idx ORDER BY zh.place) AS r FROM e JOIN zh USING (file) WHERE NOT same AND zs <= start_ms AND start_ms <= ze) WHERE r = 1),
    d AS (SELECT file, idx, zt FROM (SELECT e.file, e.idx, zt, row_number() OVER (PARTITION BY e.file, e.idx ORDER BY abs(zs - start_ms), zh.place) AS r FROM e JOIN zh USING (file) WHERE NOT same AND abs(zs - start_ms) <= 2000) WHERE r = 1)
    SELECT file, idx, md5(CASE WHEN same THEN p.zt WHEN coalesce(h.zt, '') <> '' THEN h.zt ELSE coalesce(d.zt, '') END) AS zh FROM e LEFT JOIN p USING (file, idx) LEFT JOIN h USING (file, idx) LEFT JOIN d USING (file, idx)
    """,
    ("en", "zh"),
)
def caption_alignment(spark, sf_dir):
    en, zh = _sides(spark, sf_dir)
    ms = lambda t: t.select("file", F.col("pos").alias("idx"), F.round(F.col("start_time") * 1000).cast("long").alias("start_ms"), F.round(F.col("end_time") * 1000).cast("long").alias("end_ms"), F.col("en_text").alias("text"))
    return C.caption_alignment(ms(en), ms(zh), ["file"]).select("file", F.col("idx").cast("long").alias("idx"), F.md5("zh_text").alias("zh"))


# Nodes of an episode: every third turn, at a time that is a little off.
VIEWS["targets"] = "SELECT show_name, episode, seq_index AS k, CAST(substr(show_name, 2) AS BIGINT) * 1000 + seq_index AS node_id, text AS en_text, start_time + (seq_index % 5) * 0.4 AS start_time, end_time + (seq_index % 4) * 0.3 AS end_time FROM segments WHERE length(text) > 0"
NEEDS["targets"] = ("segments",)


def _targets(spark, sf_dir):
    s = segments(spark, sf_dir).where("length(text) > 0")
    return s.select("show_name", "episode", (F.substring("show_name", 2, 20).cast("long") * 1000 + F.col("seq_index")).alias("node_id"), F.col("text").alias("en_text"), (F.col("start_time") + (F.col("seq_index") % 5) * F.lit(0.4)).alias("start_time"), (F.col("end_time") + (F.col("seq_index") % 4) * F.lit(0.3)).alias("end_time"))


@query("window_candidates", "SELECT node_id, s.seq_index FROM targets t JOIN segments s USING (show_name, episode) WHERE s.start_time < t.start_time + 30 AND s.end_time > greatest(0, t.start_time - 30)", ("targets",))
def window_candidates(spark, sf_dir):
    return C.window_candidates(_targets(spark, sf_dir), segments(spark, sf_dir)).select("node_id", "seq_index")


ALIGN_SEGMENTS = [("Show", "E01", 0, "Hello there my friend", 10.0, 12.0), ("Show", "E01", 1, "I have been waiting for you", 13.0, 15.0), ("Show", "E01", 2, "Let us go home now", 16.0, 18.0), ("Show", "E01", 3, "Goodbye and good luck", 19.0, 21.0)]
ALIGN_NODES = [("Show", "E01", 101, "Hello there my friend", 10.5, 12.5), ("Show", "E01", 102, "I've been waiting for you", 13.2, 15.0), ("Show", "E01", 103, "Let us go home right now", 16.4, 18.0), ("Show", "E01", 104, "Hi", 19.0, 20.0), ("Show", "E02", 105, "no episode", 1.0, 2.0)]


@query("align_cases", f"SELECT node_id, seq_index, whisper_start, confidence, align_step FROM {sql_values([(101, 0, 10.0, 1.0, 'seq'), (102, 1, 13.0, 1.0, 'seq'), (103, 2, 16.0, 0.8571, 'seq')], 'node_id, seq_index, whisper_start, confidence, align_step')}")
def align_cases(spark, sf_dir):
    s = values(spark, ALIGN_SEGMENTS, "show_name string, episode string, seq_index long, text string, start_time double, end_time double")
    n = values(spark, ALIGN_NODES, "show_name string, episode string, node_id int, en_text string, start_time double, end_time double")
    out = C.align(n.withColumn("node_id", F.col("node_id").cast("long")), s)
    return out.select(F.col("node_id").cast("int").alias("node_id"), F.col("seq_index").cast("int").alias("seq_index"), "whisper_start", "confidence", "align_step")


@query("greedy_align")
def greedy_align(spark, sf_dir):
    return C.align(_targets(spark, sf_dir), segments(spark, sf_dir))


@query("plan_clips")
def plan_clips(spark, sf_dir):
    return C.plan_clips(_targets(spark, sf_dir), segments(spark, sf_dir))


@query("clip_outcomes")
def clip_outcomes(spark, sf_dir):
    return C.outcome_counts(C.plan_clips(_targets(spark, sf_dir), segments(spark, sf_dir)))


GATES = [(0, 0.0, 5.0, 0.95), (1, 0.0, 5.0, 0.85), (2, 0.0, 5.0, 0.84), (3, 0.0, 5.0, 0.60), (4, 0.0, 5.0, 0.59), (5, 0.0, 20.0, 0.9), (6, 5.0, 4.0, 0.9), (7, 0.0, 13.5, 0.7)]


@query("clip_gates", "SELECT id, CASE WHEN e - s + 1.5::DOUBLE > 15 THEN 'failed_long' WHEN e - s + 1.5::DOUBLE < 1 THEN 'failed_short' WHEN c >= 0.6::DOUBLE THEN 'job' ELSE 'unmatched' END AS outcome FROM " + sql_values(GATES, "id, s, e, c"))
def clip_gates(spark, sf_dir):
    return C.gate_alignments(values(spark, GATES, "id int, whisper_start double, whisper_end double, confidence double")).select("id", "outcome")


# Orders as alignments: times and confidence from their numbers.
VIEWS["alignments"] = "SELECT o_orderkey AS node_id, CAST(o_orderkey % 1000 AS DOUBLE) AS s, CAST(o_orderkey % 1000 AS DOUBLE) + CAST(o_custkey % 80 AS DOUBLE) / 4 - 1 AS e, CAST(o_custkey % 101 AS DOUBLE) / 100 AS c FROM orders"
VIEWS["gated_alignments"] = "SELECT *, CASE WHEN e - s + 1.5::DOUBLE > 15 THEN 'failed_long' WHEN e - s + 1.5::DOUBLE < 1 THEN 'failed_short' WHEN c >= 0.6::DOUBLE THEN 'job' ELSE 'unmatched' END AS outcome FROM alignments"
NEEDS["gated_alignments"] = ("alignments",)


def _gated_alignments(spark, sf_dir):
    start = (F.col("o_orderkey") % 1000).cast("double")
    end = start + (F.col("o_custkey") % 80).cast("double") / 4 - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), start.alias("whisper_start"), end.alias("whisper_end"), ((F.col("o_custkey") % 101).cast("double") / 100).alias("confidence"))
    return C.gate_alignments(rows)


@query("failed_records", "SELECT node_id, s AS whisper_start, e AS whisper_end, c AS confidence, 'failed' AS clip_status, FALSE AS is_active FROM gated_alignments WHERE outcome = 'failed_long'", ("gated_alignments",))
def failed_records(spark, sf_dir):
    return C.failed_records(_gated_alignments(spark, sf_dir))


@query("gate_counts", "SELECT count_if(outcome = 'job') AS jobs, count_if(outcome IN ('failed_long', 'failed_short')) AS failed, count_if(outcome = 'unmatched') AS unmatched FROM gated_alignments", ("gated_alignments",))
def gate_counts(spark, sf_dir):
    return C.gate_counts(_gated_alignments(spark, sf_dir))


def _spans(spark, sf_dir):
    return _targets(spark, sf_dir).withColumnRenamed("node_id", "clip_key")


ANCHOR = """
    a AS (SELECT node_id, value FROM (SELECT t.node_id, s.start_time AS value, row_number() OVER (PARTITION BY t.node_id ORDER BY abs(s.start_time - t.start_time), s.seq_index) AS r FROM targets t JOIN segments s USING (show_name, episode) WHERE abs(s.start_time - t.start_time) < 5) WHERE r = 1),
    z AS (SELECT node_id, value FROM (SELECT t.node_id, s.end_time AS value, row_number() OVER (PARTITION BY t.node_id ORDER BY abs(s.end_time - t.end_time), s.seq_index) AS r FROM targets t JOIN segments s USING (show_name, episode) WHERE abs(s.end_time - t.end_time) < 5) WHERE r = 1),
    anchored AS (SELECT node_id, show_name, episode, CASE WHEN coalesce(z.value, end_time) <= coalesce(a.value, start_time) + 0.2::DOUBLE THEN start_time ELSE coalesce(a.value, start_time) END AS s, CASE WHEN coalesce(z.value, end_time) <= coalesce(a.value, start_time) + 0.2::DOUBLE THEN end_time ELSE coalesce(z.value, end_time) END AS e FROM targets LEFT JOIN a USING (node_id) LEFT JOIN z USING (node_id))"""


@query("anchor_nearest", f"WITH {ANCHOR.strip()} SELECT node_id, round(s, 6) AS s, round(e, 6) AS e FROM anchored", ("targets",))
def anchor_nearest(spark, sf_dir):
    return C.anchor(_spans(spark, sf_dir), segments(spark, sf_dir)).select(F.col("clip_key").alias("node_id"), F.round("anchor_start", 6).alias("s"), F.round("anchor_end", 6).alias("e"))


CONTEXT = """
    b AS (SELECT node_id, bs, be FROM (SELECT t.node_id, s.start_time AS bs, s.end_time AS be, row_number() OVER (PARTITION BY t.node_id ORDER BY s.seq_index DESC) AS r FROM anchored t JOIN segments s USING (show_name, episode) WHERE s.end_time <= t.s + 0.05::DOUBLE) WHERE r = 1),
    f AS (SELECT node_id, fs, fe FROM (SELECT t.node_id, s.start_time AS fs, s.end_time AS fe, row_number() OVER (PARTITION BY t.node_id ORDER BY s.seq_index) AS r FROM anchored t JOIN segments s USING (show_name, episode) WHERE s.start_time >= t.e - 0.05::DOUBLE) WHERE r = 1),
    g AS (SELECT *, CASE WHEN bs IS NOT NULL AND s - be <= 1.5 AND be - bs <= 3.0 AND s - bs <= 6.0 THEN bs ELSE s END AS cs, CASE WHEN fs IS NOT NULL AND fs - e <= 1.5 AND fe - fs <= 3.0 AND fe - e <= 6.0 THEN fe ELSE e END AS ce FROM anchored LEFT JOIN b USING (node_id) LEFT JOIN f USING (node_id)),
    grown AS (SELECT node_id, show_name, episode, s, e, CASE WHEN ce - cs + 0.5::DOUBLE + 1.0::DOUBLE > 15 THEN s ELSE cs END AS ctx_start, CASE WHEN ce - cs + 0.5::DOUBLE + 1.0::DOUBLE > 15 THEN e ELSE ce END AS ctx_end FROM g)"""


def _anchored(spark, sf_dir):
    return C.anchor(_spans(spark, sf_dir), segments(spark, sf_dir)).select("clip_key", "show_name", "episode", F.col("anchor_start").alias("main_start"), F.col("anchor_end").alias("main_end"))


@query("context_window", f"WITH {ANCHOR.strip()}, {CONTEXT.strip()} SELECT node_id, round(ctx_start, 6) AS ctx_start, round(ctx_end, 6) AS ctx_end FROM grown", ("targets",))
def context_window(spark, sf_dir):
    return C.context(_anchored(spark, sf_dir), segments(spark, sf_dir)).select(F.col("clip_key").alias("node_id"), F.round("ctx_start", 6).alias("ctx_start"), F.round("ctx_end", 6).alias("ctx_end"))


MIDS = "mids AS (SELECT show_name, episode, seq_index, (end_time + nxt) / 2.0::DOUBLE AS mid FROM (SELECT *, lead(start_time) OVER (PARTITION BY show_name, episode ORDER BY seq_index) AS nxt FROM segments) WHERE nxt > end_time)"


@query("gap_midpoints", f"WITH {MIDS} SELECT show_name, seq_index, round(mid, 6) AS mid FROM mids", ("segments",))
def gap_midpoints(spark, sf_dir):
    return C.gap_midpoints(segments(spark, sf_dir)).select("show_name", "seq_index", F.round("mid", 6).alias("mid"))


@query(
    "cut_plan",
    f"""WITH {ANCHOR.strip()}, {CONTEXT.strip()}, {MIDS}, p AS (SELECT *, greatest(0.0::DOUBLE, ctx_start - 0.5::DOUBLE) AS rs, ctx_end + 1.0::DOUBLE AS re FROM grown),
    x AS (SELECT node_id, mid FROM (SELECT p.node_id, mid, row_number() OVER (PARTITION BY p.node_id ORDER BY abs(mid - rs), m.seq_index) AS r FROM p JOIN mids m USING (show_name, episode) WHERE abs(mid - rs) BETWEEN 0.3::DOUBLE AND 1.5::DOUBLE) WHERE r = 1),
    y AS (SELECT node_id, mid FROM (SELECT p.node_id, mid, row_number() OVER (PARTITION BY p.node_id ORDER BY abs(mid - re), m.seq_index) AS r FROM p JOIN mids m USING (show_name, episode) WHERE abs(mid - re) BETWEEN 0.3::DOUBLE AND 1.5::DOUBLE) WHERE r = 1),
    c AS (SELECT node_id, rs, re, coalesce(x.mid, rs) AS cs, coalesce(y.mid, re) AS ce FROM p LEFT JOIN x USING (node_id) LEFT JOIN y USING (node_id))
    SELECT node_id, round(CASE WHEN ce <= cs + 0.2::DOUBLE THEN rs ELSE cs END, 6) AS cut_start, round(CASE WHEN ce <= cs + 0.2::DOUBLE THEN re ELSE ce END, 6) AS cut_end FROM c""",
    ("targets",),
)
def cut_plan(spark, sf_dir):
    return C.cut_plan(_anchored(spark, sf_dir), segments(spark, sf_dir)).select(F.col("clip_key").alias("node_id"), F.round("cut_start", 6).alias("cut_start"), F.round("cut_end", 6).alias("cut_end"))


@query("fallback_spans", f"WITH {ANCHOR.strip()} SELECT node_id, round(s, 6) AS s, round(e, 6) AS e, 0.65::DOUBLE AS confidence FROM anchored JOIN targets t USING (node_id) WHERE t.end_time - t.start_time + 0.5::DOUBLE + 1.0::DOUBLE BETWEEN 1 AND 15 AND node_id NOT IN (SELECT node_id FROM targets WHERE k = 1)", ("targets",))
def fallback_spans(spark, sf_dir):
    nodes = _targets(spark, sf_dir)
    planned = nodes.where("node_id % 1000 = 1").select("node_id")
    return C.fallback_spans(nodes, planned, segments(spark, sf_dir)).select(F.col("clip_key").alias("node_id"), F.round("main_start", 6).alias("s"), F.round("main_end", 6).alias("e"), "confidence")


WORDS = r"len(regexp_extract_all({}, '[^ \t\n\x0B\f\r]+'))"
TAIL = r"regexp_replace({}, '[\s\x0B]+$', '')"


@query(
    "merge_segments",
    f"""RECURSIVE
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY show_name ORDER BY seq_index) AS i FROM segments),
    f(show_name, i, first_seq, text, s, e, parts, closed) AS (SELECT show_name, i, seq_index, text, start_time, end_time, 1, FALSE FROM o WHERE i = 1 UNION ALL
      SELECT show_name, i, CASE WHEN m THEN first_seq ELSE seq_index END, CASE WHEN m THEN concat(ct, ' ', nt) ELSE text2 END, CASE WHEN m THEN s ELSE start_time END, end_time, CASE WHEN m THEN parts + 1 ELSE 1 END, NOT m
      FROM (SELECT *, start_time - e <= 1.5 AND end_time - s <= 12 AND w1 + {WORDS.format("nt")} <= 40 AND NOT (regexp_matches(ct, '[.?!]$') OR (ct LIKE '%,' AND w1 >= 8)) AND NOT (regexp_matches(ct, '\\p{{Ll}}$') AND regexp_matches(nt, '^\\p{{Lu}}') AND start_time - e > 0.6::DOUBLE) AS m
        FROM (SELECT f.show_name, o.i, f.first_seq, f.s, f.e, f.parts, o.seq_index, o.start_time, o.end_time, o.text AS text2, {TAIL.format("f.text")} AS ct, regexp_replace(o.text, '^[\\s\\x0B]+', '') AS nt, {WORDS.format("f.text")} AS w1
          FROM f JOIN o ON o.show_name = f.show_name AND o.i = f.i + 1))),
    k AS (SELECT *, lead(closed, 1, TRUE) OVER (PARTITION BY show_name ORDER BY i) AS last FROM f)
    SELECT show_name, first_seq AS seq_index, md5(text) AS text, s AS start_time, e AS end_time, CAST(parts AS BIGINT) AS parts FROM k WHERE last
    """,
    ("segments",),
)
def merge_segments(spark, sf_dir):
    return O.merge_segments(segments(spark, sf_dir), C.EPISODE).select("show_name", "seq_index", F.md5("text").alias("text"), "start_time", "end_time", "parts")


SEGMENT_CASES = [(0, "Like there's a rule,", 1.0, 2.0), (1, "or something", 2.1, 3.0), (2, "like that?", 3.1, 3.8), (3, "I", 6.0, 6.4), (4, "got it.", 6.5, 7.0), (5, "Please don't", 7.2, 7.9), (6, "do that again.", 8.0, 8.5), (7, "so we left", 9.0, 10.0), (8, "Then he came", 10.7, 11.0)]


@query("merge_segment_cases", f"SELECT seq_index, text, parts FROM {sql_values([(0, 'Like there' + chr(39) + 's a rule, or something like that?', 3), (3, 'I got it.', 2), (5, 'Please don' + chr(39) + 't do that again.', 2), (7, 'so we left', 1), (8, 'Then he came', 1)], 'seq_index, text, parts')}")
def merge_segment_cases(spark, sf_dir):
    rows = values(spark, [("s", "e", *r) for r in SEGMENT_CASES], "show_name string, episode string, seq_index long, text string, start_time double, end_time double")
    return O.merge_segments(rows, C.EPISODE).select(F.col("seq_index").cast("int").alias("seq_index"), "text", F.col("parts").cast("int").alias("parts"))


GOES_ON = f"(a <> '' AND b <> '' AND (regexp_matches(a, {literal(L.ELLIPSIS)}) OR (NOT regexp_matches(a, {literal(L.ENDS)}) AND (regexp_matches(regexp_extract(b, '[\\pL]', 0), '^\\p{{Ll}}') OR regexp_matches(a, {literal(L.OPEN_END)})))))"
DASHED = f"regexp_matches(b, {literal(L.DASH)})"


@query(
    "merge_preview",
    f"""
    WITH p AS (SELECT *, coalesce(en_text, '') AS a, coalesce(nt, '') AS b FROM (SELECT *, lead(line_id) OVER w AS nid, lead(start_time) OVER w AS ns, lead(en_text) OVER w AS nt FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY start_time, line_id)) WHERE nid IS NOT NULL)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ns - end_time > 1 THEN 'gap' WHEN NOT {GOES_ON} THEN 'continuation' WHEN {DASHED} THEN 'dash' WHEN {WORDS.format("concat(a, ' ', b)")} > 50 THEN 'words' ELSE 'merge' END AS reason FROM p) GROUP BY reason
    """,
    ("lines",),
)
def merge_preview(spark, sf_dir):
    return R.merge_preview(O.preview_pairs(lines(spark, sf_dir).withColumnRenamed("line_id", "node_id"), ["doc_id"], 1.0))


@query(
    "merge_lines",
    f"""RECURSIVE
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_time, pos) AS i FROM lines),
    f(doc_id, i, pos, text, s, e, parts, closed) AS (SELECT doc_id, i, pos, en_text, start_time, end_time, 1, FALSE FROM o WHERE i = 1 UNION ALL
      SELECT doc_id, i, CASE WHEN m THEN p0 ELSE p1 END, CASE WHEN m THEN trim(concat(CASE WHEN regexp_matches(a, {literal(L.ELLIPSIS)}) THEN {TAIL.format("regexp_replace(a, " + literal(L.ELLIPSIS) + ", '')")} ELSE a END, ' ', b)) ELSE b END, CASE WHEN m THEN s ELSE start_time END, end_time, CASE WHEN m THEN parts + 1 ELSE 1 END, NOT m
      FROM (SELECT *, start_time - e <= 1 AND NOT {DASHED} AND {WORDS.format("concat(a, ' ', b)")} <= 50 AND {GOES_ON} AS m FROM (SELECT f.doc_id, o.i, f.pos AS p0, o.pos AS p1, f.s, f.e, f.parts, o.start_time, o.end_time, f.text AS a, o.en_text AS b FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1))),
    k AS (SELECT *, lead(closed, 1, TRUE) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM f)
    SELECT doc_id, pos, md5(text) AS text, s AS start_time, e AS end_time, CAST(parts AS BIGINT) AS parts FROM k WHERE last
    """,
    ("lines",),
)
def merge_lines(spark, sf_dir):
    out = O.merge_lines(lines(spark, sf_dir).withColumn("zh_text", F.lit("")).withColumn("pos", F.col("pos").cast("long")), ["doc_id"], ["pos"])
    return out.select("doc_id", "pos", F.md5("en_text").alias("text"), "start_time", "end_time", "parts")


LINE_CASES = [("f", 0, 0.0, 1.0, "I was going to", "我"), ("f", 1, 1.5, 2.0, "the store...", "要"), ("f", 2, 2.2, 3.0, "And then left.", ""), ("f", 3, 3.1, 4.0, "- no way", ""), ("f", 4, 4.2, 5.0, "he said so", "他"), ("f", 5, 7.0, 8.0, "too late", ""), ("g", 0, 0.0, 1.0, "Alone", None)]


@query("merge_line_cases", f"SELECT file, n, en, zh FROM {sql_values([('f', 0, 'I was going to the store And then left.', '我 要'), ('f', 3, '- no way he said so', '他'), ('f', 5, 'too late', ''), ('g', 0, 'Alone', '')], 'file, n, en, zh')}")
def merge_line_cases(spark, sf_dir):
    rows = values(spark, LINE_CASES, "file string, n int, start_time double, end_time double, en_text string, zh_text string")
    return O.merge_lines(rows, ["file"], ["n"]).select("file", "n", F.col("en_text").alias("en"), F.col("zh_text").alias("zh"))


@query("merge_by_vectors")
def merge_by_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("s"), (F.col("label")).cast("string")).alias("show_name"), F.lit("E").alias("episode"), F.col("vec_id").alias("node_id"), F.concat(F.lit("Word"), F.col("vec_id").cast("string")).alias("en_text"), F.col("vec_id").cast("double").alias("start_time"), (F.col("vec_id") + 0.5).alias("end_time"), "embedding", F.lit(None).cast("string").alias("zh_text"))
    from cueline.operators.lifecycle import merge_adjacent

    return merge_adjacent(e, 30.0)


@query("covered_spans", "SELECT node_id, count(s.seq_index) > 0 AS covered FROM targets t LEFT JOIN segments s ON s.show_name = t.show_name AND s.seq_index % 3 = 0 AND s.start_time < t.end_time AND s.end_time > t.start_time GROUP BY node_id", ("targets",))
def covered_spans(spark, sf_dir):
    """Whether a node's time meets what every third segment of its show covers."""
    from cueline.functions.text import overlaps

    ranges = segments(spark, sf_dir).where("seq_index % 3 = 0").groupBy("show_name").agg(F.collect_list(F.struct(F.col("start_time").alias("s"), F.col("end_time").alias("e"))).alias("ranges"))
    return _targets(spark, sf_dir).join(ranges, "show_name", "left").select("node_id", F.coalesce(overlaps(F.col("start_time"), F.col("end_time"), F.col("ranges")), F.lit(False)).alias("covered"))


@query("closest_segments")
def closest_segments(spark, sf_dir):
    return C.closest_segments(_targets(spark, sf_dir), segments(spark, sf_dir))


# Suppliers as videos of the episode of the document with their number.
@query("episodes_to_cut", """, v AS (SELECT show_name, episode, arg_min(row(s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name END), s_suppkey) AS v FROM supplier JOIN nodes ON node_id = s_suppkey GROUP BY ALL)
    SELECT show_name, episode, node_id, v[1] AS video_id, v[2] AS file_path FROM nodes JOIN v USING (show_name, episode) WHERE v[2] IS NOT NULL""", ("nodes",))
def episodes_to_cut(spark, sf_dir):
    n = nodes(spark, sf_dir)
    videos = table(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("node_id")).select(F.col("s_suppkey").alias("video_id"), "show_name", "episode", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("file_path"))
    return C.episodes_to_cut(n, videos)
