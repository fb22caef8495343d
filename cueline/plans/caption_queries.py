"""Queries of caption files, over texts that reach the branches of the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.sources import captions as S
from cueline.plans.base import NEEDS, VIEWS, lines, query, sql_values, table, values

SRT = """1
00:00:01,000 --> 00:00:02,500
Hello there
你好

2
00:00:03.000 --> 00:00:04.000 X1:0
<i>Where   are</i> you?

3
no time line here
text

4
00:00:05,000 --> 00:00:06,000
只有中文

5
00:00:07,000 --> 00:00:08,000


6
0:00:09,5 --> 0:00:10,25
Two lines
of text | 两行

7
00:00:11,000 --> 00:00:12,000
good day sir | 日安
"""
FILES = [("a.srt", SRT), ("b.srt", "﻿" + SRT.split("\n\n")[0].replace("\n", "\r\n")), ("c.srt", ""), ("d.srt", None)]
PARSED = [
    ("a.srt", 1.0, 2.5, "Hello there", "你好", 2), ("a.srt", 3.0, 4.0, "Where are you?", "", 3), ("a.srt", 9.5, 10.25, "Two lines", "of text | 两行", 2),
    ("a.srt", 11.0, 12.0, "good day sir", "日安", 3), ("b.srt", 1.0, 2.5, "Hello there", "你好", 2),
]


@query("parse_srt", f"SELECT file, start_time, end_time, en_text, zh_text, word_count FROM {sql_values(PARSED, 'file, start_time, end_time, en_text, zh_text, word_count')}")
def parse_srt(spark, sf_dir):
    return S.parse_srt(values(spark, FILES, "file string, text string")).drop("block")


PLAIN = [("a.srt", 1.0, "Hello there 你好"), ("a.srt", 3.0, "Where are you?"), ("a.srt", 5.0, "只有中文"), ("a.srt", 9.5, "Two lines of text | 两行"), ("a.srt", 11.0, "good day sir | 日安"), ("b.srt", 1.0, "Hello there 你好")]


@query("parse_srt_plain", f"SELECT file, start_time, text FROM {sql_values(PLAIN, 'file, start_time, text')}")
def parse_srt_plain(spark, sf_dir):
    return S.parse_srt_plain(values(spark, FILES, "file string, text string")).select("file", "start_time", "text")


VTT = """﻿WEBVTT
Kind: captions

NOTE a comment
of two lines

00:00.000 --> 00:00.001

cue-1
00:01.000 --> 00:02.500 align:start position:0%
<v Bob>Hello <b>there</b>

00:00:03.000 --> 00:00:04.000
first
00:00:03.000 --> 00:00:04.000
second

00:06.000 --> 00:05.000
backwards

01:00:00.5 --> 01:00:01
late
cue
"""
CUES = [("v.vtt", 1, 1000, 2500, "Hello there"), ("v.vtt", 2, 3000, 4000, "first"), ("v.vtt", 3, 3600500, 3601000, "late cue")]


@query("parse_vtt", f"SELECT file, idx, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM {sql_values(CUES, 'file, idx, start_ms, end_ms, text')}")
def parse_vtt(spark, sf_dir):
    return S.parse_vtt(values(spark, [("v.vtt", VTT)], "file string, text string"))


ASS = r"""[Script Info]
Title: x
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,Later line, with comma
Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\i1}Hello{\i0} you\N你好
Dialogue: 0,0:00:01.05,0:00:02.50,Zh,,0,0,0,,再见
Dialogue: 0,0:00:01.12,0:00:03.00,Default,,0,0,0,,apart
Comment: 0,0:00:09.00,0:00:10.00,Default,,0,0,0,,not shown
Dialogue: 0,0:00:07.00,0:00:08.00,Zh,,0,0,0,,只有中文
"""
GROUPED = [("s.ass", 1.0, 2.5, "Hello you", "你好 再见"), ("s.ass", 1.12, 3.0, "apart", ""), ("s.ass", 5.0, 6.0, "Later line, with comma", "")]


@query("parse_ass", f"SELECT file, start_time, end_time, en_text, zh_text FROM {sql_values(GROUPED, 'file, start_time, end_time, en_text, zh_text')}")
def parse_ass(spark, sf_dir):
    return S.parse_ass(values(spark, [("s.ass", ASS)], "file string, text string")).select("file", F.round("start_time", 2).alias("start_time"), F.round("end_time", 2).alias("end_time"), "en_text", "zh_text")


@query(
    "srt_text",
    """
    WITH l AS (SELECT doc_id, pos, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e, en_text, lang FROM lines)
    SELECT doc_id, md5(string_agg(concat(pos + 1, chr(10), printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000), ' --> ', printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000), chr(10), en_text, chr(10), CASE WHEN lang = 'de' THEN concat('zh', chr(10)) ELSE '' END), chr(10) ORDER BY pos)) AS srt
    FROM l GROUP BY doc_id
    """,
    ("lines",),
)
def srt_text(spark, sf_dir):
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("idx"), ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), F.col("en_text").alias("text"), F.when(F.col("lang") == "de", "zh").otherwise("").alias("zh_text"))
    return S.srt_text(rows, ["doc_id"]).select("doc_id", F.md5("srt").alias("srt"))


@query("srt_round_trip", "SELECT doc_id, count(*) AS n, count(*) AS same FROM lines WHERE len(regexp_extract_all(en_text, '[a-zA-Z]')) > 0 GROUP BY doc_id", ("lines",))
def srt_round_trip(spark, sf_dir):
    """Lines written as SRT and read again: all that have a letter come back as they were, but for blanks and tags."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = lines(spark, sf_dir).where(F.regexp_count("en_text", F.lit("[a-zA-Z]")) > 0)
    srt = S.srt_text(rows.select("doc_id", F.col("pos").alias("idx"), ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), F.col("en_text").alias("text"), F.lit("").alias("zh_text")), ["doc_id"])
    back = S.parse_srt_plain(srt.select(F.col("doc_id").cast("string").alias("file"), F.col("srt").alias("text")))
    plain = F.trim(F.regexp_replace(F.regexp_replace("en_text", "<[^>]+>", ""), r"\s+", " "))
    wanted = rows.select(F.col("doc_id"), F.round("start_time", 3).alias("start_time"), plain.alias("text")).groupBy("doc_id", "start_time", "text").agg(F.count(F.lit(1)).alias("n"))
    found = back.select(F.col("file").cast("long").alias("doc_id"), F.round("start_time", 3).alias("start_time"), "text").groupBy("doc_id", "start_time", "text").agg(F.count(F.lit(1)).alias("m"))
    return wanted.join(found, ["doc_id", "start_time", "text"], "left").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("same"))


def _through_files(spark, sf_dir, kind, made):
    """All lines with a letter, a file a document, written and read again through the data source: file's document, text."""
    from cueline.sources.caption_source import register
    from cueline.workers import shared_folder

    register(spark)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    rows = lines(spark, sf_dir).where(F.regexp_count("en_text", F.lit("[a-zA-Z]")) > 0)
    rows = rows.select("doc_id", F.col("pos").alias("idx"), ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), F.col("en_text").alias("text"), F.when(F.col("lang") == "de", "中文").otherwise("").alias("zh_text"))
    folder = shared_folder(spark, "captions")
    made(rows, ["doc_id"]).select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("file"), F.col(kind).alias("text")).write.format("captions").mode("append").save(folder)
    back = spark.read.format("captions").option("kinds", kind).load(folder)
    return back.select(F.regexp_extract("file", r"(\d+)\.\w+$", 1).alias("file"), "text")


# What a line is after it was written and read: no tags, single blanks.
VIEWS["shown"] = r"""SELECT *, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e, trim(regexp_replace(regexp_replace(en_text, '<[^>]+>', '', 'g'), '[\s\x0B]+', ' ', 'g')) AS shown FROM lines WHERE len(regexp_extract_all(en_text, '[a-zA-Z]')) > 0"""
NEEDS["shown"] = ("lines0", "lines")


@query("srt_files", "SELECT doc_id, s / 1000 AS start_time, e / 1000 AS end_time, md5(shown) AS en_text, CASE WHEN lang = 'de' THEN '中文' ELSE '' END AS zh_text FROM shown WHERE len(regexp_extract_all(shown, '[a-zA-Z]')) > 0", ("shown",))
def srt_files(spark, sf_dir):
    back = S.parse_srt(_through_files(spark, sf_dir, "srt", S.srt_text))
    return back.select(F.col("file").cast("long").alias("doc_id"), "start_time", "end_time", F.md5("en_text").alias("en_text"), "zh_text")


@query("vtt_files", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, s AS start_ms, e AS end_ms, md5(shown) AS text FROM shown WHERE shown <> ''", ("shown",))
def vtt_files(spark, sf_dir):
    back = S.parse_vtt(_through_files(spark, sf_dir, "vtt", S.vtt_text))
    return back.select(F.col("file").cast("long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text"))


@query("ass_files", "SELECT doc_id, s // 10 / 100 AS start_time, e // 10 / 100 AS end_time, md5(trim(regexp_replace(en_text, '[\\s\\x0B]+', ' ', 'g'))) AS en_text, CASE WHEN lang = 'de' THEN '中文' ELSE '' END AS zh_text FROM shown", ("shown",))
def ass_files(spark, sf_dir):
    back = S.parse_ass(_through_files(spark, sf_dir, "ass", S.ass_text))
    return back.select(F.col("file").cast("long").alias("doc_id"), F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"), F.md5("en_text").alias("en_text"), "zh_text")


@query("chinese_choice", f"SELECT id, pick FROM {sql_values([(0, 'zh-cn'), (1, 'zh-hans'), (2, None), (3, 'zh')], 'id, pick')}")
def chinese_choice(spark, sf_dir):
    rows = values(spark, [(0, ["en", "zh-hans", "ZH-CN"]), (1, ["zh", "zh-Hans"]), (2, ["zh-tw", "zh-hant", "en"]), (3, ["zh-tw", "zh"])], "id int, langs array<string>")
    return rows.select("id", S.chinese_choice(F.col("langs")).alias("pick"))


@query("page_titles", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")).alias("path"), F.coalesce(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("title"))


# Documents as uploaded files, of which benchmark items have an episode of their own.
UPLOAD = "concat(source, '-', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 5 WHEN 0 THEN '.srt' WHEN 1 THEN '.ASS' WHEN 2 THEN '.ssa' WHEN 3 THEN '.vtt' ELSE '' END)"


@query("take_in", f"SELECT file, upper(substr(md5(concat('b1/', file)), 1, 8)) AS code, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN concat('E', CAST(doc_id AS VARCHAR)) ELSE 'E01' END AS episode FROM (SELECT doc_id, {UPLOAD} AS file FROM documents) WHERE doc_id % 5 < 3")
def take_in(spark, sf_dir):
    from cueline.sources.captions import take_in as take

    files = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{UPLOAD.replace('VARCHAR(20)', 'STRING')} AS file")
    own = files.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id").select("file", F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("episode"))
    return take(files.select("file"), "b1", own, "E01")
