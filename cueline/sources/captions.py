"""Caption files as tables, and tables as caption files.

Files are read whole, one row each, and taken apart with column functions; only decoding and the grouping of events,
which depends on what came before, run in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cueline.functions import lexicon as L
from cueline.functions.text import bilingual, clock_seconds, cue_ms, ms_clock, squeeze, strip, word_count
from cueline.operators.folds import merge_lines
from cueline.params import DEFAULT, Params

SUFFIXES = {"srt": ["srt"], "ass": ["ass", "ssa"], "vtt": ["vtt"]}
SUBTITLES = [*SUFFIXES["srt"], *SUFFIXES["ass"]]


def decode_captions(raw: bytes) -> str:
    """Text of a file: by its byte-order mark, else UTF-8; else Windows 1252 if bytes beyond ASCII only stand alone, as accents in Western text do;
    else the first of GB 18030 (which GBK and GB2312 are part of), Big5 and Shift-JIS that fits, or Windows 1252 with bad bytes replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    names = ["utf-8"] if re.search(rb"[\x80-\xff]{2}", raw) else ["utf-8", "cp1252"]
    for name in (*names, "gb18030", "big5", "shift_jis"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", "replace")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each caption file under a path, in any of the encodings above."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(decode_captions)

    suffixes = [s for names in SUFFIXES.values() for s in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).select(F.col("path").alias("file"), decoded("content").alias("text"))


def _blocks(files: DataFrame) -> DataFrame:
    """file, block, and its lines, trimmed; blocks are set apart by blank lines."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\x{FEFF}", "")
    clean = strip(F.regexp_replace(text, r"\r\n?", "\n"))
    return files.select("file", F.posexplode(F.split(clean, r"\n\s*\n")).alias("block", "body")).withColumn("lines", F.transform(F.split(strip(F.col("body")), "\n"), strip))


def _timed(blocks: DataFrame) -> DataFrame:
    """Blocks with a time line: its times in seconds, and the lines after it without tags and needless blanks."""
    first = F.array_position(F.transform("lines", lambda x: F.regexp_like(x, F.lit("^" + L.TIMECODE))), F.lit(True))
    timed = blocks.withColumn("at", F.nullif(first.cast("int"), F.lit(0))).where((F.size("lines") >= 2) & F.col("at").isNotNull())
    line = F.try_element_at("lines", F.col("at"))
    times = timed.withColumn("start_time", clock_seconds(F.regexp_extract(line, L.TIMECODE, 1))).withColumn("end_time", clock_seconds(F.regexp_extract(line, L.TIMECODE, 2)))
    texts = F.filter(F.transform(F.slice("lines", F.coalesce("at", F.lit(0)) + 1, F.size("lines")), lambda x: squeeze(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    return times.where("start_time IS NOT NULL AND end_time IS NOT NULL").withColumn("texts", texts).where(F.size("texts") > 0)


def parse_srt(files: DataFrame) -> DataFrame:
    """file, block, times, en_text, zh_text, word_count of SRT texts; blocks without English are left out. files: file, text."""
    rows = _timed(_blocks(files)).withColumn("both", bilingual(F.col("texts")))
    return rows.select("file", "block", "start_time", "end_time", F.col("both.en").alias("en_text"), F.col("both.zh").alias("zh_text")).where("en_text <> ''").withColumn("word_count", word_count(F.col("en_text")))


def parse_srt_plain(files: DataFrame) -> DataFrame:
    """file, block, times and text of SRT texts in any language."""
    return _timed(_blocks(files)).select("file", "block", "start_time", "end_time", F.array_join("texts", " ").alias("text"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """file, idx (from 1), start_ms, end_ms, text of WebVTT texts."""
    rows = _blocks(files).where(~F.regexp_like(F.element_at("lines", 1), F.lit("^(WEBVTT|NOTE|STYLE|REGION)")))
    first = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), F.lit(True)).cast("int")
    rows = rows.withColumn("at", F.nullif(first, F.lit(0))).where("at IS NOT NULL")
    line = F.split(F.try_element_at("lines", F.col("at")), "-->", 2)
    after = F.slice("lines", F.coalesce("at", F.lit(0)) + 1, F.size("lines"))
    second = F.array_position(F.transform(after, lambda x: F.contains(x, F.lit("-->"))), F.lit(True)).cast("int")
    kept = F.when(second > 0, F.slice(after, 1, F.greatest(second - 1, F.lit(0)))).otherwise(after)
    texts = F.filter(F.transform(kept, lambda x: strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    cues = rows.select("file", "block", cue_ms(F.element_at(line, 1)).alias("start_ms"), cue_ms(F.element_at(F.split(strip(F.coalesce(F.try_element_at(line, F.lit(2)), F.lit(""))), r"\s+"), 1)).alias("end_ms"), F.array_join(texts, " ").alias("text"))
    return cues.where("text <> '' AND start_ms < end_ms").withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("block"))).select("file", "idx", "start_ms", "end_ms", "text")


def ass_events(files: DataFrame) -> DataFrame:
    """file, n, part, times and text of the dialogue events of ASS and SSA texts, cut at their line breaks and without tags."""
    rows = files.select("file", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")).alias("n", "line")).where(F.regexp_like("line", F.lit(r"^\s*Dialogue:")))
    fields, rows = F.col("fields"), rows.withColumn("fields", F.explode(F.array(F.split(F.regexp_replace("line", r"^\s*Dialogue:\s*", ""), ",", 10))))  # once a line
    events = rows.select("file", "n", clock_seconds(F.try_element_at(fields, F.lit(2))).alias("start_time"), clock_seconds(F.try_element_at(fields, F.lit(3))).alias("end_time"), F.posexplode(F.split(F.coalesce(F.try_element_at(fields, F.lit(10)), F.lit("")), r"\\[Nn]")).alias("part", "raw"))
    return events.withColumn("text", squeeze(F.regexp_replace("raw", r"\{[^}]*\}", " "))).where("text <> '' AND start_time IS NOT NULL AND end_time IS NOT NULL").drop("raw")


def parse_ass(files: DataFrame, within: float = 0.1) -> DataFrame:
    """Rows as of parse_srt(): events that start less than `within` after the first one of their group are one block."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, first = object(), 0, 0.0
        for batch in batches:
            blocks = []
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start_time").to_pylist(), strict=True):
                if file != last:
                    last, block, first = file, 0, start
                elif abs(first - start) >= within:
                    block, first = block + 1, start
                blocks.append(block)
            yield batch.append_column("block", pa.array(blocks, pa.int32()))

    events = ass_events(files)  # sorted by file in each task, and numbered as they come
    schema = StructType([*events.schema.fields, StructField("block", IntegerType())])
    dealt = events.repartition("file").sortWithinPartitions("file", "start_time", "n", "part").mapInArrow(number, schema)
    grouped = dealt.groupBy("file", "block").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.transform(F.array_sort(F.collect_list(F.struct("start_time", "n", "part", "text"))), lambda x: x["text"]).alias("texts"))
    rows = grouped.withColumn("both", F.explode(F.array(bilingual(F.col("texts")))))  # of one: a condition on it is not computed before it
    return rows.select("file", "block", "start_time", "end_time", F.col("both.en").alias("en_text"), F.col("both.zh").alias("zh_text")).where("en_text <> ''").withColumn("word_count", word_count(F.col("en_text")))


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def read_subtitles(spark: SparkSession, path: str, params: Params = DEFAULT) -> DataFrame:
    """All subtitle files under a path, by their kind, with unfinished lines merged: file, block, times, texts, word_count, parts.

    A path that is itself a file of another kind is an error, and so are captions of another kind in a folder; its other files do not count.
    """
    named = F.regexp_extract("path", r"([^/]+)$", 1) == path.rstrip("/").rsplit("/", 1)[-1]
    other = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~suffix(F.col("path")).isin(SUBTITLES) & (named | suffix(F.col("path")).isin(SUFFIXES["vtt"]))).select("path").first()
    if other:
        raise ValueError(f"no subtitle file that can be read: {other.path}")
    files = read_files(spark, path)
    lines = parse_srt(files.where(suffix(F.col("file")) == "srt")).unionByName(parse_ass(files.where(suffix(F.col("file")).isin("ass", "ssa"))))
    return merge_lines(lines, ["file"], ["block"], params)


def merge_stats(lines: DataFrame) -> DataFrame:
    """Per file, lines before and after merging, and how many of them went into others."""
    before, after = F.sum("parts"), F.count(F.lit(1))
    return lines.groupBy("file").agg(before.alias("before"), after.alias("after"), (before - after).alias("merged"))


def take_in(files: DataFrame, batch: str, episodes: DataFrame | None = None, episode: str | None = None) -> DataFrame:
    """Uploaded files that are subtitles, with a code each of eight hex digits, and their episode.

    files: file; episodes: file, episode, where files have their own; the rest get the batch's. A file's code comes from its name and the batch's, so
    that a second run gives the same.
    """
    own = files.where(suffix(F.col("file")).isin(SUBTITLES)).withColumn("code", F.upper(F.substring(F.md5(F.concat_ws("/", F.lit(batch), "file")), 1, 8)))
    if episodes is None:
        return own.withColumn("episode", F.lit(episode).cast("string"))
    named = episodes.groupBy("file").agg(F.max("episode").alias("episode"))
    return own.join(named, "file", "left").withColumn("episode", F.coalesce("episode", F.lit(episode).cast("string")))


def srt_text(captions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the text of a bilingual SRT file. captions: keys, idx, start_ms, end_ms, text, zh_text."""
    entry = F.concat(F.col("n").cast("string"), F.lit("\n"), ms_clock(F.col("start_ms")), F.lit(" --> "), ms_clock(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"), F.when(F.coalesce("zh_text", F.lit("")) != "", F.concat("zh_text", F.lit("\n"))).otherwise(""))
    rows = captions.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))).select(*keys, "n", entry.alias("entry"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n").alias("srt"))


def vtt_text(captions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the text of a WebVTT file. captions: keys, idx, start_ms, end_ms, text."""
    clock = lambda c: F.replace(ms_clock(F.col(c)), F.lit(","), F.lit("."))
    rows = captions.select(*keys, "idx", F.concat(clock("start_ms"), F.lit(" --> "), clock("end_ms"), F.lit("\n"), "text", F.lit("\n")).alias("entry"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(_in_order(), "\n")).alias("vtt"))


ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def ass_text(captions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the text of an ASS file, in hundredths of a second. captions: keys, idx, start_ms, end_ms, text, zh_text."""
    clock = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(F.col(c) / 3600000), F.floor(F.col(c) / 60000) % 60, F.floor(F.col(c) / 1000) % 60, F.floor(F.col(c) / 10) % 100)
    zh = F.when(F.coalesce("zh_text", F.lit("")) != "", F.concat(F.lit("\\N"), "zh_text")).otherwise("")
    rows = captions.select(*keys, "idx", F.concat(F.lit("Dialogue: 0,"), clock("start_ms"), F.lit(","), clock("end_ms"), F.lit(",Default,,0,0,0,,"), "text", zh).alias("entry"))
    return rows.groupBy(*keys).agg(F.concat(F.lit(ASS_HEAD), F.array_join(_in_order(), "\n"), F.lit("\n")).alias("ass"))


def _in_order() -> Column:
    """The entries of a group by idx."""
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", "entry"))), lambda x: x["entry"])


def write_srt(captions: DataFrame, keys: list[str], path: str) -> None:
    """Bilingual SRT files, one row of text each with a byte-order mark, in folders by key."""
    texts = srt_text(captions, keys).withColumn("value", F.concat(F.lit("﻿"), "srt"))
    texts.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def chinese_choice(languages: Column) -> Column:
    """The language code that is taken as Chinese, the first of a fixed order; null if none is there."""
    lower = F.transform(languages, F.lower)
    return F.coalesce(*[F.when(F.array_contains(lower, x), F.lit(x)) for x in L.CHINESE])


def replace_episode(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of the episodes in `new` replaced by those."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def save_table(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, written anew; only the partitions that the rows have if there are partition columns."""
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
