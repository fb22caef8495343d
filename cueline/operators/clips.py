"""Alignment of nodes with transcript segments, and the plan of clips."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.ranking import cosine
from cueline.functions.text import for_alignment, for_diagnosis, word_count
from cueline.operators.folds import merge_segments
from cueline.params import DEFAULT, Params
from cueline.workers import kept

EPISODE = ["show_name", "episode"]


def _bins(start, end, width: float):
    """Numbers of the time bins that [start, end] touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def bilingual_nearest(lines: DataFrame, other: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    """Lines without Chinese text with that of the line whose start is nearest, within the tolerance; the earliest of equals.

    lines: keys, line_id, start_time, zh_text; other: keys, start_time, text. The join is by bins of time, not by all pairs of a file.
    """
    width = max(tolerance, 0.001)
    want = lines.where(F.coalesce("zh_text", F.lit("")) == "").select(*keys, "line_id", "start_time", F.explode(_bins(F.col("start_time") - tolerance, F.col("start_time") + tolerance, width)).alias("bin"))
    have = other.select(*keys, F.col("start_time").alias("other_start"), F.col("text").alias("other_text"), F.floor(F.col("start_time") / width).alias("bin"))
    off = F.abs(F.col("other_start") - F.col("start_time"))
    best = want.join(have, [*keys, "bin"]).where(off <= tolerance).groupBy(*keys, "line_id").agg(F.min(F.struct(off.alias("off"), "other_start", "other_text")).alias("best"))
    return lines.join(best, [*keys, "line_id"], "left").withColumn("zh_text", F.coalesce(F.col("best.other_text"), "zh_text")).drop("best")


def caption_alignment(en: DataFrame, zh: DataFrame, keys: list[str], tolerance_ms: int = 2000) -> DataFrame:
    """Chinese text for each English caption: by position where both have as many captions, else by containment, else by the nearest start.

    Both: keys, idx, start_ms, end_ms, text. Returns keys, idx, zh_text ('' where nothing fits).
    """
    sizes = en.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(zh.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys, "left")
    order = lambda t: F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    e = en.withColumn("place", order(en)).join(sizes, keys).select(*keys, "idx", "place", "start_ms", (F.col("n") == F.coalesce("m", F.lit(0))).alias("same"))
    z = zh.withColumn("place", order(zh)).select(*keys, F.col("place").alias("zp"), F.col("start_ms").alias("zs"), F.col("end_ms").alias("ze"), F.col("text").alias("zt"))
    by_place = e.where("same").join(z.withColumnRenamed("zp", "place"), [*keys, "place"]).select(*keys, "idx", F.col("zt").alias("zh_text"))
    width = max(tolerance_ms, 1)
    rest = e.where("NOT same")
    held = rest.withColumn("bin", F.floor(F.col("start_ms") / width)).join(z.withColumn("bin", F.explode(_bins(F.col("zs"), F.col("ze"), width))), [*keys, "bin"])
    held = held.where("zs <= start_ms AND start_ms <= ze").groupBy(*keys, "idx").agg(F.min(F.struct("zp", "zt")).alias("held"))
    off = F.abs(F.col("zs") - F.col("start_ms"))
    near = rest.withColumn("bin", F.explode(_bins(F.col("start_ms") - tolerance_ms, F.col("start_ms") + tolerance_ms, width))).join(z.withColumn("bin", F.floor(F.col("zs") / width)), [*keys, "bin"])
    near = near.where(off <= tolerance_ms).groupBy(*keys, "idx").agg(F.min(F.struct(off.alias("off"), "zp", "zt")).alias("near"))
    fitted = rest.join(held, [*keys, "idx"], "left").join(near, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce(F.when(F.col("held.zt") != "", F.col("held.zt")), F.col("near.zt"), F.lit("")).alias("zh_text"))
    return by_place.unionByName(fitted)


def window_candidates(nodes: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Nodes and the segments of their episode that meet the window around the node's time.

    nodes: EPISODE, node_id, start_time and more; segments: EPISODE, seq_index, start_time, end_time and more, which come back as seg_*.
    Joined by bins as wide as the window.
    """
    width = params.window
    low = F.greatest(F.lit(0.0), F.col("start_time") - width)
    n = nodes.withColumn("low", low).withColumn("high", F.col("start_time") + width).withColumn("bin", F.explode(_bins(F.col("low"), F.col("high"), width)))
    renamed = {"start_time": "seg_start", "end_time": "seg_end", "seq_index": "seq_index"}
    s = segments.select(*EPISODE, *[F.col(c).alias(renamed.get(c, f"seg_{c}")) for c in segments.columns if c not in EPISODE])
    s = s.withColumn("bin", F.explode(_bins(F.col("seg_start"), F.col("seg_end"), width)))
    first = F.greatest(F.floor(F.col("low") / width), F.floor(F.col("seg_start") / width))  # a pair that shares several bins counts in its first
    return n.join(s, [*EPISODE, "bin"]).where((F.col("seg_start") < F.col("high")) & (F.col("seg_end") > F.col("low")) & (F.col("bin") == first)).drop("bin", "low", "high")


def indel_ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    """As indel_ratio(), for many pairs of long texts: the common subsequence by bits, one step a character."""

    def one(a: str, b: str) -> float:
        if not a or not b:
            return 1.0 if a == b else 0.0
        places: dict[str, int] = {}
        for k, c in enumerate(a):
            places[c] = places.get(c, 0) | 1 << k
        full = (1 << len(a)) - 1
        rows = full
        for c in b:
            both = rows & places.get(c, 0)
            rows = ((rows + both) | (rows - both)) & full
        return 2.0 * (len(a) - rows.bit_count()) / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def align(nodes: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Nodes of each episode, in the order of their times, each with the free segment that fits best.

    nodes: EPISODE, node_id, en_text, start_time and perhaps embedding; segments: EPISODE, seq_index, text, times and perhaps embedding. Texts are
    normalised before they meet and candidates scored in bulk; only the choice, which depends on earlier ones, follows an episode in order, row by row.
    """
    more = lambda t: ["embedding"] if "embedding" in t.columns else []
    n = nodes.select(*EPISODE, "node_id", "start_time", for_alignment(F.col("en_text")).alias("norm"), *more(nodes)).withColumn("words", word_count(F.col("norm")))
    s = segments.select(*EPISODE, "seq_index", "start_time", "end_time", "text", for_alignment(F.col("text")).alias("norm"), *more(segments)).withColumn("words", word_count(F.col("norm")))
    pairs = window_candidates(n, s, params)
    fits = (F.col("words") > 0) & (F.col("seg_words") > 0) & (F.least("words", "seg_words") / F.greatest("words", "seg_words", F.lit(1)) >= params.min_length_ratio)
    cos = cosine(F.col("embedding"), F.col("seg_embedding")) if {"embedding", "seg_embedding"} <= set(pairs.columns) else F.lit(0.0)
    scored = pairs.where(fits).select(*EPISODE, "node_id", F.col("start_time").alias("hint"), "seq_index", "seg_start", "seg_end", F.col("seg_text").alias("segment_text"), "words", F.pandas_udf(indel_ratios, "double")("norm", "seg_norm").alias("text_similarity"), cos.alias("embedding_similarity"))
    ordered = scored.repartition(*EPISODE).sortWithinPartitions(*EPISODE, "hint", "node_id", "seg_start", "seq_index")
    columns = [*EPISODE, "hint", "node_id", "seq_index", "seg_start", "seg_end", "segment_text", "words", "text_similarity", "embedding_similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, episode in groupby(rows, lambda r: r[:2]):
            for some in batched(choose_in_order(episode, params), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), ALIGNED, strict=True)], schema=ALIGNED)

    return ordered.select(*columns).mapInArrow(run, "show_name string, episode string, node_id long, seq_index long, whisper_start double, whisper_end double, confidence double, text_similarity double, embedding_similarity double, score_margin double, align_step string, whisper_text string")


ALIGNED = pa.schema([*[(c, pa.string()) for c in EPISODE], ("node_id", pa.int64()), ("seq_index", pa.int64()), *[(c, pa.float64()) for c in ("whisper_start", "whisper_end", "confidence", "text_similarity", "embedding_similarity", "score_margin")], ("align_step", pa.string()), ("whisper_text", pa.string())])


def choose_in_order(candidates: Iterable[tuple], p: Params = DEFAULT) -> Iterator[tuple]:
    """The alignments of an episode: each node takes the best of the segments that earlier ones have left, if it is good enough.

    candidates, in the order in which they are taken: show_name, episode, hint, node_id, seq_index, seg_start, seg_end, segment_text, words,
    text_similarity, embedding_similarity. Only the segments taken so far are held.
    """
    used: set[int] = set()
    cursor = -1
    whole = p.weight_text + p.weight_vector
    for (_, node), own in groupby(candidates, lambda r: r[2:4]):
        best, first, second = None, 0.0, 0.0
        for r in own:
            seq, text, vector = r[4], r[9], r[10]
            if seq in used:
                continue
            score = (p.weight_text * text + p.weight_vector * vector if vector > 0 else whole * text) + (p.order_bonus if seq > cursor else -p.order_penalty)
            if best is None:
                best, first, second = r, score, None
            elif score > first:
                best, first, second = r, score, first
            elif second is None or score > second:
                second = score
        if best is None:
            continue
        show, episode, _, _, seq, start, end, said, words, text, vector = best
        if text < p.least_similarity or (words <= p.short_words and text < p.short_similarity):
            continue
        sure = (p.weight_text * text + p.weight_vector * vector) / whole if vector > 0 else text
        if sure < p.least_confidence:
            continue
        margin = first - (second or 0.0)
        yield show, episode, node, seq, start, end, round(sure, 4), round(text, 4), round(vector, 4), round(margin, 4), "ambiguous" if margin < p.ambiguous_margin else "seq", said
        used.add(seq)
        cursor = max(cursor, seq)


def closest_segments(nodes: DataFrame, segments: DataFrame, k: int = 5) -> DataFrame:
    """For a look at single nodes: the k segments of a node's episode, wherever they are, whose text is most like its own; the earliest of equals."""
    pairs = nodes.select(*EPISODE, "node_id", for_diagnosis(F.coalesce("en_text", F.lit(""))).alias("a")).join(segments.select(*EPISODE, "seq_index", "start_time", for_diagnosis(F.coalesce("text", F.lit(""))).alias("b")), EPISODE)
    scored = pairs.withColumn("similarity", F.pandas_udf(indel_ratios, "double")("a", "b"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("similarity"), "start_time", "seq_index"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("node_id", "seq_index", "similarity", "rank")


def episodes_to_cut(nodes: DataFrame, videos: DataFrame) -> DataFrame:
    """New nodes with the video of their episode: the first one, if it has a file. videos: video_id, show_name, episode, file_path."""
    first = videos.groupBy(*EPISODE).agg(F.min(F.struct("video_id", "file_path")).alias("video"))
    there = first.where(F.coalesce("video.file_path", F.lit("")) != "").select(*EPISODE, "video.*")
    return nodes.select(*EPISODE, "node_id").join(there, EPISODE)


def gate_alignments(aligned: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """What becomes of each alignment: 'failed_long' (recorded), 'failed_short', 'job' or 'unmatched' (only counted)."""
    padded = F.col("whisper_end") - F.col("whisper_start") + params.pad_start + params.pad_end
    return aligned.withColumn("outcome", F.when(padded > params.clip_max, "failed_long").when(padded < params.clip_min, "failed_short").when(F.col("confidence") >= params.low_confidence, "job").otherwise("unmatched"))


def failed_records(gated: DataFrame) -> DataFrame:
    """Records of alignments that are too long to cut: they are kept as failed clips, not active, with what the alignment found."""
    return gated.where("outcome = 'failed_long'").drop("outcome").withColumn("clip_status", F.lit("failed")).withColumn("is_active", F.lit(False))


def gate_counts(gated: DataFrame) -> DataFrame:
    """How many alignments became jobs, failed for their length, and were left unmatched."""
    return gated.agg(F.count_if(F.col("outcome") == "job").alias("jobs"), F.count_if(F.col("outcome").isin("failed_long", "failed_short")).alias("failed"), F.count_if(F.col("outcome") == "unmatched").alias("unmatched"))


def _nearest_end(spans: DataFrame, segments: DataFrame, at: str, field: str, radius: float, name: str, least: float = 0.0, open_: bool = True) -> DataFrame:
    """spans with column name: the value of segments' field nearest to spans' at, within the radius, the first of equals; null if there is none."""
    width = max(radius, 0.001)
    want = spans.select("clip_key", *EPISODE, F.col(at).alias("at"), F.explode(_bins(F.col(at) - radius, F.col(at) + radius, width)).alias("bin"))
    have = segments.where(F.col(field).isNotNull()).select(*EPISODE, "seq_index", F.col(field).alias("value"), F.floor(F.col(field) / width).alias("bin"))
    off = F.abs(F.col("value") - F.col("at"))
    fits = (off < radius) if open_ else (off >= least) & (off <= radius)
    best = want.join(have, [*EPISODE, "bin"]).where(fits).groupBy("clip_key").agg(F.min(F.struct(off.alias("off"), "seq_index", "value")).alias("best"))
    return spans.join(best.select("clip_key", F.col("best.value").alias(name)), "clip_key", "left")


def anchor(spans: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Starts and ends moved to the nearest start and end of a segment within the radius; both stay if they would cross.

    spans: clip_key, EPISODE, start_time, end_time.
    """
    moved = _nearest_end(spans, segments, "start_time", "start_time", params.anchor_radius, "near_start")
    moved = _nearest_end(moved, segments, "end_time", "end_time", params.anchor_radius, "near_end")
    s, e = F.coalesce("near_start", "start_time"), F.coalesce("near_end", "end_time")
    crossed = e <= s + 0.2
    return moved.withColumn("anchor_start", F.when(crossed, F.col("start_time")).otherwise(s)).withColumn("anchor_end", F.when(crossed, F.col("end_time")).otherwise(e)).drop("near_start", "near_end")


def context(spans: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Spans with ctx_start and ctx_end: grown by the segment before and the one after, unless these are far, long, or too much in all.

    spans: clip_key, EPISODE, main_start, main_end. The segment before is the last by seq_index that ends by main_start + 0.05, the one
    after the first that starts from main_end - 0.05 on. Both come from one ordered pass over the union of spans and segments of
    an episode (running last and first), so no span meets all segments.
    """
    seg = segments.select(*EPISODE, F.col("seq_index").cast("long").alias("seq_index"), "start_time", "end_time")
    value = F.struct("seq_index", "start_time", "end_time")
    marks = seg.select(*EPISODE, F.col("end_time").alias("at"), F.lit(0).alias("kind"), value.alias("v"), F.lit(None).cast("long").alias("clip_key"))
    asks = spans.select(*EPISODE, (F.col("main_start") + 0.05).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.col("clip_key").cast("long"))
    w = Window.partitionBy(*EPISODE).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = marks.unionByName(asks).withColumn("v", F.max("v").over(w)).where("kind = 1").select("clip_key", F.col("v").alias("before"))
    marks = seg.select(*EPISODE, F.col("start_time").alias("at"), F.lit(0).alias("kind"), value.alias("v"), F.lit(None).cast("long").alias("clip_key"))
    asks = spans.select(*EPISODE, (F.col("main_end") - 0.05).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["v"].dataType).alias("v"), F.col("clip_key").cast("long"))
    w = Window.partitionBy(*EPISODE).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = marks.unionByName(asks).withColumn("v", F.min("v").over(w)).where("kind = 1").select("clip_key", F.col("v").alias("after"))
    j = spans.join(before, "clip_key", "left").join(after, "clip_key", "left")
    s, e, p = F.col("main_start"), F.col("main_end"), params
    fits = lambda v, gap, extra: F.coalesce((gap <= p.scene_gap) & (v["end_time"] - v["start_time"] <= p.neighbour_max) & (extra <= p.context_extra), F.lit(False))
    b, a = F.col("before"), F.col("after")
    cs = F.when(fits(b, s - b["end_time"], s - b["start_time"]), b["start_time"]).otherwise(s)
    ce = F.when(fits(a, a["start_time"] - e, a["end_time"] - e), a["end_time"]).otherwise(e)
    over = ce - cs + p.pad_start + p.pad_end > p.clip_max
    return j.withColumn("ctx_start", F.when(over, s).otherwise(cs)).withColumn("ctx_end", F.when(over, e).otherwise(ce)).drop("before", "after")


def gap_midpoints(segments: DataFrame) -> DataFrame:
    """EPISODE, seq_index, mid: the middle of each silence between a segment and the next."""
    following = F.lead("start_time").over(Window.partitionBy(*EPISODE).orderBy("seq_index"))
    return segments.select(*EPISODE, "seq_index", "end_time", following.alias("next_start")).where("next_start > end_time").select(*EPISODE, "seq_index", ((F.col("end_time") + F.col("next_start")) / 2.0).alias("mid"))


def snap(spans: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Spans with cut_start and cut_end: raw_start and raw_end moved to the nearest silence at a fitting distance; both stay if they would cross."""
    mids = gap_midpoints(segments)
    moved = _nearest_end(spans, mids, "raw_start", "mid", params.snap_max, "near_start", params.snap_min, open_=False)
    moved = _nearest_end(moved, mids, "raw_end", "mid", params.snap_max, "near_end", params.snap_min, open_=False)
    s, e = F.coalesce("near_start", "raw_start"), F.coalesce("near_end", "raw_end")
    crossed = e <= s + 0.2
    return moved.withColumn("cut_start", F.when(crossed, F.col("raw_start")).otherwise(s)).withColumn("cut_end", F.when(crossed, F.col("raw_end")).otherwise(e)).drop("near_start", "near_end")


def cut_plan(spans: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Context, padding and silences: spans with ctx_*, raw_*, cut_* and duration."""
    grown = context(spans, segments, params)
    padded = grown.withColumn("raw_start", F.greatest(F.lit(0.0), F.col("ctx_start") - params.pad_start)).withColumn("raw_end", F.col("ctx_end") + params.pad_end)
    return snap(padded, segments, params).withColumn("duration", F.round(F.col("cut_end") - F.col("cut_start"), 2))


def fallback_spans(nodes: DataFrame, planned: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Spans of nodes without a planned clip, from their own times moved to nearby segments: clip_key, EPISODE, main_start, main_end, confidence."""
    padded = F.col("end_time") - F.col("start_time") + params.pad_start + params.pad_end
    rest = nodes.where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & padded.between(params.clip_min, params.clip_max)).join(planned.select("node_id"), "node_id", "left_anti")
    anchored = anchor(rest.select(F.col("node_id").alias("clip_key"), *EPISODE, "start_time", "end_time"), segments, params)
    return anchored.select("clip_key", *EPISODE, F.col("anchor_start").alias("main_start"), F.col("anchor_end").alias("main_end"), F.lit(params.fallback_confidence).alias("confidence"))


def plan_clips(nodes: DataFrame, segments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The table of cuts of all episodes: aligned nodes first, the others by their own times. Merged segments and jobs are read several times and kept."""
    merged = kept(merge_segments(segments, EPISODE, params))
    jobs = kept(gate_alignments(align(nodes, merged, params), params).where("outcome = 'job'"))
    aligned = jobs.select(F.col("node_id").alias("clip_key"), *EPISODE, F.col("whisper_start").alias("main_start"), F.col("whisper_end").alias("main_end"), "confidence", F.col("align_step"))
    fallback = fallback_spans(nodes, jobs.select("node_id"), merged, params).withColumn("align_step", F.lit("subtitle_fallback"))
    return cut_plan(aligned.unionByName(fallback), merged, params)


def outcome_counts(plan: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """How many clips are of high and low confidence, and from fallbacks."""
    fallback = F.col("align_step") == "subtitle_fallback"
    return plan.agg(F.count_if(~fallback & (F.col("confidence") >= params.high_confidence)).alias("high_conf"), F.count_if(~fallback & (F.col("confidence") < params.high_confidence)).alias("low_conf"), F.count_if(fallback).alias("subtitle_fallback"))
