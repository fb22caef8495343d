"""Repairs of the knowledge base at large: tags and vectors that are missing, durations, clips that are made anew. Tables in, new versions of tables out;
`sources.snapshots` switches those of several tables at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import word_count
from cueline.operators.lifecycle import retag
from cueline.operators.search import all_of
from cueline.operators.services import Service, tag_lines
from cueline.operators.vectors import encode
from cueline.workers import let_workers_import

EPISODE = ["show_name", "episode"]
TAGS = ["scene", "emotion", "difficulty", "keywords", "speech_act", "tag_source"]


def _tags(scope: DataFrame, services: dict[str, Service], **how) -> DataFrame:
    """node_id and tags of nodes, asked for in blocks of an episode by node_id."""
    words = F.when(F.coalesce("word_count", F.lit(0)) == 0, word_count(F.col("en_text"))).otherwise(F.col("word_count"))
    lines = scope.select(*EPISODE, F.col("node_id").alias("line_id"), F.col("en_text").alias("text"), words.alias("word_count"))
    return tag_lines(lines, EPISODE, ["line_id"], services, **how).withColumnRenamed("line_id", "node_id")


def retag_nodes(nodes: DataFrame, services: dict[str, Service], show: str | None = None, episode: str | None = None, only_rule: bool = True, **how) -> DataFrame:
    """Nodes with new tags where they are in scope: of the show and the episode, if these are named, and tagged by the rule, unless all are asked for.

    how: size, attempts and pause of the services. What services fail to answer gets rule tags, as ever.
    """
    scope = all_of(nodes, {"tag_source": "rule" if only_rule else None, "show_name": show or None, "episode": episode or None})
    return retag(nodes, _tags(scope, services, **how).select("node_id", *TAGS))


def fill_speech_acts(nodes: DataFrame, services: dict[str, Service], show: str | None = None, everything: bool = False, **how) -> DataFrame:
    """Nodes with the speech act of active ones that have none, or of all active ones; other tags stay."""
    scope = all_of(nodes.where("is_active"), {"show_name": show or None})
    scope = scope if everything else scope.where("speech_act IS NULL")
    return retag(nodes, _tags(scope, services, **how).select("node_id", "speech_act"))


def lacks_zh_vector() -> Column:
    """Whether a node has a Chinese text and no vector of it."""
    return F.coalesce(F.col("zh_text") != "", F.lit(False)) & F.col("zh_embedding").isNull()


def fill_zh_vectors(nodes: DataFrame, model: Callable, dim: int) -> DataFrame:
    """Nodes with the vectors of Chinese texts that have none yet; the model sees only these."""
    rows = nodes.withColumnRenamed("embedding", "en__").withColumn("todo__", F.when(lacks_zh_vector(), F.col("zh_text")))
    made = encode(rows, model, dim, "todo__").withColumn("zh_embedding", F.when(F.col("todo__").isNotNull(), F.col("embedding")).otherwise(F.col("zh_embedding")))
    return made.drop("embedding").withColumnRenamed("en__", "embedding").select(*nodes.columns)


def media_path(url: Column) -> Column:
    """The path below the media folder that a stream's address means."""
    return F.regexp_replace(F.ltrim(url, F.lit("/")), "^media/", "")


def fill_durations(clips: DataFrame, probe: Callable[[str], float | None], tolerance: float = 0.1) -> DataFrame:
    """Clips with the duration that their file has, and probed: 'updated', 'kept' or 'skipped', null for clips that are not asked for.

    Asked for are matched clips with an address. probe: seconds of the file at a path, None if there are none; a file that raises is skipped. A duration
    changes if it is missing or more than `tolerance` away. clips: clip_status, stream_url, duration.
    """
    let_workers_import(clips.sparkSession)

    def seconds(path: str | None) -> float | None:
        try:
            found = None if path is None else probe(path)
        except Exception:  # whatever is wrong with a file, the others go on
            return None
        return None if found is None else round(float(found), 2)

    @F.pandas_udf("double")
    def run(paths):
        return paths.map(seconds).astype(object).where(lambda x: x.notna(), None)

    asked = (F.col("clip_status") == "matched") & (F.col("stream_url") != "")
    real = clips.withColumn("asked__", F.coalesce(asked, F.lit(False))).withColumn("real__", run(F.when(asked, media_path(F.col("stream_url")))))
    off = F.col("duration").isNull() | (F.abs(F.col("real__") - F.col("duration")) > tolerance)
    outcome = F.when(~F.col("asked__"), None).when(F.col("real__").isNull(), "skipped").when(off, "updated").otherwise("kept")
    return real.withColumn("probed", outcome).withColumn("duration", F.when(F.col("probed") == "updated", F.col("real__")).otherwise(F.col("duration"))).drop("asked__", "real__")


def duration_counts(filled: DataFrame) -> DataFrame:
    """How many clips were asked for, changed and skipped."""
    return filled.agg(F.count("probed").alias("total"), F.count_if(F.col("probed") == "updated").alias("updated"), F.count_if(F.col("probed") == "skipped").alias("skipped"))


def videos_of(requests: DataFrame, videos: DataFrame, by_show: bool) -> DataFrame:
    """show_name, asked (the episode that was asked for, '' for none), video_id and episode of the video, null where there is none.

    The video is that of the show and the episode; without one, if by_show, the show's first. Of several the lowest id is meant.
    """
    asked = requests.select("show_name", F.coalesce("episode", F.lit("")).alias("asked")).distinct()
    exact = videos.groupBy("show_name", F.col("episode").alias("asked")).agg(F.min("video_id").alias("exact_id"))
    found = asked.join(exact, ["show_name", "asked"], "left")
    if not by_show:
        return found.select("show_name", "asked", F.col("exact_id").alias("video_id"), F.when(F.col("exact_id").isNotNull(), F.col("asked")).alias("episode"))
    first = videos.groupBy("show_name").agg(F.min("video_id").alias("first_id"), F.min_by("episode", "video_id").alias("first_episode"))
    episode = F.when(F.col("exact_id").isNotNull(), F.col("asked")).otherwise(F.col("first_episode"))
    return found.join(first, "show_name", "left").select("show_name", "asked", F.coalesce("exact_id", "first_id").alias("video_id"), episode.alias("episode"))


def reset_clips(clips: DataFrame, nodes: DataFrame, videos: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips without those of the episodes that are made anew, nodes of these episodes without their flag, and the videos to run.

    requests: show_name, episode; those without a video change nothing. The episode that counts is the video's. Nodes lose has_any_clip by their own
    show and episode, whatever clips of other episodes they may have.
    """
    runs = videos_of(requests, videos, by_show=True)
    again = runs.where("video_id IS NOT NULL").select(*EPISODE).distinct()
    flagged = nodes.join(again.withColumn("hit__", F.lit(True)), EPISODE, "left").withColumn("has_any_clip", F.when(F.col("hit__"), F.lit(False)).otherwise(F.col("has_any_clip")))
    return clips.join(again, EPISODE, "left_anti"), flagged.drop("hit__").select(*nodes.columns), runs


def retry_failed(clips: DataFrame, videos: DataFrame, requests: DataFrame) -> DataFrame:
    """show_name, episode, video_id and node_id of what is to be cut again: each node once that has a failed clip in an episode asked for, if its video is there."""
    runs = videos_of(requests, videos, by_show=False).where("video_id IS NOT NULL").select(*EPISODE, "video_id")
    return clips.where("clip_status = 'failed'").select(*EPISODE, "node_id").distinct().join(runs, EPISODE).select(*EPISODE, "video_id", "node_id")


def clear_all(nodes: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without rows, and nodes without their flags, by name."""
    return {**{name: rows.where(F.lit(False)) for name, rows in tables.items()}, "nodes": nodes.withColumn("has_any_clip", F.lit(False))}
