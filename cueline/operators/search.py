"""Ranked search over nodes: signals from vectors and tags, cut-offs, paging, and a keyword fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.ranking import final_score, hint, tag_score
from cueline.functions.lexicon import EMOTION_HINTS, SCENE_HINTS
from cueline.functions.text import contains_text
from cueline.operators.quality import first_per_key
from cueline.operators.vectors import nearest
from cueline.params import DEFAULT, Params

SIGNALS = ["zh", "en", "translated"]


def all_of(table: DataFrame, equal: dict | None = None, has: dict | None = None) -> DataFrame:
    """Rows that meet every condition that is given: equalities (None is no condition) and flags that only filter when true."""
    conditions = [F.col(k) == v for k, v in (equal or {}).items() if v is not None] + [F.col(k) for k, v in (has or {}).items() if v]
    return table.where(reduce(Column.__and__, conditions)) if conditions else table


def query_hints(queries: DataFrame) -> DataFrame:
    """Queries with the scene and emotion that their text hints at."""
    return queries.withColumn("want_scene", hint(F.col("text"), SCENE_HINTS)).withColumn("want_emotion", hint(F.col("text"), EMOTION_HINTS))


def recall_size(offset: int, limit: int, params: Params = DEFAULT) -> int:
    return max(params.recall_k, offset + limit + params.recall_extra)


def gather(hits: DataFrame) -> DataFrame:
    """One row per query and node with the best of each signal, 0 where a signal has not found it.

    hits: query_id, node_id, signal, similarity; several candidates of one signal count by their best, and only above 0.
    """
    one = lambda s: F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("signal") == s, F.col("similarity"))), F.lit(0.0))).alias(s)
    return hits.groupBy("query_id", "node_id").agg(*[one(s) for s in SIGNALS])


def rank(candidates: DataFrame, nodes: DataFrame, queries: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Scores of candidates, without those that no signal finds similar, and without those too far below the best of their query.

    nodes: node_id, scene, emotion, quality_score, occurrence_count, is_active; queries: query_id, want_scene, want_emotion.
    """
    similar = candidates.where(F.greatest(*SIGNALS) >= params.min_similarity)
    found = similar.join(nodes.where("is_active").select("node_id", "scene", "emotion", "quality_score", "occurrence_count"), "node_id").join(queries.select("query_id", "want_scene", "want_emotion"), "query_id")
    quality = F.when(F.coalesce("quality_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("quality_score"))
    count = F.when(F.coalesce("occurrence_count", F.lit(0)) == 0, 1).otherwise(F.col("occurrence_count"))
    tag = tag_score(F.col("scene"), F.col("emotion"), F.col("want_scene"), F.col("want_emotion"))
    scored = found.withColumn("tag", tag).withColumn("score", final_score(F.col("zh"), F.col("en"), F.col("translated"), F.col("tag"), quality, count, params))
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("best__", best).where(F.col("score") >= F.col("best__") - params.relative_cut).drop("best__")


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of a page with their position from 1 and the total of the query; ties go to the lower node."""
    w = Window.partitionBy("query_id")
    placed = ranked.withColumn("position", F.row_number().over(w.orderBy(F.desc("score"), "node_id"))).withColumn("total", F.count(F.lit(1)).over(w))
    return placed.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def best_clip(clips: DataFrame) -> DataFrame:
    """The active, matched clip of highest confidence of each node."""
    return first_per_key(clips.where("is_active AND clip_status = 'matched'"), ["node_id"], [F.desc_nulls_last("match_confidence"), F.col("clip_id")])


def semantic_search(queries: DataFrame, nodes: DataFrame, clips: DataFrame | None = None, offset: int = 0, limit: int = 20, params: Params = DEFAULT) -> DataFrame:
    """A page of hits for each query.

    queries: query_id, text, embedding (of the query, compared with both indexes' vectors), candidates (array of vectors of
    translated phrasings). nodes: node_id, embedding, zh_embedding and what rank() needs.
    """
    k = recall_size(offset, limit, params)
    english = nodes.select("node_id", "embedding")
    chinese = nodes.select("node_id", F.col("zh_embedding").alias("embedding"))
    tried = queries.select("query_id", F.posexplode("candidates").alias("n", "embedding")).withColumn("key", F.shiftleft(F.col("query_id").cast("long"), 16) + F.col("n"))  # up to 65,536 phrasings a query
    hits = (
        nearest(queries, chinese, k).withColumn("signal", F.lit("zh"))
        .unionByName(nearest(queries, english, k).withColumn("signal", F.lit("en")))
        .unionByName(nearest(tried, english, k, "key").withColumn("query_id", F.shiftright("key", 16)).drop("key").withColumn("signal", F.lit("translated")))
    )
    out = page(rank(gather(hits), nodes, query_hints(queries), params), offset, limit)
    if clips is None:
        return out
    return out.join(best_clip(clips).select("node_id", "clip_id", "match_confidence"), "node_id", "left")


def keyword_search(nodes: DataFrame, needle: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """Active nodes that contain the text in either language, best quality first, with the total before the page."""
    found = nodes.where(F.col("is_active") & (contains_text(F.col("en_text"), F.lit(needle)) | contains_text(F.col("zh_text"), F.lit(needle))))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc_nulls_last("quality_score"), "node_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def coverage(nodes: DataFrame) -> DataFrame:
    """Active nodes, those with a vector of either language, and the share of translated ones."""
    active = nodes.where("is_active")
    total = F.count(F.lit(1))
    return active.agg(total.alias("total"), F.count("embedding").alias("en_vectors"), F.count("zh_embedding").alias("zh_vectors"), F.when(total > 0, F.round(F.count("zh_embedding") / F.greatest(total, F.lit(1)), 4)).otherwise(0.0).alias("zh_coverage"))
