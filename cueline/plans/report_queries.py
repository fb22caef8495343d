"""Queries of reports, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import reports as R
from cueline.operators import search as S
from cueline.operators.quality import first_per_key
from cueline.plans.base import clips, feedback, lines, nodes, query, segments, table

ZH = "coalesce(zh_text, '') <> ''"


@query(
    "node_status",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {v} AS value, count(*) AS total, count_if({ZH}) AS with_zh, count_if(needs_translation) AS needs_translation, round(count_if({ZH}) / count(*), 4) AS zh_rate FROM nodes WHERE is_active GROUP BY {v}"
        for d, v in [("all", "'all'"), ("difficulty", "difficulty"), ("scene", "scene"), ("tag_source", "tag_source"), ("show", "show_name")]
    ),
    ("nodes",),
)
def node_status(spark, sf_dir):
    return R.node_status(nodes(spark, sf_dir))


@query("shows", "SELECT show_name, count(*) AS n FROM nodes WHERE is_active GROUP BY show_name", ("nodes",))
def shows(spark, sf_dir):
    return R.shows(nodes(spark, sf_dir))


@query("episodes", "SELECT show_name, episode, count(*) AS n FROM nodes GROUP BY show_name, episode", ("nodes",))
def episodes(spark, sf_dir):
    return R.episodes(nodes(spark, sf_dir))


RAW = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('b', CAST(doc_id % 40 AS VARCHAR)) END AS subtitle_code, source AS show_name, concat('en ', source) AS en_name, concat('E', CAST(doc_id % 3 AS VARCHAR)) AS episode, CASE WHEN doc_id % 2 = 0 THEN 'tv' ELSE 'talk' END AS content_type, doc_id AS created_at"


def _raw(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("raw_documents__")
    return spark.sql(f"SELECT {RAW.replace('VARCHAR', 'STRING')} FROM raw_documents__")


@query("batches", f"SELECT subtitle_code, show_name, en_name, episode, content_type, count(*) AS line_count, min(created_at) AS created_at FROM (SELECT {RAW} FROM documents) WHERE subtitle_code IS NOT NULL GROUP BY ALL")
def batches(spark, sf_dir):
    return R.batches(_raw(spark, sf_dir))


@query("batches_of_show", f"SELECT subtitle_code, show_name, en_name, episode, content_type, count(*) AS line_count, min(created_at) AS created_at FROM (SELECT {RAW} FROM documents) WHERE subtitle_code IS NOT NULL AND show_name = 'src1' GROUP BY ALL")
def batches_of_show(spark, sf_dir):
    return R.batches(_raw(spark, sf_dir), "src1", "tv")


@query(
    "upload_shows",
    f"SELECT show_name, content_type, en_name FROM (SELECT show_name, content_type, min(en_name) AS en_name, row_number() OVER (PARTITION BY show_name ORDER BY content_type) AS r FROM (SELECT {RAW} FROM documents) GROUP BY show_name, content_type) WHERE r = 1 AND show_name IN (SELECT concat('src', CAST(item_id AS VARCHAR)) FROM benchmark)",
)
def upload_shows(spark, sf_dir):
    return R.upload_shows(_raw(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("show_name")))


@query(
    "clip_quality",
    """SELECT show_name, episode, CAST(grouping(show_name) * 2 + grouping(episode) AS INTEGER) AS level, count(*) AS total, count_if(clip_status = 'matched') AS matched, count_if(clip_status = 'unmatched') AS unmatched, count_if(clip_status = 'failed') AS failed,
    round(coalesce(avg(match_confidence), 0), 4) AS avg_confidence FROM clips GROUP BY ROLLUP (show_name, episode)""",
    ("clips",),
)
def clip_quality(spark, sf_dir):
    return R.clip_quality(clips(spark, sf_dir))


@query("clip_status", "SELECT clip_status, count(*) AS n FROM clips GROUP BY clip_status", ("clips",))
def clip_status(spark, sf_dir):
    return R.clip_status(clips(spark, sf_dir), nodes(spark, sf_dir))


@query("clip_status_of_type", "SELECT clip_status, count(*) AS n FROM clips WHERE node_id IN (SELECT node_id FROM nodes WHERE content_type = 'talk') GROUP BY clip_status", ("clips", "nodes"))
def clip_status_of_type(spark, sf_dir):
    return R.clip_status(clips(spark, sf_dir), nodes(spark, sf_dir), "talk")


@query("clip_breakdown", "SELECT show_name, count_if(clip_status = 'matched') AS matched, count_if(clip_status = 'unmatched') AS unmatched, count_if(clip_status = 'failed') AS failed FROM clips GROUP BY show_name", ("clips",))
def clip_breakdown(spark, sf_dir):
    return R.clip_breakdown(clips(spark, sf_dir), ["matched", "unmatched", "failed"])


@query("failed_nodes", "SELECT DISTINCT node_id FROM clips WHERE clip_status = 'failed'", ("clips",))
def failed_nodes(spark, sf_dir):
    return R.failed_nodes(clips(spark, sf_dir))


@query("best_clips", "SELECT node_id, clip_id, match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY match_confidence DESC NULLS LAST, clip_id) AS r FROM clips WHERE is_active AND clip_status = 'matched') WHERE r = 1", ("clips",))
def best_clips(spark, sf_dir):
    return S.best_clip(clips(spark, sf_dir)).select("node_id", "clip_id", "match_confidence")


@query("clips_of_nodes", "SELECT clip_id, node_id, scene FROM clips JOIN nodes USING (node_id) WHERE content_type = 'tv' AND clip_status = 'failed'", ("clips", "nodes"))
def clips_of_nodes(spark, sf_dir):
    own = S.all_of(nodes(spark, sf_dir).select("node_id", "scene", "content_type"), {"content_type": "tv", "scene": None})
    return S.all_of(clips(spark, sf_dir), {"clip_status": "failed"}).join(own, "node_id").select("clip_id", "node_id", "scene")


@query("video_status", "SELECT count(*) AS total, count_if(s_nationkey % 2 = 0) AS with_transcript, count(*) - count_if(s_nationkey % 2 = 0) AS without_transcript, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS clipped FROM supplier")
def video_status(spark, sf_dir):
    return R.video_status(table(spark, sf_dir, "supplier").selectExpr("s_nationkey % 2 = 0 AS has_transcript", "CASE WHEN s_acctbal > 0 THEN 1 END AS last_clipped_at"))


RECENT = "(SELECT * FROM feedback WHERE created_at >= (SELECT max(created_at) FROM feedback) - INTERVAL 7 DAY)"


@query("feedback_by_action", f"SELECT action, count(*) AS n FROM {RECENT} GROUP BY action", ("feedback",))
def feedback_by_action(spark, sf_dir):
    return R.feedback_by_action(feedback(spark, sf_dir), 7)


@query("feedback_top", f"SELECT query, count(*) AS n FROM {RECENT} GROUP BY query ORDER BY n DESC, query LIMIT 20", ("feedback",))
def feedback_top(spark, sf_dir):
    return R.feedback_top(feedback(spark, sf_dir), 7)


@query("provider_stats", "SELECT l_shipmode AS provider, count(*) AS calls, round(sum(seconds), 4) AS seconds FROM (SELECT l_returnflag AS l_shipmode, l_quantity / 10 AS seconds FROM lineitem) GROUP BY 1")
def provider_stats(spark, sf_dir):
    return R.provider_stats(table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS provider", "l_quantity / 10 AS seconds"))


@query("node_detail", "SELECT node_id, coalesce(sources, []) AS sources FROM nodes LEFT JOIN (SELECT node_id, list_sort(list(concat_ws('/', show_name, episode))) AS sources FROM clips GROUP BY node_id) USING (node_id)", ("nodes", "clips"))
def node_detail(spark, sf_dir):
    return R.node_detail(nodes(spark, sf_dir), clips(spark, sf_dir)).select("node_id", "sources")


@query("node_page", "SELECT node_id, quality_score FROM nodes WHERE is_active AND scene = 'work' ORDER BY quality_score DESC NULLS LAST, node_id LIMIT 10 OFFSET 20", ("nodes",))
def node_page(spark, sf_dir):
    own = S.all_of(nodes(spark, sf_dir), {"scene": "work", "difficulty": None}, {"is_active": True})
    return R.paged(own, [F.desc_nulls_last("quality_score"), F.col("node_id")], 3, 10).select("node_id", "quality_score")


@query("coverage", "SELECT count(*) AS total, count(embedding) AS en_vectors, count(zh) AS zh_vectors, round(count(zh) / count(*), 4) AS zh_coverage FROM (SELECT label < 8 AS is_active, embedding, CASE WHEN label < 3 THEN embedding END AS zh FROM embeddings) WHERE is_active")
def coverage(spark, sf_dir):
    return S.coverage(table(spark, sf_dir, "embeddings").selectExpr("label < 8 AS is_active", "embedding", "CASE WHEN label < 3 THEN embedding END AS zh_embedding"))


@query("keyword_search", "WITH f AS (SELECT * FROM nodes WHERE is_active AND (contains(lower(en_text), 'thing') OR contains(lower(coalesce(zh_text, '')), 'thing'))) SELECT node_id, quality_score, (SELECT count(*) FROM f) AS total FROM f ORDER BY quality_score DESC NULLS LAST, node_id LIMIT 10 OFFSET 5", ("nodes",))
def keyword_search(spark, sf_dir):
    return S.keyword_search(nodes(spark, sf_dir), "THING", 5, 10).select("node_id", "quality_score", "total")


@query("ids_without_clips", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM clips WHERE node_id IS NOT NULL)", ("nodes", "clips"))
def ids_without_clips(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id").join(clips(spark, sf_dir), "node_id", "left_anti")


@query("ids_without_matches", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM clips WHERE node_id IS NOT NULL AND is_active AND clip_status = 'matched')", ("nodes", "clips"))
def ids_without_matches(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id").join(clips(spark, sf_dir).where("is_active AND clip_status = 'matched'"), "node_id", "left_anti")


@query("shows_with_nodes", "SELECT DISTINCT source AS show_name FROM documents INTERSECT SELECT show_name FROM nodes WHERE is_active", ("nodes",))
def shows_with_nodes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("show_name")).intersect(nodes(spark, sf_dir).where("is_active").select("show_name"))


@query("first_lines", "SELECT doc_id, line_id FROM lines WHERE pos = 0", ("lines",))
def first_lines(spark, sf_dir):
    return first_per_key(lines(spark, sf_dir), ["doc_id"], [F.col("pos")]).select("doc_id", "line_id")


@query("segments", "SELECT show_name, seq_index, start_time, end_time FROM segments", ("segments",))
def segment_times(spark, sf_dir):
    return segments(spark, sf_dir).select("show_name", "seq_index", "start_time", "end_time")
