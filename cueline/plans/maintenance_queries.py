"""Queries of repairs at large, of tables that change together, of an index that grows, and of queries that are expanded."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from cueline.operators import maintenance as R
from cueline.operators import services as S
from cueline.operators.lifecycle import flag_clips
from cueline.operators.vectors import nearest
from cueline.plans.base import NEEDS, VIEWS, clips, literal, nodes, query, table
from cueline.plans.search_queries import COS, _asked, _index, _turns
from cueline.sources import segments as I
from cueline.sources import snapshots
from cueline.workers import shared_folder

SHOWS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
VIEWS["people"] = f"SELECT c_custkey, list_element({literal(SHOWS)}, CAST(c_custkey % 5 AS INTEGER) + 1) AS show_name FROM customer"
VIEWS["films"] = "SELECT min(c_custkey) AS video_id, show_name, concat('E', CAST(c_custkey // 5 % 8 AS VARCHAR)) AS episode FROM people GROUP BY ALL"
VIEWS["played"] = "SELECT c_custkey AS node_id, show_name, concat('E', CAST(c_custkey // 7 % 10 AS VARCHAR)) AS episode, c_custkey IN (SELECT node_id FROM clips) AS has_any_clip FROM people"
VIEWS["wanted"] = "SELECT DISTINCT show_name, episode FROM clips WHERE episode IN ('E2', 'E9') AND show_name <> '2-HIGH' UNION ALL SELECT '2-HIGH', NULL UNION ALL SELECT '6-NONE', 'E1'"
VIEWS["runs"] = """SELECT w.show_name, coalesce(w.episode, '') AS asked, coalesce(f.video_id, s.video_id) AS video_id, coalesce(f.episode, s.episode) AS episode
    FROM wanted w LEFT JOIN films f ON f.show_name = w.show_name AND f.episode = coalesce(w.episode, '') LEFT JOIN (SELECT show_name, min(video_id) AS video_id, arg_min(episode, video_id) AS episode FROM films GROUP BY 1) s ON s.show_name = w.show_name"""
NEEDS["films"] = ("people",)
NEEDS["played"], NEEDS["wanted"] = ("people", "clips"), ("clips",)
NEEDS["runs"] = ("people", "clips", "films", "wanted")


def _tables(spark, sf_dir):
    """Version 1 of clips, nodes, videos and transcripts that change together, in a new folder."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in SHOWS]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("show_name"))
    part = lambda by, n: F.concat(F.lit("E"), (F.floor(F.col("c_custkey") / by) % n).cast("string"))
    own = clips(spark, sf_dir)
    videos = people.groupBy("show_name", part(5, 8).alias("episode")).agg(F.min("c_custkey").alias("video_id"))
    known = flag_clips(people.select(F.col("c_custkey").alias("node_id"), "show_name", part(7, 10).alias("episode")), own)
    path = shared_folder(spark, "tables")
    snapshots.commit(spark, path, {"clips": own, "nodes": known, "videos": videos, "transcripts": table(spark, sf_dir, "conversations")}, 0)
    return path


def _of(spark, path, version, *names):
    return [snapshots.read_table(spark, path, n, version) for n in names]


def _wanted(spark, own):
    some = own.where("episode IN ('E2', 'E9') AND show_name <> '2-HIGH'").select("show_name", "episode").distinct()
    return some.unionByName(spark.createDataFrame([("2-HIGH", None), ("6-NONE", "E1")], "show_name string, episode string"))


@query(
    "reset_and_rerun",
    """SELECT 'clip' AS kind, clip_id AS id, NULL::BOOLEAN AS flag FROM clips WHERE (show_name, episode) NOT IN (SELECT (show_name, episode) FROM runs WHERE video_id IS NOT NULL)
    UNION ALL SELECT 'node', node_id, has_any_clip AND (show_name, episode) NOT IN (SELECT (show_name, episode) FROM runs WHERE video_id IS NOT NULL) FROM played""",
    ("runs", "played"),
)
def reset_and_rerun(spark, sf_dir):
    """Clips and nodes after a reset, switched together."""
    path = _tables(spark, sf_dir)
    own, known, videos = _of(spark, path, 1, "clips", "nodes", "videos")
    left, flagged, _ = R.reset_clips(own, known, videos, _wanted(spark, own))
    version = snapshots.commit(spark, path, {"clips": left, "nodes": flagged}, 1)
    left, flagged = _of(spark, path, version, "clips", "nodes")
    return left.select(F.lit("clip").alias("kind"), F.col("clip_id").alias("id"), F.lit(None).cast("boolean").alias("flag")).unionByName(flagged.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("has_any_clip").alias("flag")))


@query("rerun_videos", "SELECT * FROM runs", ("runs",))
def rerun_videos(spark, sf_dir):
    own, known, videos = _of(spark, _tables(spark, sf_dir), 1, "clips", "nodes", "videos")
    return R.reset_clips(own, known, videos, _wanted(spark, own))[2]


@query("retry_failed", "SELECT DISTINCT show_name, episode, video_id, node_id FROM clips JOIN films USING (show_name, episode) WHERE clip_status = 'failed' AND (show_name, episode) IN (SELECT (show_name, episode) FROM wanted)", ("films", "wanted"))
def retry_failed(spark, sf_dir):
    own, videos = _of(spark, _tables(spark, sf_dir), 1, "clips", "videos")
    return R.retry_failed(own, videos, _wanted(spark, own))


@query(
    "clear_all",
    """SELECT * FROM (SELECT 1 AS version, 'clips' AS name, count(*) AS n, 0 AS flagged FROM clips UNION ALL SELECT 1, 'videos', count(*), 0 FROM films UNION ALL SELECT 1, 'transcripts', count(*), 0 FROM conversations
    UNION ALL SELECT unnest([1, 2]), 'nodes', count(*), unnest([count_if(has_any_clip), 0]) FROM played UNION ALL SELECT 2, unnest(['clips', 'videos', 'transcripts']), 0, 0)""",
    ("films", "played"),
)
def clear_all(spark, sf_dir):
    """Rows, and nodes with the flag, before and after; the version before is still there."""
    path = _tables(spark, sf_dir)
    own, known, videos, said = _of(spark, path, 1, "clips", "nodes", "videos", "transcripts")
    snapshots.commit(spark, path, R.clear_all(known, clips=own, videos=videos, transcripts=said), 1)
    out = None
    for version in (1, 2):
        for name in ("clips", "nodes", "videos", "transcripts"):
            rows = snapshots.read_table(spark, path, name, version)
            flag = F.count_if("has_any_clip") if name == "nodes" else F.lit(0).cast("long")
            one = rows.agg(F.count(F.lit(1)).alias("n"), flag.alias("flagged")).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n", "flagged")
            out = one if out is None else out.unionByName(one)
    return out


def tagger(texts: list[str], before: list[str]) -> str:
    """Answers as the lengths of the texts say; fails if the first one's is divisible by 5."""
    if len(texts[0]) % 5 == 0:
        raise RuntimeError("busy")
    return json.dumps([{"scene": ("work", "humor", "nowhere")[len(t) % 3], "emotion": "happy", "keywords": [str(len(t))], "speech_act": "warning"} for t in texts])


HOW = {"size": 2, "attempts": 1}
BLOCKS = """, r AS (SELECT *, (row_number() OVER (PARTITION BY show_name, episode ORDER BY node_id) - 1) // 2 AS block, length(coalesce(en_text, '')) AS n,
    CASE WHEN coalesce(word_count, 0) = 0 THEN len(regexp_extract_all(coalesce(en_text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) ELSE word_count END AS words FROM nodes WHERE {scope}),
    t AS (SELECT node_id, n, words, first_value(n) OVER (PARTITION BY show_name, episode, block ORDER BY node_id) % 5 <> 0 AS ok FROM r)"""


def _tagged(spark, sf_dir):
    act = F.when(F.col("node_id") % 4 == 0, F.lit("promising"))
    return nodes(spark, sf_dir).withColumn("keywords", F.array(F.lit("old"))).withColumn("speech_act", act)


@query(
    "retag_nodes",
    BLOCKS.format(scope="tag_source = 'rule'") + """ SELECT node_id, CASE WHEN ok IS NULL THEN scene WHEN ok THEN ['work', 'humor', 'daily'][n % 3 + 1] ELSE 'daily' END AS scene, CASE WHEN ok IS NULL THEN emotion WHEN ok THEN 'happy' ELSE 'neutral' END AS emotion,
    CASE WHEN ok IS NULL THEN difficulty WHEN ok THEN 'intermediate' WHEN words <= 8 THEN 'beginner' WHEN words <= 20 THEN 'intermediate' ELSE 'advanced' END AS difficulty, CASE WHEN ok IS NULL THEN 'old' WHEN ok THEN CAST(n AS VARCHAR) ELSE '' END AS keywords,
    CASE WHEN ok IS NULL THEN CASE WHEN node_id % 4 = 0 THEN 'promising' END WHEN ok THEN 'warning' ELSE 'neutral_statement' END AS speech_act, CASE WHEN ok IS NULL THEN tag_source WHEN ok THEN 'main' ELSE 'rule' END AS tag_source FROM nodes LEFT JOIN t USING (node_id)""",
    ("nodes",),
)
def retag_nodes(spark, sf_dir):
    return R.retag_nodes(_tagged(spark, sf_dir), {"main": tagger}, **HOW).withColumn("keywords", F.array_join("keywords", ",")).select("node_id", *R.TAGS)


@query(
    "fill_speech_acts",
    BLOCKS.format(scope="is_active AND node_id % 4 <> 0") + " SELECT node_id, scene, CASE WHEN node_id % 4 = 0 THEN 'promising' WHEN ok THEN 'warning' WHEN NOT ok THEN 'neutral_statement' END AS speech_act FROM nodes LEFT JOIN t USING (node_id)",
    ("nodes",),
)
def fill_speech_acts(spark, sf_dir):
    return R.fill_speech_acts(_tagged(spark, sf_dir), {"main": tagger}, **HOW).select("node_id", "scene", "speech_act")


def model(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("s")), 1.0] for t in texts]


@query(
    "fill_zh_vectors",
    """SELECT node_id, zh_text IS NOT NULL AND NOT coalesce(label < 5, FALSE) AS filled, CASE WHEN label < 5 THEN round(v[1], 6) WHEN zh_text IS NOT NULL THEN length(zh_text) END AS head, len(v) AS en_size
    FROM nodes LEFT JOIN vectors ON vec_id = node_id""",
    ("nodes", "vectors"),
)
def fill_zh_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", F.when(F.col("label") < 5, F.col("embedding")).alias("zh_embedding"))
    known = nodes(spark, sf_dir).join(e, "node_id", "left").withColumn("filled", R.lacks_zh_vector())
    return R.fill_zh_vectors(known, model, 3).select("node_id", "filled", F.round(F.get("zh_embedding", F.lit(0)).cast("double"), 6).alias("head"), F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("en_size"))


def probe(path: str) -> float | None:
    """Seconds as the clip's number says; none for some, an error for others."""
    n = int(re.fullmatch(r".+/clip_(\d+)\.mp4", path)[1])
    if n % 7 == 0:
        return None
    if n % 11 == 0:
        raise OSError(path)
    return n % 50 / 10 + n % 4 * 0.08


VIEWS["filmed"] = "SELECT clip_id, clip_status, CASE clip_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('/media/', show_name, '/clip_', CAST(clip_id AS VARCHAR), '.mp4') END AS stream_url, CASE WHEN clip_id % 3 > 0 THEN CAST(clip_id % 50 AS DOUBLE) / 10 END AS duration FROM clips"
VIEWS["probed"] = """SELECT clip_id, CASE WHEN probed = 'updated' THEN round(CAST(clip_id % 50 AS DOUBLE) / 10 + clip_id % 4 * 0.08, 2) ELSE duration END AS duration, probed FROM (SELECT *, CASE WHEN clip_status = 'matched' AND stream_url <> '' THEN
    CASE WHEN clip_id % 7 = 0 OR clip_id % 11 = 0 THEN 'skipped' WHEN duration IS NULL OR clip_id % 4 > 1 THEN 'updated' ELSE 'kept' END END AS probed FROM filmed)"""
NEEDS["filmed"], NEEDS["probed"] = ("clips",), ("clips", "filmed")


def _probed(spark, sf_dir):
    n = F.col("clip_id")
    url = F.when(n % 5 == 0, "").when(n % 5 != 1, F.concat(F.lit("/media/"), "show_name", F.lit("/clip_"), n.cast("string"), F.lit(".mp4")))
    return R.fill_durations(clips(spark, sf_dir).withColumn("stream_url", url).withColumn("duration", F.when(n % 3 > 0, (n % 50).cast("double") / 10)), probe)


@query("fill_durations", "SELECT * FROM probed", ("probed",))
def fill_durations(spark, sf_dir):
    return _probed(spark, sf_dir).select("clip_id", "duration", "probed")


@query("duration_counts", "SELECT count(probed) AS total, count_if(probed = 'updated') AS updated, count_if(probed = 'skipped') AS skipped FROM probed", ("probed",))
def duration_counts(spark, sf_dir):
    return R.duration_counts(_probed(spark, sf_dir))


@query(
    "index_segments",
    f""", n AS (SELECT vec_id, CASE WHEN label = 4 THEN list_reverse(v) ELSE v END AS v FROM vectors WHERE label < 8)
    SELECT query_id, node_id, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, n.vec_id AS node_id, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, n.vec_id) AS r FROM asked q CROSS JOIN n) WHERE r <= 10""",
    ("asked",),
)
def index_segments(spark, sf_dir):
    """Search in an index that was made, added to, retired from, changed and brought in line with the active nodes."""
    rows, path = _index(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "label"), "node_id"), shared_folder(spark, "index")
    I.create_index(rows.where("label <> 1"), path)
    I.retire(rows.where("label = 3").select("node_id"), path)
    I.add_vectors(rows.where("label = 3 AND node_id % 2 = 0"), path)
    I.add_vectors(rows.where("label = 4").withColumn("embedding", F.reverse("embedding")), path)
    I.sync_index(rows, path)
    return nearest(_asked(spark, sf_dir), I.indexed(spark, path), 10).withColumn("similarity", F.round("similarity", 6))


def translate(text: str) -> str | None:
    n = len(text)
    if n % 4 == 1:
        raise TimeoutError
    return None if n % 4 == 0 else f' "en {n}" '


def expand(text: str) -> str | None:
    n = len(text)
    if n % 6 == 0:
        raise TimeoutError
    answers = ["[1]", {"expanded_zh": f" wide {n} ", "candidate_en": ["a", "", None, f" b {n}", "c", "d"]}, {"expanded_zh": "  ", "candidate_en": []}, {}, {"expanded_zh": None, "candidate_en": [" x "]}]
    answer = answers[n % 6 - 1]
    return answer if isinstance(answer, str) else json.dumps(answer)


@query(
    "expand_queries",
    """, q AS (SELECT line_id, text, length(text) AS n FROM turns)
    SELECT line_id, CASE WHEN n % 6 = 2 THEN concat('wide ', n) WHEN n % 6 IN (4, 5) THEN substr(trim(text, E' \\t\\n\\r'), 1, 120) ELSE text END AS expanded_zh,
    CASE n % 6 WHEN 2 THEN concat('a|b ', n, '|c') WHEN 5 THEN 'x' ELSE CASE WHEN n % 4 > 1 THEN concat('en ', n) ELSE '' END END AS phrasings FROM q""",
    ("turns",),
)
def expand_queries(spark, sf_dir):
    return S.expand_queries(_turns(spark, sf_dir), translate, expand).select("line_id", "expanded_zh", F.array_join("candidate_en", "|").alias("phrasings"))
