"""Queries of vector search, ranked search and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import duplicates as D
from cueline.operators import search as S
from cueline.operators import vectors as V
from cueline.plans.base import NEEDS, VIEWS, nodes, query, table
from cueline.plans.text_queries import duplicates_sql

COS = "round(list_cosine_similarity(q.v, n.v), 12)"
VIEWS["vectors"] = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
VIEWS["asked"] = "SELECT vec_id AS query_id, v FROM vectors WHERE vec_id % 20 = 0"
NEEDS["asked"] = ("vectors",)


def _asked(spark, sf_dir):
    """Searches take every row whose id is divisible by 20 as a query, against all rows."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", (F.col("label") < 8).alias("is_active"))


@query("vector_topk", f"SELECT query_id, node_id, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT query_id, n.vec_id AS node_id, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, n.vec_id) AS r FROM asked q CROSS JOIN vectors n) WHERE r <= 10", ("asked",))
def vector_topk(spark, sf_dir):
    return V.nearest(_asked(spark, sf_dir), _index(spark, sf_dir), 10).withColumn("similarity", F.round("similarity", 6))


@query("vector_duplicates", f"WITH t AS (SELECT query_id, n.vec_id AS node_id, n.label, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, n.vec_id) AS r FROM asked q CROSS JOIN vectors n) SELECT query_id AS line_id, min(node_id) AS node_id FROM t WHERE r <= 5 AND s >= 0.95 AND label < 8 GROUP BY query_id", ("asked",))
def vector_duplicates(spark, sf_dir):
    return D.vector_duplicates(_asked(spark, sf_dir).withColumnRenamed("query_id", "line_id"), _index(spark, sf_dir))


@query("index_report", "WITH i AS (SELECT vec_id AS node_id FROM embeddings WHERE label <> 1), w AS (SELECT vec_id AS node_id FROM embeddings WHERE label < 8) SELECT (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM i WHERE node_id IN (SELECT node_id FROM w)) AS live, (SELECT count(*) FROM w WHERE node_id NOT IN (SELECT node_id FROM i)) AS missing, round(1 - (SELECT count(*) FROM i WHERE node_id IN (SELECT node_id FROM w)) / (SELECT count(*) FROM i), 4) AS stale_share, TRUE AS rebuild")
def index_report(spark, sf_dir):
    indexed = table(spark, sf_dir, "embeddings").where("label <> 1").select(F.col("vec_id").alias("node_id"))
    return V.index_report(_index(spark, sf_dir), indexed, 0.05)


@query(
    "semantic_search",
    f"""
    WITH n AS (SELECT nodes.*, v.v, v.label FROM nodes JOIN vectors v ON v.vec_id = node_id),
    en AS (SELECT query_id, node_id, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, node_id) AS r FROM asked q CROSS JOIN n),
    zh AS (SELECT query_id, node_id, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, node_id) AS r FROM asked q CROSS JOIN n WHERE label < 5),
    tr AS (SELECT query_id - 1 AS query_id, node_id, {COS} AS s, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, node_id) AS r FROM (SELECT vec_id AS query_id, v FROM vectors WHERE vec_id % 20 = 1) q CROSS JOIN n),
    h AS (SELECT query_id, node_id, max(zh) AS zh, max(en) AS en, max(tr) AS tr FROM (SELECT query_id, node_id, greatest(s, 0) AS zh, 0 AS en, 0 AS tr FROM zh WHERE r <= 50 UNION ALL SELECT query_id, node_id, 0, greatest(s, 0), 0 FROM en WHERE r <= 50 UNION ALL SELECT query_id, node_id, 0, 0, greatest(s, 0) FROM tr WHERE r <= 50) GROUP BY ALL),
    f AS (SELECT h.*, n.* EXCLUDE (node_id), CASE WHEN scene = 'work' THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN emotion = 'angry' THEN 0.4::DOUBLE ELSE 0 END AS tag FROM h JOIN n USING (node_id) WHERE greatest(zh, en, tr) >= 0.5 AND is_active),
    g AS (SELECT *, round(zh * 0.40::DOUBLE + tr * 0.25::DOUBLE + en * 0.15::DOUBLE + tag * 0.12::DOUBLE + CASE WHEN coalesce(quality_score, 0) = 0 THEN 0.5::DOUBLE ELSE quality_score END * 0.06::DOUBLE + least(1.0::DOUBLE, ln(1 + CASE WHEN coalesce(occurrence_count, 0) = 0 THEN 1 ELSE occurrence_count END) / ln(51)) * 0.02::DOUBLE, 6) AS score FROM f),
    k AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM g) WHERE score >= best - 0.06::DOUBLE),
    b AS (SELECT node_id, clip_id, match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY match_confidence DESC NULLS LAST, clip_id) AS r FROM clips WHERE is_active AND clip_status = 'matched') WHERE r = 1)
    SELECT query_id, node_id, round(score, 5) AS score, CAST(position AS INTEGER) AS position, total, clip_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM k) LEFT JOIN b USING (node_id) WHERE position <= 20
    """,
    ("asked", "nodes", "clips"),
)
def semantic_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    tried = e.where("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("query_id"), F.array("embedding").alias("candidates"))
    queries = _asked(spark, sf_dir).join(tried, "query_id", "left").withColumn("text", F.lit("老板在会议上生气了"))
    known = nodes(spark, sf_dir).join(e.select(F.col("vec_id").alias("node_id"), "embedding", F.when(F.col("label") < 5, F.col("embedding")).alias("zh_embedding")), "node_id")
    from cueline.plans.base import clips

    return S.semantic_search(queries, known, clips(spark, sf_dir)).select("query_id", "node_id", F.round("score", 5).alias("score"), "position", "total", "clip_id")


VIEWS["turns"] = "SELECT conv_id * 1000 + turn AS line_id, conv_id, turn, coalesce(text, '') AS text FROM conversations"
VIEWS["items"] = "SELECT item_id AS node_id, text FROM benchmark UNION ALL SELECT 5000 + conv_id * 1000 + turn, concat(text, '!') FROM conversations WHERE role = 'user'"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_id"), F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit("")).alias("text"))


def _items(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select((5000 + F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), F.concat("text", F.lit("!")).alias("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text").unionByName(own)


#: DuckDB counts bytes in distances; letters beyond ASCII become one byte each.
PLAIN = r"regexp_replace({}, '[^\x00-\x7F]', '~', 'g')"
FOUND = """
    WITH x AS (SELECT line_id, {nx} AS x FROM {left}), y AS (SELECT node_id, {ny} AS y FROM {right}),
    f AS (SELECT line_id, min(node_id) AS node_id FROM x, y WHERE greatest(length(x), length(y)) = 0 OR (abs(length(x) - length(y)) / greatest(length(x), length(y)) < 0.15 AND levenshtein(x, y) / greatest(length(x), length(y)) < 0.15) GROUP BY line_id)
"""
EDIT = FOUND.format(nx=PLAIN.format(duplicates_sql("text")), ny=PLAIN.format(duplicates_sql("text")), left="turns", right="items")


@query("edit_duplicates", EDIT + " SELECT line_id, node_id FROM f", ("turns", "items"))
def edit_duplicates(spark, sf_dir):
    return D.edit_duplicates(_turns(spark, sf_dir), _items(spark, sf_dir))


NEAR = FOUND.format(nx="text", ny="text", left="short_lines", right="short_nodes")
VIEWS["short_lines"] = "SELECT vec_id AS line_id, concat('sample text ', CAST(vec_id % 50 AS VARCHAR)) AS text, v FROM vectors"
VIEWS["short_nodes"] = "SELECT vec_id AS node_id, concat('other words ', CAST(vec_id AS VARCHAR)) AS text, v, label < 8 AS is_active FROM vectors WHERE label <> 3 UNION ALL SELECT 9000, 'sample text 17', NULL, TRUE"
NEEDS["short_lines"] = NEEDS["short_nodes"] = ("vectors",)


@query(
    "two_stage_duplicates",
    NEAR + f""", t AS (SELECT line_id, n.node_id, is_active, {COS} AS s, row_number() OVER (PARTITION BY line_id ORDER BY {COS} DESC, n.node_id) AS r FROM short_lines q CROSS JOIN short_nodes n WHERE n.v IS NOT NULL AND line_id NOT IN (SELECT line_id FROM f)),
    g AS (SELECT line_id, min(node_id) AS node_id FROM t WHERE r <= 5 AND s >= 0.95 AND is_active GROUP BY line_id)
    SELECT line_id, coalesce(f.node_id, g.node_id) AS node_id, CASE WHEN f.node_id IS NOT NULL THEN 'edit' WHEN g.node_id IS NOT NULL THEN 'vector' END AS stage FROM short_lines LEFT JOIN f USING (line_id) LEFT JOIN g USING (line_id)""",
    ("short_lines", "short_nodes"),
)
def two_stage_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    left = e.select(F.col("vec_id").alias("line_id"), F.concat(F.lit("sample text "), (F.col("vec_id") % 50).cast("string")).alias("text"), "embedding")
    right = e.where("label <> 3").select(F.col("vec_id").alias("node_id"), F.concat(F.lit("other words "), F.col("vec_id").cast("string")).alias("text"), "embedding", (F.col("label") < 8).alias("is_active"))
    extra = spark.range(1).select(F.lit(9000).cast("long").alias("node_id"), F.lit("sample text 17").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("is_active"))
    return D.two_stage_duplicates(left, right.unionByName(extra))


@query("first_in_batch", f"SELECT line_id, row_number() OVER (PARTITION BY {duplicates_sql('text')} ORDER BY line_id) = 1 AS first_seen FROM turns", ("turns",))
def first_in_batch(spark, sf_dir):
    return D.first_in_batch(_turns(spark, sf_dir), ["line_id"]).select("line_id", "first_seen")


@query("add_occurrences", EDIT + ", m AS (SELECT node_id, count(*) AS more FROM f GROUP BY node_id) SELECT node_id, CAST(1 + node_id % 3 + coalesce(more, 0) AS BIGINT) AS occurrence_count FROM items LEFT JOIN m USING (node_id)", ("turns", "items"))
def add_occurrences(spark, sf_dir):
    items = _items(spark, sf_dir)
    known = items.withColumn("occurrence_count", 1 + F.col("node_id") % 3)
    return D.add_occurrences(known, D.edit_duplicates(_turns(spark, sf_dir), items)).select("node_id", "occurrence_count")
