"""Queries of changes of the knowledge base, and of the streams that extend it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import lifecycle as M
from cueline.plans.base import COSTLY, NEEDS, VIEWS, clips, lines, nodes, query, sql_values, table, values
from cueline.plans.quality_queries import LINES, TFIDF
from cueline.plans.search_queries import PLAIN
from cueline.plans.text_queries import duplicates_sql


@query("new_episodes", "SELECT line_id FROM lines WHERE doc_id NOT IN (SELECT item_id FROM benchmark)", ("lines",))
def new_episodes(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("show_name", F.lit("s")).withColumn("episode", F.col("doc_id").cast("string"))
    known = table(spark, sf_dir, "benchmark").select(F.lit("s").alias("show_name"), F.col("item_id").cast("string").alias("episode"))
    return M.new_episodes(rows, known).select("line_id")


@query("unsynced_lines", "SELECT line_id FROM gated WHERE filter_status = 'passed' AND line_id NOT IN (SELECT subtitle_id FROM nodes WHERE subtitle_id IS NOT NULL)", (*LINES, "nodes"))
def unsynced_lines(spark, sf_dir):
    from cueline.operators.quality import filter_lines

    return M.unsynced(filter_lines(lines(spark, sf_dir)), nodes(spark, sf_dir)).select("line_id")


@query("subtitle_ids", "SELECT l.line_id, m.subtitle_id FROM lines l JOIN (SELECT doc_id % 3 AS e, en_text, max(line_id) AS subtitle_id FROM lines GROUP BY ALL) m ON m.e = l.doc_id % 3 AND m.en_text = l.en_text", ("lines",))
def subtitle_ids(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("episode", F.col("doc_id") % 3)
    return M.subtitle_ids(rows.select("episode", "en_text", F.col("line_id")), rows).select("line_id", "subtitle_id")


@query(
    "add_sources",
    "SELECT node_id, show_name, episode, min(age) = 1 AS is_new FROM (SELECT node_id, show_name, episode, 0 AS age FROM clips WHERE clip_status = 'matched' UNION ALL SELECT node_id, show_name, episode, 1 FROM clips WHERE clip_status <> 'matched') GROUP BY ALL",
    ("clips",),
)
def add_sources(spark, sf_dir):
    c = clips(spark, sf_dir)
    return M.add_sources(c.where("clip_status = 'matched'"), c.where("clip_status <> 'matched'"))


# A batch of all lines, each with one of the vectors; nodes are the items of benchmark, some of them not active.
VIEWS["passed"] = "SELECT *, (doc_id * 31 + pos) % 500 AS vec FROM gated WHERE filter_status = 'passed'"
VIEWS["vecs"] = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
VIEWS["items0"] = "SELECT item_id AS node_id, text, v, item_id % 7 <> 3 AS is_active, item_id * 100000 AS subtitle_id FROM benchmark LEFT JOIN vecs ON vec_id = item_id"
VIEWS["met"] = "SELECT vec_id AS vec, node_id, is_active, list_cosine_similarity(q.v, k.v) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(q.v, k.v), 12) DESC, node_id) AS r FROM vecs q CROSS JOIN items0 k WHERE vec_id < 500 AND k.v IS NOT NULL"
VIEWS["fitting"] = f"""SELECT line_id FROM ({TFIDF.replace("FROM lines)", "FROM passed)")}) JOIN passed USING (line_id)
    JOIN (SELECT vec, greatest(0, least(1, 1 - avg(s))) AS novelty FROM met WHERE r <= 3 GROUP BY vec) USING (vec) WHERE tfidf * 0.4::DOUBLE + novelty * 0.6::DOUBLE >= 0.3::DOUBLE"""
VIEWS["norm"] = f"SELECT line_id, vec, en_text, {PLAIN.format(duplicates_sql('en_text'))} AS x FROM passed"
VIEWS["known"] = f"SELECT node_id, {PLAIN.format(duplicates_sql('text'))} AS y FROM items0 WHERE is_active"
VIEWS["by_edit"] = "SELECT x, min(node_id) AS node_id FROM (SELECT DISTINCT x FROM norm) CROSS JOIN known WHERE greatest(length(x), length(y)) = 0 OR (abs(length(x) - length(y)) / greatest(length(x), length(y)) < 0.15 AND levenshtein(x, y) / greatest(length(x), length(y)) < 0.15) GROUP BY x"
VIEWS["by_vector"] = "SELECT vec, min(node_id) AS node_id FROM met WHERE r <= 5 AND s >= 0.95 AND is_active GROUP BY vec"
VIEWS["exact"] = "SELECT text AS en_text, min(node_id) AS exact_id FROM items0 GROUP BY text"
VIEWS["settled"] = "SELECT n.*, coalesce(e.node_id, v.node_id) AS node_id FROM norm n LEFT JOIN by_edit e USING (x) LEFT JOIN by_vector v USING (vec)"
VIEWS["batch"] = "SELECT *, row_number() OVER (PARTITION BY node_id IS NULL, x ORDER BY line_id) = 1 AS first FROM settled WHERE line_id IN (SELECT line_id FROM fitting)"
VIEWS["ingested"] = """SELECT g.line_id, doc_id, source, g.en_text, filter_status, CASE WHEN filter_status = 'passed' THEN b.line_id IS NOT NULL END AS in_context, CASE WHEN b.node_id IS NOT NULL THEN b.node_id WHEN b.first THEN exact_id END AS node_id,
    CASE WHEN b.line_id IS NULL THEN NULL WHEN b.node_id IS NOT NULL THEN 'merged' WHEN NOT b.first THEN 'repeated' WHEN exact_id IS NOT NULL THEN 'merged' ELSE 'created' END AS outcome FROM gated g LEFT JOIN batch b USING (line_id) LEFT JOIN exact x ON x.en_text = g.en_text"""
NEEDS["passed"] = LINES
NEEDS["settled"] = (*LINES, "passed", "vecs", "items0", "met", "norm", "known", "by_edit", "by_vector", "exact")
NEEDS["ingested"] = (*NEEDS["settled"], "fitting", "settled", "batch")


def _batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), "embedding")
    rows = lines(spark, sf_dir).withColumn("vec", (F.col("doc_id") * 31 + F.col("pos")) % 500).join(e, "vec", "left")
    return rows.select("line_id", F.col("en_text").alias("text"), "word_count", F.col("source").alias("show_name"), F.col("doc_id").cast("string").alias("episode"), "start_time", "embedding")


def _known(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text", (F.col("item_id") % 7 != 3).alias("is_active"), (F.col("item_id") * 100000).alias("subtitle_id"))
    return items.join(e, "node_id", "left")


@query("ingest", "SELECT line_id, filter_status, in_context, node_id, outcome FROM ingested", ("ingested",))
def ingest(spark, sf_dir):
    return M.ingest(_batch(spark, sf_dir), _known(spark, sf_dir)).select("line_id", "filter_status", "in_context", "node_id", "outcome")


@query("ingest_summary", "SELECT count_if(outcome = 'created') AS created, count_if(outcome = 'merged') AS merged, count_if(outcome = 'repeated') AS repeated, count_if(outcome IS NULL) AS skipped FROM ingested", ("ingested",))
def ingest_summary(spark, sf_dir):
    return M.batch_summary(M.ingest(_batch(spark, sf_dir), _known(spark, sf_dir)))


@query(
    "ingest_sources",
    """, last AS (SELECT doc_id, en_text, max(line_id) AS subtitle_id FROM ingested GROUP BY ALL)
    SELECT coalesce(node_id, line_id + 1) AS node_id, source AS show_name, CAST(doc_id AS VARCHAR) AS episode, arg_min(subtitle_id, line_id) AS subtitle_id FROM ingested JOIN last USING (doc_id, en_text) WHERE outcome IN ('merged', 'created') GROUP BY ALL""",
    ("ingested",),
)
def ingest_sources(spark, sf_dir):
    return M.ingested_sources(M.ingest(_batch(spark, sf_dir), _known(spark, sf_dir)))


@query("ingest_counts", ", m AS (SELECT node_id, count(*) AS more FROM ingested WHERE outcome = 'merged' GROUP BY node_id) SELECT node_id, CAST(1 + node_id % 5 + coalesce(more, 0) AS BIGINT) AS occurrence_count FROM items0 LEFT JOIN m USING (node_id)", ("ingested",))
def ingest_counts(spark, sf_dir):
    from cueline.operators.duplicates import add_occurrences

    nodes_ = _known(spark, sf_dir)
    merged = M.ingest(_batch(spark, sf_dir), nodes_).where("outcome = 'merged'")
    return add_occurrences(nodes_.select("node_id", (1 + F.col("node_id") % 5).alias("occurrence_count")), merged.select("node_id")).select("node_id", "occurrence_count")


@query("created_nodes", "SELECT line_id + 1 AS node_id, word_count, CASE WHEN word_count <= 8 THEN 'beginner' WHEN word_count <= 20 THEN 'intermediate' ELSE 'advanced' END AS difficulty, concat(upper(source), '-', substr(CAST(doc_id AS VARCHAR), 1, 8), '-', printf('%08d', CAST(round_even(start_time * 1000, 0) AS BIGINT))) AS code FROM (SELECT line_id, outcome FROM ingested) JOIN lines USING (line_id) WHERE outcome = 'created'", ("ingested",))
def created_nodes(spark, sf_dir):
    return M.created_nodes(M.ingest(_batch(spark, sf_dir), _known(spark, sf_dir))).select("node_id", "word_count", "difficulty", "code")


@query("promote", "SELECT line_id, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'promoted' ELSE filter_status END AS filter_status FROM gated", LINES)
def promote(spark, sf_dir):
    from cueline.operators.quality import filter_lines

    rows = filter_lines(lines(spark, sf_dir))
    ids = rows.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id").select("line_id")
    return M.promote(rows, ids).select("line_id", "filter_status")


# All lines, a source a batch; lines that read alike are one.
VIEWS["read"] = f"SELECT line_id, lang, source AS batch, {PLAIN.format(duplicates_sql('en_text'))} AS x FROM lines"
VIEWS["read_items"] = f"SELECT item_id AS node_id, {PLAIN.format(duplicates_sql('text'))} AS y FROM benchmark"
# Letters that one text has more often must go or come: most pairs need no comparison.
COUNTED = "*, length(x) AS n, [" + ", ".join(f"length(x) - length(replace(x, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz ~") + "] AS l"
SIZED = "a.n <= b.n AND b.n * 0.85 < a.n + 1 AND a.id <> b.id"
OFF = "greatest(" + ", ".join(f"list_sum(list_transform(list_zip(a.l, b.l), lambda z: greatest(0, {p})))" for p in ("z[1] - z[2]", "z[2] - z[1]")) + ") <= 0.15 * b.n"
CLOSE = "(length({x}) = length({y}) OR (length({y}) - length({x})) / length({y}) < 0.15) AND levenshtein({x}, {y}) / greatest(length({y}), 1) < 0.15"
VIEWS["found_in"] = f"SELECT x, min(node_id) AS node_id FROM (SELECT DISTINCT x FROM read) CROSS JOIN read_items WHERE greatest(length(x), length(y)) = 0 OR (abs(length(x) - length(y)) / greatest(length(x), length(y)) < 0.15 AND levenshtein(x, y) / greatest(length(x), length(y)) < 0.15) GROUP BY x"
VIEWS["kinds"] = "SELECT batch, x, min(line_id) AS id FROM read ANTI JOIN found_in USING (x) GROUP BY ALL"
VIEWS["counted"] = f"SELECT {COUNTED} FROM kinds"
VIEWS["maybe"] = f"SELECT a.batch, a.id AS a, b.id AS b, a.x, b.x AS y FROM counted a JOIN counted b ON a.batch = b.batch AND {SIZED} WHERE {OFF}"
VIEWS["near_kinds"] = f"SELECT batch, a, b FROM maybe WHERE {CLOSE.format(x='x', y='y')}"
COSTLY |= {"read", "kinds", "counted", "maybe", "near_kinds"}
NEEDS["read"] = ("lines0", "lines")
NEEDS["found_in"] = ("lines0", "lines", "read", "read_items")
NEEDS["kinds"] = (*NEEDS["found_in"], "found_in")
NEEDS["near_kinds"] = (*NEEDS["kinds"], "kinds", "counted", "maybe")


def _read(spark, sf_dir):
    return lines(spark, sf_dir).select("line_id", F.col("source").alias("batch"), F.col("en_text").alias("text"))


@query(
    "promote_in_order",
    """RECURSIVE
    WITH RECURSIVE e AS (SELECT DISTINCT batch, greatest(a, b) AS id, least(a, b) AS earlier FROM near_kinds),
    o AS (SELECT batch, id, before, row_number() OVER (PARTITION BY batch ORDER BY id) AS i FROM (SELECT batch, id, list(earlier) AS before FROM e GROUP BY ALL)),
    f(batch, i, gone) AS (SELECT DISTINCT batch, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
      SELECT f.batch, o.i, CASE WHEN len(list_filter(before, lambda b: NOT list_contains(gone, b))) > 0 THEN list_append(gone, id) ELSE gone END FROM f JOIN o ON o.batch = f.batch AND o.i = f.i + 1),
    g AS (SELECT batch, unnest(arg_max(gone, i)) AS id FROM f GROUP BY batch),
    m AS (SELECT e.id, min(earlier) AS kind FROM e WHERE earlier NOT IN (SELECT id FROM g) GROUP BY e.id)
    SELECT line_id, node_id, CASE WHEN node_id IS NULL AND coalesce(kind, k.id) <> line_id THEN coalesce(kind, k.id) END AS merged_into,
      CASE WHEN node_id IS NOT NULL THEN 'merged' WHEN coalesce(kind, k.id) <> line_id THEN 'repeated' ELSE 'created' END AS outcome
    FROM read LEFT JOIN found_in USING (x) LEFT JOIN kinds k USING (batch, x) LEFT JOIN m ON m.id = k.id
    """,
    ("near_kinds",),
)
def promote_in_order(spark, sf_dir):
    return M.promote_in_order(_read(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"), "text"))


@query(
    "similar_lines",
    f""", k AS MATERIALIZED (SELECT {COUNTED} FROM (SELECT batch, x, min(line_id) AS id FROM read GROUP BY ALL)),
    p AS MATERIALIZED (SELECT a.batch, a.x AS x, b.x AS y, a.id AS a, b.id AS b FROM k a JOIN k b ON a.batch = b.batch AND {SIZED} WHERE CASE WHEN {OFF} THEN {CLOSE.format(x="a.x", y="b.x")} ELSE FALSE END),
    f AS (SELECT batch, x, min(id) AS id, count(*) AS n FROM (SELECT batch, x, b AS id FROM p UNION SELECT batch, y, a FROM p UNION SELECT batch, x, id FROM k) GROUP BY ALL)
    SELECT line_id, id AS first_id, n FROM read JOIN f USING (batch, x)""",
    ("read",),
)
def similar_lines(spark, sf_dir):
    """Of each line, how many texts of its source are within the edit distance of its own, itself included, and the first line of these: all lines of
    a source against all."""
    from cueline.functions.text import for_duplicates
    from cueline.operators.duplicates import near_each_other
    from cueline.workers import stored

    rows = stored(lines(spark, sf_dir).select("line_id", "source", for_duplicates(F.col("en_text")).alias("text")), "lines")
    texts = stored(rows.groupBy("source", "text").agg(F.min("line_id").alias("id")), "texts")
    near = near_each_other(texts, ["source"]).groupBy(F.col("x_id").alias("id")).agg(F.min("y_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(texts, ["source", "text"]).join(near, "id").select("line_id", "first_id", "n")


@query("update_nodes", "SELECT node_id, CASE WHEN node_id IN (SELECT item_id FROM benchmark) THEN 'work' ELSE scene END AS scene, CASE WHEN node_id IN (SELECT item_id FROM benchmark) THEN 'neu' ELSE zh_text END AS zh_text, CASE WHEN node_id IN (SELECT item_id FROM benchmark) THEN FALSE ELSE needs_translation END AS needs_translation FROM nodes", ("nodes",))
def update_nodes(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"))
    return M.update_nodes(nodes(spark, sf_dir), ids, {"scene": F.lit("work"), "zh_text": F.lit("neu")}).select("node_id", "scene", "zh_text", "needs_translation")


@query("delete_nodes", "SELECT 'node' AS kind, node_id FROM nodes WHERE node_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT 'source', node_id FROM clips WHERE node_id NOT IN (SELECT item_id FROM benchmark)", ("nodes", "clips"))
def delete_nodes(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("node_id"))
    left, sources = M.delete_nodes(nodes(spark, sf_dir), clips(spark, sf_dir), ids)
    return left.select(F.lit("node").alias("kind"), "node_id").unionByName(sources.select(F.lit("source").alias("kind"), "node_id"))


@query("retag", "SELECT node_id, CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'promising' ELSE 'warning' END ELSE 'neutral_statement' END AS speech_act, scene FROM nodes LEFT JOIN labels ON doc_id = node_id", ("nodes",))
def retag(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node_id"), F.when(F.col("quality") == 1, "promising").otherwise("warning").alias("speech_act"))
    return M.retag(nodes(spark, sf_dir).withColumn("speech_act", F.lit("neutral_statement")), tags).select("node_id", "speech_act", "scene")


SLUG = "concat(upper(show_name), '-', substr(regexp_replace(upper(episode), '[^A-Z0-9]', '', 'g'), 1, 8), '-', printf('%08d', CAST(start_time * 1000 AS BIGINT)))"


@query("fill_codes", f"SELECT node_id, CASE WHEN p > 1 AND code IS NULL THEN concat(made, '-', CAST(node_id AS VARCHAR)) ELSE made END AS code FROM (SELECT *, row_number() OVER (PARTITION BY made ORDER BY code IS NULL, node_id) AS p FROM (SELECT *, coalesce(code, {SLUG}) AS made FROM nodes))", ("nodes",))
def fill_codes(spark, sf_dir):
    return M.fill_codes(nodes(spark, sf_dir)).select("node_id", "code")


@query("upsert_videos", "SELECT coalesce(o_custkey, c_custkey) AS id, coalesce(n, c_acctbal) AS size, c_name AS name FROM (SELECT o_custkey, max(o_totalprice) AS n FROM orders GROUP BY 1) o FULL JOIN customer ON c_custkey = o_custkey")
def upsert_videos(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("size"), F.col("c_name").alias("name"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("size"))
    return M.upsert(old, new, ["id"])


@query("delete_clips", "SELECT node_id, node_id IN (SELECT node_id FROM clips WHERE clip_status <> 'failed') AS has_any_clip FROM nodes", ("nodes", "clips"))
def delete_clips(spark, sf_dir):
    c = clips(spark, sf_dir)
    return M.delete_clips(c, nodes(spark, sf_dir), c.where("clip_status = 'failed'").select("clip_id"))[1].select("node_id", "has_any_clip")


STATUS = [(0, "done", False), (1, "confirmed", None), (2, "skipped", True), (3, "pending", True), (4, "rejected", False), (5, "failed", True), (6, "matched", True), (7, "unmatched", True)]


@query("migrate_status", "SELECT id, CASE WHEN s IN ('done', 'confirmed') THEN 'matched' WHEN s IN ('skipped', 'pending', 'rejected') THEN 'unmatched' ELSE s END AS clip_status, CASE WHEN s IN ('done', 'confirmed') THEN TRUE WHEN s = 'matched' THEN a ELSE FALSE END AS is_active FROM " + sql_values(STATUS, "id, s, a"))
def migrate_status(spark, sf_dir):
    return M.migrate_status(values(spark, STATUS, "id int, clip_status string, is_active boolean"))


# Orders as clips of before, with all statuses that there were.
OLD = "list_element(['done', 'confirmed', 'skipped', 'pending', 'rejected', 'failed', 'matched', 'unmatched'], CAST(clip_id % 8 AS INTEGER) + 1)"


@query("migrate_clips", f"SELECT clip_id, CASE WHEN s IN ('done', 'confirmed') THEN 'matched' WHEN s IN ('skipped', 'pending', 'rejected') THEN 'unmatched' ELSE s END AS clip_status, CASE WHEN s IN ('done', 'confirmed') THEN TRUE WHEN s = 'matched' THEN is_active ELSE FALSE END AS is_active FROM (SELECT *, {OLD} AS s FROM clips)", ("clips",))
def migrate_clips(spark, sf_dir):
    old = F.element_at(F.array(*[F.lit(x) for x in ("done", "confirmed", "skipped", "pending", "rejected", "failed", "matched", "unmatched")]), (F.col("clip_id") % 8 + 1).cast("int"))
    return M.migrate_status(clips(spark, sf_dir).withColumn("clip_status", old)).select("clip_id", "clip_status", "is_active")


@query("add_missing", "SELECT r_regionkey, r_name, 'tv' AS content_type, 1 AS n FROM region")
def add_missing(spark, sf_dir):
    return M.add_missing(table(spark, sf_dir, "region"), {"content_type": F.lit("tv"), "n": F.lit(1), "r_name": F.lit("never")})


@query("replace_episode", "SELECT conv_id, turn, text FROM conversations WHERE conv_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, 0, text FROM benchmark")
def replace_episode(spark, sf_dir):
    from cueline.sources.captions import replace_episode as replace

    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return replace(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), new, ["conv_id"])


SYNC = """, u AS (SELECT s.*, exact_id, min(line_id) OVER (PARTITION BY s.en_text, node_id IS NULL) AS first FROM settled s LEFT JOIN exact USING (en_text) WHERE line_id NOT IN (SELECT subtitle_id FROM items0)),
    y AS (SELECT line_id, CASE WHEN coalesce(node_id, exact_id) IS NULL AND line_id = first THEN 'created' ELSE 'merged' END AS outcome, coalesce(node_id, exact_id) AS node_id, CASE WHEN coalesce(node_id, exact_id) IS NULL THEN first END AS created_by FROM u)"""


def _synced(spark, sf_dir):
    from cueline.operators.quality import filter_lines

    rows = filter_lines(_batch(spark, sf_dir).withColumn("en_text", F.col("text"))).drop("en_text")
    return rows, M.sync_episode(rows, _known(spark, sf_dir))


@query("sync_episode", SYNC + " SELECT * FROM y", ("settled", "ingested"))
def sync_episode(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@query("synced_nodes", SYNC + ", c AS (SELECT created_by AS line_id, count(*) AS occurrence_count FROM y WHERE created_by IS NOT NULL GROUP BY created_by) SELECT line_id + 1 AS node_id, occurrence_count, CASE WHEN word_count <= 8 THEN 'beginner' WHEN word_count <= 20 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM c JOIN lines USING (line_id)", ("settled", "ingested"))
def synced_nodes(spark, sf_dir):
    return M.synced_nodes(*_synced(spark, sf_dir)).select("node_id", "occurrence_count", "difficulty")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """The windows that the stream computes, over the table as a whole."""
    from cueline.streaming.feedback import feedback_windows

    return feedback_windows(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("stream_nodes", f"SELECT md5(x) AS x, min(line_id) AS node_id, count(*) AS occurrence_count FROM (SELECT line_id, {duplicates_sql('en_text')} AS x FROM gated WHERE filter_status = 'passed') GROUP BY x", LINES)
def stream_nodes(spark, sf_dir):
    """Nodes of all lines, whose files arrive in three parts; each part is taken by a query that goes on from the checkpoint of the one before."""
    from cueline.streaming.nodes import ingest_nodes
    from cueline.workers import shared_folder

    given = lines(spark, sf_dir).select("doc_id", "line_id", "en_text", "word_count")
    top = given.agg(F.max("doc_id")).first()[0] or 0
    arriving, checkpoint, out = shared_folder(spark, "arriving"), shared_folder(spark, "checkpoint"), shared_folder(spark, "changed")
    for k in range(3):
        given.where((F.col("doc_id") * 3 / (top + 1)).cast("int") == k).drop("doc_id").write.mode("append").parquet(arriving)
        ingest_nodes(spark, arriving, "line_id long, en_text string, word_count long", lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint, files=1_000_000).awaitTermination()
    return spark.read.parquet(out).groupBy("x").agg(F.min("node_id").alias("node_id"), F.max("occurrence_count").alias("occurrence_count")).withColumn("x", F.md5("x"))
