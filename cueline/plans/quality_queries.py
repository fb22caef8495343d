"""Queries of the quality gates and corpus scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.functions.quality import autonomy, basic_invalid, retired_labels, self_introduction, spoken_score, stock_phrase
from cueline.operators import quality as Q
from cueline.operators import reports as R
from cueline.plans.base import VIEWS, NEEDS, lines, literal, nodes, query, sql_values, table, values

#: Lines that reach every branch of the gates.
CASES = [
    "", " ", "Hello", "Thank you.", "I don't know", "123", "...", "[Applause]", "(Cheers and applause)", "♪ la la ♪", "a", "I'm Keke Palmer.", "I'm going home.", "My name is John", "hi, I'm Bob", "hi, I'm so tired",
    "I just think that...", "If you really want to.", "If you go, I stay.", "Which means we start over.", "As a result, we ran.", "I need it.", "And then he left,", "But that is why", "because of that we lost", "Despite all of it", "on top of that we won", "alongside the road",
    "I'm gonna figure out what's going on, don't worry.", "Could you look up the word when you get back?", "WHY ARE YOU SHOUTING", "visit www.example.com now", "Previously on the show", "It's not like I give up, you know.", "Let me say it turns out we can't hold on.",
    "Read between the lines and wrap your head around it.", "no", "yes sir", "We never gave in because they wouldn't move on until we did", "Unless they come over", "So basically we won", "That's why I left", "He said it was fine.", "They are here", "Season 4 starts", "subtitles by someone", "one two", "Go",
]
ROWS = list(enumerate(CASES))


def sql_any(words) -> str:
    return literal(L.any_of(words))


def hit(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {literal(pattern)})"


def times(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {literal(pattern)}))"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


#: Letters beyond ASCII as a plain one: RE2 knows ASCII boundaries only.
ASCII = r"regexp_replace(en_text, '[^\x00-\x7F]', 'q', 'g')"
BASIC = f"(t = '' OR {hit('t', L.DIGITS)} OR {hit('t', L.NO_LETTERS)} OR {hit('t', L.BRACKETED)} OR {hit('t', L.STAGE)} OR {hit('t', L.MUSIC)} OR length(trim(regexp_replace(regexp_replace(t, '[^a-zA-Z\\s]', '', 'g'), '\\s+', ' ', 'g'))) <= 1)"
STOCK = "trim(regexp_replace(translate(lower(en_text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[\\s\\x0B]+', ' ', 'g')) IN (" + ", ".join(map(literal, sorted(L.STOCK_PHRASES))) + ")"
INTRO = f"({hit('t', L.INTRO_NAME)} OR {hit('t', L.INTRO_GREETING)})"
COMMA = "instr(t, ',') - 1"
HANGING = f"({hit('t', L.CONDITION)} AND NOT ({COMMA} > 0 AND {COMMA} < length(t) - 2))"
AUTONOMY = f"""CASE WHEN t = '' THEN 0.6::DOUBLE ELSE round(greatest(0.6::DOUBLE, 1.0::DOUBLE - (0.0::DOUBLE + CASE WHEN {hit('t', L.TRUNCATED)} THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN {hit('t', L.CONTINUES)} THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN {HANGING} THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN {hit('t', L.POINTS_BACK)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {hit('t', L.LEANS)} THEN 0.15::DOUBLE ELSE 0 END)), 4) END"""
FUNCTIONS = "[" + ", ".join(map(literal, sorted(L.FUNCTION_WORDS))) + "]"
VIEWS["measured"] = f"""
SELECT *, {AUTONOMY} AS autonomy, len(words) AS n, len(list_filter(words, lambda w: NOT list_contains({FUNCTIONS}, w) AND length(w) > 1)) AS content,
       {times("a", L.any_of(L.SPOKEN_FORMS))} AS short, {times("a", L.any_of(L.PHRASAL_VERBS))} AS verbs, {times("a", L.any_of(L.IDIOMS))} AS idioms,
       {times("t", r"\p{Lu}")} / greatest(length(t), 1) > 0.5 OR {hit("en_text", L.GARBAGE)} AS none
FROM (SELECT *, {stripped("en_text")} AS t, {ASCII} AS a, regexp_extract_all(lower(en_text), '[a-z'']+') AS words FROM base)
"""
VIEWS["scored"] = f"""
SELECT *, CASE WHEN none OR n = 0 THEN 0.0::DOUBLE ELSE round((least(short / greatest(n / 5, 1.0::DOUBLE), 1.0::DOUBLE) * 0.30::DOUBLE + least(content / n / 0.55::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
    + least((verbs + idioms * 1.5::DOUBLE) / greatest(n / 8, 1.0::DOUBLE), 1.0::DOUBLE) * 0.25::DOUBLE
    + greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN t LIKE '%?' OR {hit("a2", L.QUESTION)} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {hit("a", L.NEGATION)} THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN {hit("a", L.IF_CLAUSE)} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN {hit("a", L.SUBCLAUSE)} THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN n <= 2 THEN 0.30::DOUBLE ELSE 0 END)) * 0.20::DOUBLE) * autonomy, 4) END AS score
FROM (SELECT *, {stripped("a")} AS a2 FROM measured)
"""
NEEDS["measured"], NEEDS["scored"] = (), ("measured",)
VIEWS["measured_nodes"], VIEWS["scored_nodes"] = VIEWS["measured"].replace("FROM base)", "FROM base_nodes)"), VIEWS["scored"].replace("FROM measured)", "FROM measured_nodes)")
VIEWS["gated"] = f"""
SELECT *, coalesce(early, CASE WHEN score >= 0.3::DOUBLE THEN 'passed' ELSE 'rejected_quality' END) AS filter_status, CASE WHEN early IS NULL THEN score ELSE 0.0::DOUBLE END AS quality_score
FROM (SELECT *, CASE WHEN {BASIC} OR {STOCK} OR {INTRO} THEN 'rejected_blacklist' WHEN word_count < 2 OR word_count > 100 THEN 'rejected_wordcount' END AS early FROM scored)
"""
NEEDS["gated"] = ("measured", "scored")
VIEWS["base"] = "SELECT * FROM lines"
VIEWS["base_nodes"] = "SELECT * REPLACE (coalesce(en_text, '') AS en_text) FROM nodes"
VIEWS["cases"] = f"SELECT *, len(regexp_extract_all(en_text, '[^ \\t\\n\\x0B\\f\\r]+')) AS word_count FROM {sql_values(ROWS, 'id, en_text')}"


def _over_cases(sql: str) -> str:
    """The views with the cases in the place of the lines."""
    return f"WITH cases AS ({VIEWS['cases']}), base AS (SELECT * FROM cases), measured AS ({VIEWS['measured']}), scored AS ({VIEWS['scored']}), gated AS ({VIEWS['gated']}) {sql}"


LINES = ("lines0", "lines", "base", "measured", "scored", "gated")


@query("quality_cases", _over_cases(f"SELECT id, en_text, {BASIC} AS invalid, {STOCK} AS stock, {INTRO} AS intro, autonomy, score, filter_status, quality_score FROM gated"))
def quality_cases(spark, sf_dir):
    rows = Q.filter_lines(values(spark, ROWS, "id int, en_text string").withColumn("word_count", F.regexp_count("en_text", F.lit(r"\S+"))))
    c = F.col("en_text")
    return rows.select("id", "en_text", basic_invalid(c).alias("invalid"), stock_phrase(c).alias("stock"), self_introduction(c).alias("intro"), autonomy(c).alias("autonomy"), spoken_score(c).alias("score"), "filter_status", "quality_score")


@query("quality_gate", "SELECT line_id, filter_status, quality_score FROM gated", LINES)
def quality_gate(spark, sf_dir):
    return Q.filter_lines(lines(spark, sf_dir)).select("line_id", "filter_status", "quality_score")


STATS = """count(*) AS total, count_if(filter_status = 'passed') AS passed, round(1 - count_if(filter_status = 'passed') / count(*), 4) AS filter_rate, count_if(filter_status = 'rejected_blacklist') AS rejected_blacklist,
 count_if(filter_status = 'rejected_wordcount') AS rejected_wordcount, count_if(filter_status = 'rejected_quality') AS rejected_quality"""


@query("filter_stats", f"SELECT {STATS} FROM gated", LINES)
def filter_stats(spark, sf_dir):
    return Q.filter_stats(Q.filter_lines(lines(spark, sf_dir)))


@query("filter_stats_by_source", f"SELECT source, {STATS} FROM gated GROUP BY source", LINES)
def filter_stats_by_source(spark, sf_dir):
    return Q.filter_stats(Q.filter_lines(lines(spark, sf_dir)), ["source"])


@query("stored_scores", "SELECT line_id, CASE WHEN quality_score > 0 THEN quality_score END AS quality_score FROM gated", LINES)
def stored_scores(spark, sf_dir):
    return Q.with_stored_score(Q.filter_lines(lines(spark, sf_dir))).select("line_id", "quality_score")


@query("status_distribution", "SELECT filter_status, count(*) AS n, round(count(*) / (SELECT count(*) FROM gated), 4) AS share FROM gated GROUP BY filter_status", LINES)
def status_distribution(spark, sf_dir):
    return R.status_distribution(Q.filter_lines(lines(spark, sf_dir)))


@query(
    "gate_agreement",
    """
    WITH j AS (SELECT filter_status = 'passed' AS p, quality = 1 AS g FROM gated JOIN labels USING (doc_id)), s AS (SELECT count_if(p AND g) AS tp, count_if(p AND NOT g) AS fp, count_if(NOT p AND g) AS fn FROM j)
    SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1 FROM s
    """,
    LINES,
)
def gate_agreement(spark, sf_dir):
    return R.gate_agreement(Q.filter_lines(lines(spark, sf_dir)), table(spark, sf_dir, "labels"))


TFIDF = f"""
    WITH s AS (SELECT line_id, list_filter(regexp_extract_all(lower(en_text), '[a-z'']+'), lambda w: NOT list_contains({FUNCTIONS}, w) AND length(w) > 2) AS words FROM lines),
    c AS (SELECT line_id, size, word, count(*) AS c FROM (SELECT line_id, len(words) AS size, unnest(words) AS word FROM s) GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM c GROUP BY word),
    r AS (SELECT line_id, sum(c * c / size / size * (ln(((SELECT count(*) FROM s) + 1) / (df + 1)) + 1)) AS raw FROM c JOIN d USING (word) GROUP BY line_id),
    e AS (SELECT line_id, coalesce(raw, 0) AS raw FROM s LEFT JOIN r USING (line_id))
    SELECT line_id, CASE WHEN (SELECT max(raw) - min(raw) FROM e) < 1e-9 THEN 0.5 ELSE (raw - (SELECT min(raw) FROM e)) / (SELECT max(raw) - min(raw) FROM e) END AS tfidf FROM e"""


@query("tfidf_scores", f"SELECT line_id, round(tfidf, 6) AS tfidf FROM ({TFIDF})", ("lines",))
def tfidf_scores(spark, sf_dir):
    return Q.tfidf_scores(lines(spark, sf_dir)).select("line_id", F.round("tfidf", 6).alias("tfidf"))


NOVELTY = """
    WITH q AS (SELECT vec_id AS line_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 5),
    t AS (SELECT line_id, node_id, list_cosine_similarity(q.v, k.v) AS s, row_number() OVER (PARTITION BY line_id ORDER BY round(list_cosine_similarity(q.v, k.v), 12) DESC, node_id) AS r FROM q CROSS JOIN k),
    n AS (SELECT line_id, greatest(0, least(1, 1 - avg(s))) AS novelty FROM t WHERE r <= 3 GROUP BY line_id)"""


def _vector_lines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("line_id"), "embedding"), e.where("label < 5").select(F.col("vec_id").alias("node_id"), "embedding")


@query("kb_novelty", NOVELTY + " SELECT line_id, round(novelty, 6) AS novelty FROM n")
def kb_novelty(spark, sf_dir):
    return Q.novelty(*_vector_lines(spark, sf_dir)).select("line_id", F.round("novelty", 6).alias("novelty"))


@query(
    "contextual_scores",
    f"""
    WITH f AS ({TFIDF.replace("FROM lines)", "FROM (SELECT doc_id AS line_id, coalesce(text, '') AS en_text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)))")}),
    n AS ({NOVELTY} SELECT line_id, novelty FROM n)
    SELECT line_id, round(tfidf, 6) AS tfidf, round(novelty, 6) AS novelty, round(tfidf * 0.4 + novelty * 0.6, 5) AS contextual, round(tfidf * 0.4 + novelty * 0.6, 5) >= 0.3 AS passed FROM f JOIN n USING (line_id)
    """,
)
def contextual_scores(spark, sf_dir):
    vectors, known = _vector_lines(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.coalesce("text", F.lit("")).alias("en_text"))
    out = Q.contextual_scores(texts.join(vectors, "line_id"), known)
    score = F.round("contextual", 5)
    return out.select("line_id", F.round("tfidf", 6).alias("tfidf"), F.round("novelty", 6).alias("novelty"), score.alias("contextual"), (score >= 0.3).alias("passed"))


def sql_labels(text: str, score: str) -> str:
    names = list(L.RETIRED)
    label = lambda k: f"CASE WHEN {HANGING.replace(literal(L.CONDITION), literal(L.RETIRED[k])) if k == 'hanging_conditional' else hit('t', L.RETIRED[k])} THEN {literal(k)} END"
    compact = lambda x: f"list_filter({x}, lambda v: v IS NOT NULL)"
    first = compact("[" + ", ".join(label(k) for k in names[:7]) + "]")
    return f"""SELECT node_id, {text} AS en_text, score, CASE WHEN len(l3) = 0 THEN ['unclassified'] ELSE l3 END AS labels FROM (
      SELECT *, {compact("list_concat(l2, [CASE WHEN len(l2) = 0 AND score < 0.35 THEN 'low_authenticity' END])")} AS l3 FROM (
      SELECT *, {compact(f"list_concat(l1, [CASE WHEN len(l1) = 0 THEN {label('pronoun_dependent')} END, {label('format_garbage')}])")} AS l2 FROM (
      SELECT *, {first} AS l1 FROM (SELECT *, {stripped(f"coalesce({text}, '')")} AS t, coalesce({score}, 0.0::DOUBLE) AS score FROM given))))"""


VIEWS["given"] = "SELECT node_id, en_text, quality_score FROM nodes WHERE NOT is_active"
VIEWS["retired"] = sql_labels("en_text", "quality_score")
NEEDS["given"], NEEDS["retired"] = ("nodes",), ("nodes", "given")


@query("retired_labels", "WITH given AS (SELECT id AS node_id, en_text, 0.2::DOUBLE * (id % 4) AS quality_score FROM " + sql_values(ROWS, "id, en_text") + "), r AS (" + VIEWS["retired"] + ") SELECT node_id, labels FROM r")
def retired_label_cases(spark, sf_dir):
    return values(spark, ROWS, "node_id int, en_text string").select("node_id", retired_labels(F.col("en_text"), 0.2 * (F.col("node_id") % 4)).alias("labels"))


@query("retired_patterns", "WITH u AS (SELECT node_id, score, unnest(labels) AS label FROM retired) SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM given), 4) AS share, round(avg(score), 4) AS avg_score, list_sort(list(node_id))[1:3] AS examples FROM u GROUP BY label", ("retired",))
def retired_patterns(spark, sf_dir):
    return R.retired_patterns(nodes(spark, sf_dir))


@query(
    "retired_score_distribution",
    """SELECT count(*) AS total, count_if(s < 0.3) AS "bucket_0.0-0.3", count_if(s >= 0.3 AND s < 0.4) AS "bucket_0.3-0.4", count_if(s >= 0.4 AND s < 0.5) AS "bucket_0.4-0.5", count_if(s >= 0.5 AND s < 0.6) AS "bucket_0.5-0.6", count_if(s >= 0.6) AS "bucket_0.6+",
    round(avg(s), 4) AS mean, round(median(s), 4) AS median, round(stddev_samp(s), 4) AS stdev FROM (SELECT coalesce(quality_score, 0) AS s FROM given)""",
    ("given",),
)
def retired_score_distribution(spark, sf_dir):
    return R.score_distribution(nodes(spark, sf_dir))


@query(
    "retired_recommendations",
    """
    WITH o AS (SELECT count(*) AS total, count_if(list_contains(labels, 'stage_direction')) AS sd, count_if(list_contains(labels, 'self_introduction')) AS si, count_if(list_contains(labels, 'pronoun_dependent')) AS pd, count_if(list_contains(labels, 'unclassified')) AS uc, round(avg(score), 4) AS mean FROM retired)
    SELECT 'stage_direction' AS signal, 'high' AS confidence, sd AS n FROM o WHERE sd / total > 0.05 UNION ALL SELECT 'self_introduction', 'high', si FROM o WHERE si > 0 UNION ALL SELECT 'pronoun_dependent', 'medium', pd FROM o WHERE pd / total > 0.10
    UNION ALL SELECT 'unclassified', 'low', uc FROM o WHERE uc / total > 0.20 UNION ALL SELECT 'quality_threshold', 'medium', total FROM o WHERE mean > 0.5
    """,
    ("retired",),
)
def retired_recommendations(spark, sf_dir):
    return R.recommendations(nodes(spark, sf_dir))


@query("retired_latest_labels", "WITH u AS (SELECT unnest(labels) AS label FROM (SELECT * FROM retired ORDER BY node_id DESC LIMIT 30)) SELECT label, count(*) AS n FROM u GROUP BY label ORDER BY n DESC, label LIMIT 5", ("retired",))
def retired_latest_labels(spark, sf_dir):
    return R.latest_labels(nodes(spark, sf_dir))


@query("reevaluate_restore", "WITH s AS (SELECT * FROM scored_nodes) SELECT node_id, score AS quality_score, score >= 0.3 AS is_active FROM s", ("nodes", "base_nodes", "measured_nodes", "scored_nodes"))
def reevaluate_restore(spark, sf_dir):
    rows = nodes(spark, sf_dir).withColumn("en_text", F.coalesce("en_text", F.lit("")))
    return Q.reevaluate(rows, True).select("node_id", "quality_score", "is_active")


@query("reevaluate_demote", "WITH s AS (SELECT * FROM scored_nodes) SELECT node_id, score AS quality_score, CASE WHEN score < 0.3 THEN FALSE ELSE is_active END AS is_active FROM s", ("nodes", "base_nodes", "measured_nodes", "scored_nodes"))
def reevaluate_demote(spark, sf_dir):
    rows = nodes(spark, sf_dir).withColumn("en_text", F.coalesce("en_text", F.lit("")))
    return Q.reevaluate(rows, False).select("node_id", "quality_score", "is_active")
