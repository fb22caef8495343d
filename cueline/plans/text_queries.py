"""Queries of the scalar functions, over cases that reach their branches and over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.functions import ranking as K
from cueline.functions import text as X
from cueline.plans.base import literal, nodes, query, sql_values, table, values


def squeeze_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x0B]+', ' ', 'g'))"


def word_sql(c: str, inner: str, new: str) -> str:
    """Replacing whole words where letters beyond ASCII count as letters, which RE2's boundaries do not know; twice, as neighbours share a boundary."""
    pattern, to = literal(rf"(^|[^\pL\pM\pN_]){inner}($|[^\pL\pM\pN_])"), literal(rf"\1{new}\2")
    return f"regexp_replace(regexp_replace({c}, {pattern}, {to}, 'g'), {pattern}, {to}, 'g')"


def duplicates_sql(c: str) -> str:
    spelled = reduce(lambda t, r: word_sql(t, r[0], r[1]), L.REWRITES, f"lower({c})")
    return squeeze_sql(rf"regexp_replace({spelled}, '[^\pL\pN\pM_\s]', ' ', 'g')")


def alignment_sql(c: str) -> str:
    spoken = reduce(lambda t, p: f"regexp_replace({t}, {literal(p)}, ' ', 'g')", L.NOTES, f"coalesce({c}, '')")
    return squeeze_sql(reduce(lambda t, p: word_sql(t, p.removeprefix(r"\b").removesuffix(r"\b"), " "), L.FILLERS, duplicates_sql(spoken)))


TEXTS = [
    (0, "You're gonna wanna see this."), (1, "She can't do it."), (2, "We've gotta go now!"), (3, "Don't worry, it'll be fine."), (4, ""), (5, None), (6, "  Déjà vu!  naïve café "), (7, "[door] Uh, you know, I mean (sighs) it's ♪ la ♪ <i>kinda</i> fine"),
    (8, "Mustn't, needn't; COULDN'T"), (9, "tab\tand\nline"), (10, "they'd there're that'd"), (11, "a_b-c.d"), (12, "Yeah nope dunno lemme gimme c'mon cmon"),
]


@query("normalize_duplicates", f"SELECT id, {duplicates_sql('s')} AS norm, {squeeze_sql('translate(lower(s), ' + literal(chr(33) + chr(34) + '#$%&' + chr(39) + '()*+,-./:;<=>?@[' + chr(92) + ']^_`{|}~') + ', ' + literal('') + ')')} AS stock, {alignment_sql('s')} AS aligned, {squeeze_sql(rf'''regexp_replace(lower(s), '[^\pL\pN_\s'']', ' ', 'g')''')} AS diagnosed FROM {sql_values(TEXTS, 'id, s')}")
def normalize_duplicates(spark, sf_dir):
    s = F.col("s")
    return values(spark, TEXTS, "id int, s string").select("id", X.for_duplicates(s).alias("norm"), X.for_stock_phrases(s).alias("stock"), X.for_alignment(s).alias("aligned"), X.for_diagnosis(s).alias("diagnosed"))


@query("normalize_turns", f"SELECT conv_id, turn, md5({duplicates_sql('text')}) AS norm, md5({alignment_sql('text')}) AS aligned FROM conversations")
def normalize_turns(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.for_duplicates(t)).alias("norm"), F.md5(X.for_alignment(t)).alias("aligned"))


CLOCKS = [(0, "00:00:01,500", 1.5, 1500), (1, "01:02:03.25", 3723.25, 3723250), (2, "02:03.5", 123.5, 123500), (3, "7.5", 7.5, 0), (4, "x:1:2", None, 0), (5, "00:00:01", 1.0, 1000), (6, "1:1:1.2345", 3661.2345, 3661234), (7, "99:59:59,999", 359999.999, 359999999), (8, "", None, 0)]


@query("timecodes", f"SELECT id, CAST(seconds AS DOUBLE) AS seconds, CAST(ms AS BIGINT) AS ms, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock FROM {sql_values(CLOCKS, 'id, c, seconds, ms')}")
def timecodes(spark, sf_dir):
    c = F.col("c")
    return values(spark, [r[:2] for r in CLOCKS], "id int, c string").select("id", X.clock_seconds(c).alias("seconds"), X.cue_ms(c).alias("ms"), X.ms_clock(X.cue_ms(c)).alias("clock"))


SIDES = [(0, ["Hello there", "你好"], "Hello there", "你好"), (1, ["- Hi 你", "x"], "x", "- Hi 你"), (2, ["good morning | 早上好"], "good morning", "早上好"), (3, ["this is a very long english line 好 | 好的"], "", "好的"), (4, ["123", "..."], "123 ...", ""), (5, [], "", ""), (6, ["  ", "a｜b"], "a｜b", ""), (7, ["english words here and there 好", "我们走吧"], "english words here and there 好", "我们走吧"), (8, ["abcdefghij klmnop | 好的"], "abcdefghij klmnop", "好的")]


@query("bilingual_sides", f"SELECT id, en, zh FROM {sql_values([(r[0], r[2], r[3]) for r in SIDES], 'id, en, zh')}")
def bilingual_sides(spark, sf_dir):
    return values(spark, [r[:2] for r in SIDES], "id int, l array<string>").select("id", X.bilingual(F.col("l")).alias("b")).select("id", "b.en", "b.zh")


PAIRS = [(0, "hello", "hello"), (1, "", ""), (2, "a", "b"), (3, "hello", "helo"), (4, "kitten", "sitting"), (5, "hello", ""), (6, "you are going to want", "you are going to what"), (7, "the end", "end the"), (8, "e", "f")]


@query(
    "text_distances",
    f"""RECURSIVE
    WITH RECURSIVE p AS (SELECT id, a, b FROM {sql_values(PAIRS, "id, a, b")}),
    d(id, i, r) AS (SELECT id, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM p UNION ALL
      SELECT d.id, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN r[j] + 1 ELSE greatest(acc[j], r[j + 1]) END), [0])
      FROM d JOIN p USING (id) WHERE i < length(a)),
    c AS (SELECT d.id, r[-1] AS lcs FROM d JOIN p ON d.id = p.id AND d.i = length(p.a))
    SELECT p.id, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0::DOUBLE ELSE levenshtein(a, b) / greatest(length(a), length(b)) END AS edit,
      CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * lcs / (length(a) + length(b)) END AS indel,
      CASE WHEN w1 = 0 OR w2 = 0 THEN 0.0::DOUBLE ELSE least(w1, w2) / greatest(w1, w2) END AS words
    FROM (SELECT *, len(regexp_extract_all(a, '\\S+')) AS w1, len(regexp_extract_all(b, '\\S+')) AS w2 FROM p) p JOIN c USING (id)""",
)
def text_distances(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return values(spark, PAIRS, "id int, a string, b string").select("id", X.edit_distance(a, b).alias("edit"), X.indel_ratio(a, b).alias("indel"), X.length_ratio(a, b).alias("words"))


CODES = [(0, "Friends", "S01E01", 154.52, "FRIENDS-S01E01-00154520"), (1, "A very long show name: the sequel", "", 0.0, "A-VERY-LONG-SHOW-NAM-00000000"), (2, "--x--", "ep 1!", 123456.789, "X-EP1-123456789"), (3, "é", None, 1.0, "00001000"), (4, "Show", "S10E100100", 0.0005, "SHOW-S10E1001-00000000")]


@query("node_codes", f"SELECT id, code FROM {sql_values([(r[0], r[4]) for r in CODES if r[0] != 3], 'id, code')}")
def node_codes(spark, sf_dir):
    rows = values(spark, [r[:4] for r in CODES if r[0] != 3], "id int, s string, e string, t double")
    return rows.select("id", X.node_code(F.col("s"), F.col("e"), F.col("t")).alias("code"))


@query("clip_codes", "SELECT o_orderkey, concat('CLP-', substr(upper(o_orderpriority), 1, 2), '-', substr(upper(o_orderstatus), 1, 2), '-', upper(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6))) AS code FROM orders")
def clip_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.clip_code(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("code"))


NEEDLES = [(0, "a"), (1, "%"), (2, "_"), (3, "THE"), (4, "éa"), (5, "\\")]
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("contains_text", f"SELECT id, count(*) AS n FROM documents, {sql_values(NEEDLES, 'id, needle')} WHERE contains({FOLD.format('text')}, {FOLD.format('needle')}) GROUP BY id")
def contains_text(spark, sf_dir):
    found = F.array_compact(F.array(*[F.when(X.contains_text(F.col("text"), F.lit(n)), F.lit(i)) for i, n in NEEDLES]))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


LIKES = [(0, "50%", "50\\%"), (1, "a_b", "a\\_b"), (2, "\\", "\\\\"), (3, "plain", "plain")]


@query("like_escapes", f"SELECT id, escaped, TRUE AS found FROM {sql_values(LIKES, 'id, s, escaped')}")
def like_escapes(spark, sf_dir):
    return values(spark, [r[:2] for r in LIKES], "id int, s string").select("id", X.escape_like(F.col("s")).alias("escaped"), F.expr("s like replace(replace(replace(s, '\\\\', '\\\\\\\\'), '%', '\\\\%'), '_', '\\\\_') escape '\\\\'").alias("found"))


URLS = [(0, "https://www.ted.com/talks/ken_robinson_schools?language=en", "ken_robinson_schools", "Ken Robinson Schools"), (1, " https://www.ted.com/talks/a-b/transcript ", "a-b", "A B"), (2, "https://www.ted.com/about", None, None)]


@query("talk_slugs", f"SELECT id, slug, title FROM {sql_values([(r[0], r[2], r[3]) for r in URLS], 'id, slug, title')}")
def talk_slugs(spark, sf_dir):
    return values(spark, [r[:2] for r in URLS], "id int, u string").withColumn("slug", X.talk_slug(F.col("u"))).select("id", "slug", X.slug_title(F.col("slug")).alias("title"))


@query("safe_names", r"SELECT page_id, substr(regexp_replace(url, '[^\pL\pN_\-]', '_', 'g'), 1, 50) AS name FROM pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


ANSWERS = [(0, "1. 一\n2、 二\n\n3: 三", ["a", "b", "c"], ["一", "二", "三"]), (1, "1. 一", ["a", "b"], ["一", "b"]), (2, "x\ny\nz", ["a"], ["x"]), (3, "", ["a", "b"], ["a", "b"]), (4, "1. \n5：五", ["a"], ["五"])]


@query("numbered_answers", f"SELECT id, out FROM {sql_values([(r[0], r[3]) for r in ANSWERS], 'id, out')}")
def numbered_answers(spark, sf_dir):
    return values(spark, [r[:3] for r in ANSWERS], "id int, o string, f array<string>").select("id", X.numbered_lines(F.col("o"), F.col("f")).alias("out"))


PROBES = [(0, 20.0, 30.0, False), (1, 15.0, 18.0, True), (2, 5.0, 11.0, True), (3, 0.0, 10.0, False), (4, 39.0, 45.0, True), (5, 40.0, 45.0, False), (6, 0.0, 99.0, True)]


@query("range_overlaps", f"SELECT id, hit FROM {sql_values([(r[0], r[3]) for r in PROBES], 'id, hit')}")
def range_overlaps(spark, sf_dir):
    ranges = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((10.0, 20.0), (30.0, 40.0))])
    return values(spark, [r[:3] for r in PROBES], "id int, s double, e double").select("id", X.overlaps(F.col("s"), F.col("e"), ranges).alias("hit"))


@query("rule_tags", "SELECT node_id, 'daily' AS scene, 'neutral' AS emotion, CASE WHEN word_count <= 8 THEN 'beginner' WHEN word_count <= 20 THEN 'intermediate' ELSE 'advanced' END AS difficulty, 'neutral_statement' AS speech_act, 'rule' AS tag_source, FALSE AS needs_translation FROM nodes", ("nodes",))
def rule_tags(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", K.rule_tags(F.col("word_count")).alias("t")).select("node_id", *[f"t.{k}" for k in ("scene", "emotion", "difficulty", "speech_act", "tag_source", "needs_translation")])


TAGGED = [
    (0, '{"scene": "work", "emotion": "sad", "difficulty": "advanced", "keywords": ["a", "", "b", "c", "d", "e"], "speech_act": "warning"}', ["work", "sad", "advanced", "warning"], ["a", "b", "c", "d"]),
    (1, 'Sure! {"scene": "x", "emotion": "happy", "keywords": ["k"]} done', ["daily", "happy", "intermediate", "neutral_statement"], ["k"]),
    (2, "no json", None, None),
    (3, '{"scene": "humor"}', ["humor", "neutral", "intermediate", "neutral_statement"], []),
]


@query("tagger_answers", f"SELECT id, tags, keywords FROM {sql_values([(r[0], r[2], r[3]) for r in TAGGED], 'id, tags, keywords')}")
def tagger_answers(spark, sf_dir):
    t = F.col("t")
    return values(spark, [r[:2] for r in TAGGED], "id int, a string").withColumn("t", K.checked_tags(F.col("a"))).select("id", F.when(t.isNotNull(), F.array(t["scene"], t["emotion"], t["difficulty"], t["speech_act"])).alias("tags"), t["keywords"].alias("keywords"))


HINTS = [(0, "老板在会议上生气了", "work", "angry"), (1, "表白 约会 吵架", "romance", None), (2, "今天天气", None, None), (3, "争吵 工作", "conflict", None), (4, "没想到 惊喜 开心", None, "surprised")]


@query("tag_hints", f"SELECT id, scene, emotion FROM {sql_values([(r[0], r[2], r[3]) for r in HINTS], 'id, scene, emotion')}")
def tag_hints(spark, sf_dir):
    return values(spark, [r[:2] for r in HINTS], "id int, q string").select("id", K.hint(F.col("q"), L.SCENE_HINTS).alias("scene"), K.hint(F.col("q"), L.EMOTION_HINTS).alias("emotion"))


@query(
    "rank_scores",
    """
    WITH q AS (SELECT * FROM (VALUES (0, 'daily', 'sad'), (1, 'work', NULL), (2, NULL, 'happy'), (3, NULL, NULL)) AS t(query_id, s, e))
    SELECT query_id, node_id, tag, round(quality * 0.40::DOUBLE + quality / 2 * 0.25::DOUBLE + quality / 3 * 0.15::DOUBLE + tag * 0.12::DOUBLE + quality * 0.06::DOUBLE + occ * 0.02::DOUBLE, 6) AS score FROM (
    SELECT *, CASE WHEN s IS NULL AND e IS NULL THEN 0.0::DOUBLE WHEN s IS NOT NULL AND e IS NOT NULL THEN CASE WHEN scene = s THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN emotion = e THEN 0.4::DOUBLE ELSE 0 END
      WHEN s IS NOT NULL THEN CASE WHEN scene = s THEN 1.0::DOUBLE ELSE 0 END ELSE CASE WHEN emotion = e THEN 1.0::DOUBLE ELSE 0 END END AS tag,
      least(1.0::DOUBLE, ln(1 + occurrence_count) / ln(51)) AS occ, coalesce(quality_score, 0.0::DOUBLE) AS quality FROM nodes CROSS JOIN q)
    """,
    ("nodes",),
)
def rank_scores(spark, sf_dir):
    wanted = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(s).cast("string").alias("s"), F.lit(e).cast("string").alias("e")) for i, s, e in ((0, "daily", "sad"), (1, "work", None), (2, None, "happy"), (3, None, None))])
    q = F.coalesce("quality_score", F.lit(0.0))
    rows = nodes(spark, sf_dir).withColumn("q", F.explode(wanted)).withColumn("tag", K.tag_score(F.col("scene"), F.col("emotion"), F.col("q.s"), F.col("q.e")))
    return rows.select("q.query_id", "node_id", "tag", K.final_score(q, q / 3, q / 2, F.col("tag"), q, F.col("occurrence_count")).alias("score"))


@query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x / (s * s))), 6) AS length, round(v[1] / s, 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS s FROM embeddings)")
def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", K.unit(F.col("embedding")).alias("u")).select("vec_id", F.round(K.norm(F.col("u")) * K.norm(F.col("u")), 6).alias("length"), F.round(F.element_at("u", 1), 6).alias("first"))


@query("vector_bytes", "SELECT vec_id, CAST(4 * len(embedding) AS INT) AS n_bytes, embedding[1] AS first, embedding[len(embedding)] AS last FROM embeddings")
def vector_bytes(spark, sf_dir):
    from cueline.operators.vectors import from_bytes, to_bytes

    rows = table(spark, sf_dir, "embeddings")
    dim = len(rows.first().embedding)
    packed = rows.select("vec_id", to_bytes(F.col("embedding"), dim).alias("bytes"))
    return packed.select("vec_id", F.length("bytes").alias("n_bytes"), from_bytes(F.col("bytes"), dim).alias("v")).select("vec_id", "n_bytes", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))
