"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueline.llm.shared import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL for DuckDB if there is any."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cueline.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _seats(out: str, table: str, group: str, party: str, votes: str, seats: str) -> str:
    """Sainte-Lague seats as common table expressions: the ones that two divisors leave open go by quotient."""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    first = f"{group}, " if group else ""
    same = " AND ".join(f"p.{c} IS NOT DISTINCT FROM w.{c}" for c in f"{first}{party}".split(", "))
    return f"""
    {out}_p AS (SELECT *, greatest(0, ceil(share * greatest(0, {seats} - n / 2) - 0.5) - 1)::BIGINT AS low, CASE WHEN v > 0 THEN floor(share * ({seats} + n / 2) + 0.5) + 1 ELSE 0 END::BIGINT AS high
      FROM (SELECT *, CASE WHEN total > 0 THEN v / total ELSE 0.0 END AS share FROM (SELECT *, {votes}::DOUBLE AS v, count(*) {over} AS n, sum({votes}::DOUBLE) {over} AS total FROM {table}))),
    {out}_o AS (SELECT {first}{party}, {seats}, v, base, unnest(range(low + 1, high + 1)) AS k FROM (SELECT *, sum(low) {over} AS base FROM {out}_p) WHERE high > low),
    {out}_w AS (SELECT {first}{party}, count(*) AS won FROM (SELECT *, row_number() OVER ({f"PARTITION BY {group} " if group else ""}ORDER BY v / (2 * k - 1) DESC, k, {party} NULLS LAST) AS r FROM {out}_o) WHERE r <= {seats} - base GROUP BY ALL),
    {out} AS (SELECT p.*, low + coalesce(won, 0) AS quota FROM {out}_p p LEFT JOIN {out}_w w ON {same})"""


def _seeded(seed: int, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 12) AS BIGINT)"


_MIX = rf"""
    WITH sizes AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(text)) AS name, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s1 AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM sizes GROUP BY source),
    s2 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s1),
    s3 AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM s2 WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
    s4 AS (SELECT source, source_size, coalesce(least(cap, top * weight), cap)::DOUBLE AS target, t FROM (SELECT *, max(CASE WHEN cap >= level * weight THEN level END) OVER () AS top, sum(source_size) OVER () AS t FROM s3)),
    s5 AS (SELECT *, ceil(t / 256)::BIGINT AS blocks, greatest(1, ceil(source_size / 131072))::BIGINT AS shards FROM s4),
    {_seats("plan", "s5", "", "source", "target", "blocks").strip()},
    dealt AS (SELECT doc_id, name, z.source, size, source_size, target, quota AS source_quota, {_seeded(7, "name")} % shards AS shard FROM sizes z JOIN plan ON z.source IS NOT DISTINCT FROM plan.source),
    sh AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota FROM dealt GROUP BY source, shard),
    {_seats("q", "sh", "source", "shard", "shard_size", "source_quota").strip()},
    r1 AS (SELECT source, shard, shard_size, shard_size // 256 AS n_whole, least(quota * 256, 3 * shard_size) AS want FROM q),
    r2 AS (SELECT *, CASE WHEN shard_size > 0 THEN want // shard_size ELSE 0 END AS passes FROM r1),
    r3 AS (SELECT *, (want - passes * shard_size) // 256 AS picked, (want - passes * shard_size) % 256 AS part, list_transform(range(n_whole), lambda b: {{'hash': {_seeded(9, "source", "shard", "b")}, 'b': b}}) AS ranked FROM r2),
    r4 AS (SELECT *, list_sort(ranked)[picked + 1] AS edge FROM r3),
    r5 AS (SELECT source, shard, passes, list_append(list_transform(ranked, lambda x: CASE WHEN edge IS NULL OR x < edge THEN 256 WHEN x = edge THEN part ELSE 0 END), CASE WHEN picked >= n_whole THEN part ELSE 0 END) AS takes FROM r4),
    placed AS (SELECT d.*, passes, takes, (sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY {_seeded(8, "name")}, name, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begins
      FROM dealt d JOIN r5 ON d.source IS NOT DISTINCT FROM r5.source AND d.shard = r5.shard)
    SELECT doc_id, size, source_size, target, CAST(passes * size + CASE WHEN size > 0 THEN list_sum(list_transform(range(begins // 256, (begins + size - 1) // 256 + 1), lambda b:
      greatest(0, least(begins + size, b * 256 + takes[b + 1]) - greatest(begins, b * 256)))) ELSE 0 END AS BIGINT) AS taken
    FROM placed"""


@query("op2_source_mixing", _MIX)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query(
    "op3_warc_round_trip",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
    SELECT page_id, strlen(t) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + ((CAST('0x' || substr(sha1(t), CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM p
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.secret_scan import find_secrets, span_digests

    return span_digests(find_secrets(table(spark, sf_dir, "documents")))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.language_id import held_out_language_id

    return held_out_language_id(table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.quality_classifier import held_out_quality

    return held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.lm_score import held_out_scores

    return held_out_scores(table(spark, sf_dir, "documents"))


@query("op11_simhash_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op12_divergence_audit",
    r"""
    WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents),
    w AS (SELECT doc, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
    k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
    g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM k GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    d AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (k.n_lang + 2) // (l.total + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
      LEFT JOIN (SELECT x.lang, x.source AS x, y.source AS y, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM d x JOIN d y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) z
      ON z.lang = a.lang AND z.x = a.source AND z.y = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM d WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.divergence_audit import divergence_audit

    return divergence_audit(table(spark, sf_dir, "documents"))


def _bucketed(out: str, source: str, key: str) -> str:
    """Common table expressions: how often each bucket occurs in each text of a table, by CRC-32.

    Distinct words' CRCs go byte by byte; that of a longer run is the XOR of its last word's and of the CRC before it, moved on by as many zero bytes.
    """
    moved = "xor(xor({0}), xor({1}))".format(*[", ".join(f"tables[c.n * 1024 + {256 * k} + ((p.c >> {8 * k}) & 255) + 1]" for k in ks) for ks in ((0, 1), (2, 3))])
    return rf"""
    {out}_w AS (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT {key} AS doc,
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {source})),
    {out}_c AS (SELECT w.doc, w.i, v.c, v.spaced, v.n + 1 AS n FROM {out}_w w JOIN vocabulary v USING (word)),
    {out}_2 AS (SELECT c.doc, c.i, c.n, c.spaced, xor({moved}, c.spaced) AS c FROM {out}_c c JOIN {out}_c p ON p.doc = c.doc AND p.i = c.i - 1, zeros),
    {out}_3 AS (SELECT c.doc, xor({moved}, c.spaced) AS c FROM {out}_2 c JOIN {out}_2 p ON p.doc = c.doc AND p.i = c.i - 1, zeros),
    {out} AS MATERIALIZED (SELECT doc, c % 10000 AS bucket, count(*) AS n FROM (SELECT doc, c FROM {out}_c UNION ALL SELECT doc, c FROM {out}_2 UNION ALL SELECT doc, c FROM {out}_3) GROUP BY ALL)"""


_RESAMPLE = rf"""
    WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    step AS MATERIALIZED (SELECT b, c AS t FROM bits WHERE k = 8),
    d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    m AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(text, '') AS text FROM benchmark),
    words AS MATERIALIZED (SELECT word, encode(word) AS raw FROM (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM (SELECT text FROM d UNION ALL SELECT text FROM m))),
    crc AS (SELECT word, hex(raw) AS h, 0 AS k, 4294967295::BIGINT AS c, 378745018::BIGINT AS e FROM words
      UNION ALL SELECT word, h, k + 1, xor(x.t, c >> 8), xor(y.t, e >> 8) FROM (SELECT *, CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) AS byte FROM crc WHERE 2 * k < length(h)) o
      JOIN step x ON x.b = xor(o.c & 255, o.byte) JOIN step y ON y.b = xor(o.e & 255, o.byte)),
    vocabulary AS MATERIALIZED (SELECT word, k AS n, xor(c, 4294967295) AS c, xor(e, 4294967295) AS spaced FROM crc WHERE 2 * k = length(h)),
    z AS (SELECT 0::BIGINT AS n, place, b, b << (8 * place) AS c FROM range(256) r(b), range(4) s(place)
      UNION ALL SELECT n + 1, place, z.b, xor(t, c >> 8) FROM z JOIN step ON step.b = c & 255 WHERE n <= (SELECT max(n) FROM vocabulary)),
    zeros AS MATERIALIZED (SELECT list(c ORDER BY n, place, b) AS tables FROM z),
    {_bucketed("ds", "d", "row").strip()},
    {_bucketed("ms", "m", "row").strip()},
    counts AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM (SELECT bucket, 0 AS s, 0 AS t FROM range(10000) r(bucket) UNION ALL SELECT bucket, n, 0 FROM ds UNION ALL SELECT bucket, 0, n FROM ms) GROUP BY bucket),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts),
    weights AS (SELECT doc, sum(n) AS n_features, sum(n * gain) AS weight FROM ds JOIN gains USING (bucket) GROUP BY doc),
    lengths AS (SELECT doc, count(*) AS n_words FROM ds_w GROUP BY doc),
    scored AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN weights w ON w.doc = d.row LEFT JOIN lengths l ON l.doc = d.row),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ordered"""


@query("op13_importance_resampling", _RESAMPLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueline.llm.importance_resampling import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
