"""The registry's decorator, and the tables that queries run over: domain objects made from the given tables.

Each table has a Spark form and the same as a DuckDB view (a common table expression), so that both engines see the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.workers import let_workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query, with its SQL for DuckDB after the views that it needs."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            needed: list[str] = []
            for v in views:
                needed += [x for x in (*NEEDS.get(v, ()), v) if x not in needed]
            recursive = "RECURSIVE " if "RECURSIVE" in sql[:40] else ""
            body = bigint_counts(sql).strip().removeprefix("RECURSIVE").strip()
            head = ", ".join(f"{v} AS {'MATERIALIZED ' * (v in COSTLY)}({VIEWS[v].strip()})" for v in needed)
            if not head:
                ORACLES[name] = body
            elif body.startswith(","):  # more common table expressions
                ORACLES[name] = f"WITH {recursive}{head}{body}"
            elif body.upper().startswith("WITH "):
                ORACLES[name] = f"WITH {recursive}{head}, {body[5:].strip().removeprefix('RECURSIVE').strip()}"
            else:
                ORACLES[name] = f"WITH {recursive}{head} {body}"
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bigint_counts(sql: str) -> str:
    """count_if(x) as a filtered count: DuckDB's count_if has another type than Spark's."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 0, at + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if') + 1 : end - 1]}){sql[end:]}"
    return sql


VIEWS: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}
#: Views that DuckDB shall compute once.
COSTLY: set[str] = set()

# Lines of documents, as captions of an episode: 300 ms a word, and gaps that depend on the place.
VIEWS["lines0"] = """
SELECT doc_id, lang, source, unnest(range(len(p))) AS pos, unnest(p) AS en_text
FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
"""
VIEWS["lines"] = r"""
SELECT doc_id, lang, source, pos, en_text, word_count, gap_ms,
       CAST(sum(300 * word_count + gap_ms) OVER w - 300 * word_count AS DOUBLE) / 1000 AS start_time,
       CAST(sum(300 * word_count + gap_ms) OVER w AS DOUBLE) / 1000 AS end_time,
       doc_id * 100000 + pos AS line_id
FROM (SELECT *, len(regexp_extract_all(en_text, '[^ \t\n\x0B\f\r]+')) AS word_count, (doc_id * 7 + pos * 13) % 2000 AS gap_ms FROM lines0)
WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
"""
NEEDS["lines"] = ("lines0",)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "en_text"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # by number: the gates take time, not space, so small tables stay spread
    rows = rows.withColumn("word_count", F.regexp_count("en_text", F.lit(r"\S+")).cast("long")).withColumn("gap_ms", (F.col("doc_id") * 7 + F.col("pos") * 13) % 2000)
    end = F.sum(300 * F.col("word_count") + F.col("gap_ms")).over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("end_ms", end).select("doc_id", "lang", "source", "pos", "en_text", "word_count", "gap_ms", ((F.col("end_ms") - 300 * F.col("word_count")).cast("double") / 1000).alias("start_time"), (F.col("end_ms").cast("double") / 1000).alias("end_time"), (F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"))


# Turns of conversations as segments of a transcript.
VIEWS["segments"] = r"""
SELECT 'c' || CAST(conv_id AS VARCHAR) AS show_name, 'E01' AS episode, turn AS seq_index, coalesce(text, '') AS text,
       CAST(sum(250 * w + g) OVER o - 250 * w AS DOUBLE) / 1000 AS start_time, CAST(sum(250 * w + g) OVER o AS DOUBLE) / 1000 AS end_time
FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS w, (conv_id * 11 + turn * 17) % 1900 AS g FROM conversations)
WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", F.regexp_count("text", F.lit(r"\S+")).cast("long")).withColumn("g", (F.col("conv_id") * 11 + F.col("turn") * 17) % 1900)
    end = F.sum(250 * F.col("w") + F.col("g")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("e", end).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("show_name"), F.lit("E01").alias("episode"), F.col("turn").alias("seq_index"), "text", ((F.col("e") - 250 * F.col("w")).cast("double") / 1000).alias("start_time"), (F.col("e").cast("double") / 1000).alias("end_time"))


#: Columns of nodes, made from documents by expressions that Spark and DuckDB read alike.
NODE = {
    "node_id": "doc_id",
    "subtitle_id": "CASE WHEN doc_id % 3 = 0 THEN doc_id * 100000 END",
    "en_text": "text",
    "zh_text": "CASE WHEN lang = 'en' THEN NULL ELSE concat('zh ', source) END",
    "show_name": "source",
    "episode": "concat('S01E', CAST(doc_id % 24 AS VARCHAR(9)))",
    "start_time": "CAST(doc_id * 37 % 3600 AS DOUBLE)",
    "end_time": "CAST(doc_id * 37 % 3600 AS DOUBLE) + CAST(n_chars % 200 AS DOUBLE) / 10",
    "code": "CASE WHEN doc_id % 4 = 0 THEN concat('OLD-', CAST(doc_id % 50 AS VARCHAR(9))) END",
    "word_count": "n_chars % 30",
    "occurrence_count": "CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 + doc_id % 60 END",
    "scene": "CASE doc_id % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'work' WHEN 2 THEN 'romance' WHEN 3 THEN 'conflict' ELSE 'humor' END",
    "emotion": "CASE doc_id % 5 WHEN 0 THEN 'sad' WHEN 1 THEN 'neutral' WHEN 2 THEN 'happy' WHEN 3 THEN 'angry' ELSE 'surprised' END",
    "difficulty": "CASE WHEN n_chars % 30 <= 8 THEN 'beginner' WHEN n_chars % 30 <= 20 THEN 'intermediate' ELSE 'advanced' END",
    "quality_score": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 97 AS DOUBLE) / 97 END",
    "tag_source": "CASE WHEN doc_id % 6 = 0 THEN 'rule' ELSE 'ai' END",
    "needs_translation": "lang = 'en'",
    "is_active": "doc_id % 9 <> 4",
    "content_type": "CASE WHEN doc_id % 2 = 0 THEN 'tv' ELSE 'talk' END",
}
VIEWS["nodes"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in NODE.items()) + " FROM documents"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{v.replace('VARCHAR(9)', 'STRING')} AS {k}" for k, v in NODE.items()])


#: Columns of clips, made from orders.
CLIP = {
    "clip_id": "o_orderkey",
    "node_id": "o_custkey",
    "show_name": "o_orderpriority",
    "episode": "concat('E', CAST(o_custkey % 10 AS VARCHAR(9)))",
    "clip_status": "CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'unmatched' ELSE 'failed' END",
    "is_active": "o_orderkey % 7 <> 3",
    "match_confidence": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS DOUBLE) / 1000 END",
}
VIEWS["clips"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CLIP.items()) + " FROM orders"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{v.replace('VARCHAR(9)', 'STRING')} AS {k}" for k, v in CLIP.items()])


# Events as feedback: the user stands for the query.
VIEWS["feedback"] = "SELECT event_id, concat('q', CAST(user_id AS VARCHAR)) AS query, event_type AS action, ts AS created_at FROM events"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)


def literal(x) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x) if isinstance(x, int) else f"CAST({x!r} AS DOUBLE)"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same literal table for DuckDB."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"
