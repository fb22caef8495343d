"""Queries of services that take lines in blocks, with functions in their place."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cueline.operators import services as S
from cueline.plans.base import NEEDS, VIEWS, lines, query

SCENES = ("work", "humor", "nowhere")


def tagger(texts: list[str], before: list[str]) -> str:
    """Answers as the length of the first text says: a list, one in an object, a short one, items that are none, no list, or an error."""
    items = [{"scene": SCENES[len(t) % 3], "speech_act": "warning", "keywords": ["k", None, str(len(t))]} for t in texts]
    kind = len(texts[0]) % 7
    if kind == 1:
        return json.dumps({"note": 1, "results": items})
    if kind == 2:
        return json.dumps(items[:3])
    if kind == 3:
        return json.dumps({"answers": [x if len(t) % 2 else None for x, t in zip(items, texts, strict=True)]})
    if kind == 4:
        return "Sorry, no list: [1, 2"
    if kind == 5:
        raise RuntimeError("429")
    return json.dumps(items)


def backup(texts: list[str], before: list[str]) -> str:
    return "{}" if len(texts) == 10 else json.dumps([{"emotion": "happy", "keywords": "none"}] * len(texts))


def translator(texts: list[str], before: list[str]) -> str:
    """What a line was given with: how many lines before the block, the length of the last one, its own. Every third block lacks its last line."""
    if len(texts[-1]) % 5 == 4:
        raise RuntimeError("busy")
    said = [f"{k + 1}. b{len(before)} l{len(before[-1]) if before else 0} n{len(t)}" for k, t in enumerate(texts)]
    return "\n".join(said[: len(said) - (len(texts[0]) % 3 == 0)])


def _given(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", "line_id", F.col("en_text").alias("text"), "word_count")


VIEWS["placed"] = "SELECT *, length(en_text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM lines"
VIEWS["tens"] = "SELECT *, place // 10 AS block, place % 10 AS nth, first_value(n) OVER w % 7 AS kind, count(*) OVER (PARTITION BY doc_id, place // 10) AS size FROM placed WINDOW w AS (PARTITION BY doc_id, place // 10 ORDER BY pos)"
VIEWS["tagged"] = """SELECT line_id, CASE WHEN ok THEN CASE WHEN block % 2 = 0 AND NOT bare THEN ['work', 'humor', 'daily'][n % 3 + 1] ELSE 'daily' END ELSE 'daily' END AS scene,
    CASE WHEN ok AND block % 2 = 1 AND size < 10 THEN 'happy' ELSE 'neutral' END AS emotion,
    CASE WHEN ok THEN 'intermediate' WHEN word_count <= 8 THEN 'beginner' WHEN word_count <= 20 THEN 'intermediate' ELSE 'advanced' END AS difficulty,
    CASE WHEN ok AND block % 2 = 0 AND NOT bare THEN concat('k,', n) ELSE '' END AS keywords, CASE WHEN ok AND block % 2 = 0 AND NOT bare THEN 'warning' ELSE 'neutral_statement' END AS speech_act,
    CASE WHEN NOT ok THEN 'rule' WHEN block % 2 = 0 THEN 'main' ELSE 'backup' END AS tag_source
    FROM (SELECT *, block % 2 = 1 OR (kind NOT IN (4, 5) AND (kind <> 3 OR n % 2 = 1)) AS ok, kind = 2 AND nth >= 3 AS bare FROM tens)"""
NEEDS["placed"], NEEDS["tens"] = ("lines0", "lines"), ("lines0", "lines", "placed")
NEEDS["tagged"] = (*NEEDS["tens"], "tens")


def _tagged(spark, sf_dir):
    return S.tag_lines(_given(spark, sf_dir), ["doc_id"], ["pos"], {"main": tagger, "backup": backup}, attempts=2, pause=lambda attempt, error: 0.0)


@query("tagged_lines", "SELECT * FROM tagged", ("tagged",))
def tagged_lines(spark, sf_dir):
    return _tagged(spark, sf_dir).withColumn("keywords", F.array_join("keywords", ",")).drop("needs_translation")


@query("tagger_counts", "SELECT tag_source, count(*) AS n FROM tagged GROUP BY tag_source", ("tagged",))
def tagger_counts(spark, sf_dir):
    return S.service_counts(_tagged(spark, sf_dir))


@query(
    "translated_lines",
    """, b AS (SELECT *, place // 40 AS block, lag(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS n_before, row_number() OVER v AS k, count(*) OVER (PARTITION BY doc_id, place // 40) AS size,
        first_value(n) OVER v AS first, last_value(n) OVER (PARTITION BY doc_id, place // 40 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM placed WINDOW v AS (PARTITION BY doc_id, place // 40 ORDER BY pos)),
    c AS (SELECT *, first_value(n_before) OVER (PARTITION BY doc_id, block ORDER BY pos) AS l FROM b)
    SELECT line_id, md5(CASE WHEN last % 5 = 4 OR (k = size AND first % 3 = 0) THEN en_text ELSE concat('b', CASE WHEN block = 0 THEN 0 ELSE 3 END, ' l', CASE WHEN block = 0 THEN 0 ELSE l END, ' n', n) END) AS zh_text FROM c""",
    ("placed",),
)
def translated_lines(spark, sf_dir):
    return S.translate_lines(_given(spark, sf_dir), ["doc_id"], ["pos"], translator, pause=lambda attempt, error: 0.0).withColumn("zh_text", F.md5("zh_text"))
