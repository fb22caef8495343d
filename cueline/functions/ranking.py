"""Vectors, tags and ranking, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueline.functions import lexicon as L
from cueline.params import DEFAULT, Params


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or has length 0."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def unit(a: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def occurrence(count: Column, params: Params = DEFAULT) -> Column:
    if params.occurrence_saturation <= 0:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.log1p(count) / F.log1p(F.lit(float(params.occurrence_saturation))))


def final_score(zh: Column, en: Column, translated: Column, tag: Column, quality: Column, count: Column, params: Params = DEFAULT) -> Column:
    return F.round(zh * params.weight_zh + translated * params.weight_translated + en * params.weight_en + tag * params.weight_tag + quality * params.weight_quality + occurrence(count, params) * params.weight_occurrence, 6)


def tag_score(scene: Column, emotion: Column, want_scene: Column, want_emotion: Column) -> Column:
    one = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    both = one(scene, want_scene) * 0.6 + one(emotion, want_emotion) * 0.4
    return F.when(want_scene.isNull() & want_emotion.isNull(), 0.0).when(want_scene.isNotNull() & want_emotion.isNotNull(), both).when(want_scene.isNotNull(), one(scene, want_scene)).otherwise(one(emotion, want_emotion))


def hint(query: Column, hints: dict[str, list[str]]) -> Column:
    """The label with most hints in the query, the first of equals; null without any."""
    counted = [F.struct(sum((F.contains(query, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("place"), F.lit(label).alias("label")) for k, (label, words) in enumerate(hints.items())]
    best = F.greatest(*counted)
    return F.when(best["n"] > 0, best["label"])


def difficulty(words: Column) -> Column:
    return F.when(words <= 8, "beginner").when(words <= 20, "intermediate").otherwise("advanced")


def rule_tags(words: Column) -> Column:
    """Tags of a line that no tagger has seen."""
    return F.struct(F.lit("daily").alias("scene"), F.lit("neutral").alias("emotion"), difficulty(words).alias("difficulty"), F.array().cast("array<string>").alias("keywords"), F.lit("neutral_statement").alias("speech_act"), F.lit("rule").alias("tag_source"), F.lit(False).alias("needs_translation"))


TAGS = "scene string, emotion string, difficulty string, keywords array<string>, speech_act string"


def checked_tags(answer: Column) -> Column:
    """Tags from a tagger's JSON, or from the first {..} in its answer; values out of range become the default. Null if there is no JSON."""
    whole = F.from_json(answer, TAGS)
    inner = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), TAGS)
    known = lambda x: x.isNotNull() & F.coalesce(x["scene"], x["emotion"], x["difficulty"], x["speech_act"], F.array_join(x["keywords"], ",")).isNotNull()
    t = F.when(known(whole), whole).when(known(inner), inner)
    one_of = lambda k, values, default: F.when(t[k].isin(*values), t[k]).otherwise(default).alias(k)
    words = F.filter(F.slice(F.coalesce(t["keywords"], F.array().cast("array<string>")), 1, 5), lambda x: x.isNotNull() & (x != ""))
    return F.when(
        t.isNotNull(),
        F.struct(one_of("scene", L.SCENES, "daily"), one_of("emotion", L.EMOTIONS, "neutral"), one_of("difficulty", L.DIFFICULTIES, "intermediate"), words.alias("keywords"), one_of("speech_act", L.SPEECH_ACTS, "neutral_statement"), F.lit("ai").alias("tag_source"), F.lit(False).alias("needs_translation")),
    )
