"""Line gates, their statistics, and scores that need the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.lexicon import FUNCTION_WORDS
from cueline.functions.quality import early_status, spoken_score, stored_score
from cueline.params import DEFAULT, Params


def filter_lines(lines: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The lines with filter_status and quality_score: the first gate that a line fails, and its score if it reaches the last one, else 0.

    lines: en_text, word_count. Each step is a projection of its own, so that a score is computed once and only where it is needed.
    """
    staged = lines.withColumn("early__", early_status(F.col("en_text"), F.col("word_count"), params))
    scored = staged.withColumn("quality_score", F.when(F.col("early__").isNull(), spoken_score(F.col("en_text"))).otherwise(0.0))
    status = F.coalesce("early__", F.when(F.col("quality_score") >= params.quality_threshold, "passed").otherwise("rejected_quality"))
    return scored.withColumn("filter_status", status).drop("early__")


def with_stored_score(filtered: DataFrame) -> DataFrame:
    return filtered.withColumn("quality_score", stored_score(F.col("quality_score")))


def filter_stats(filtered: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals by status and the share that went; one row without a grouping, then with a share of 1 for no lines."""
    count = lambda s: F.count_if(F.col("filter_status") == s)
    total = F.count(F.lit(1))
    return filtered.groupBy(*(by or [])).agg(
        total.alias("total"),
        count("passed").alias("passed"),
        F.when(total > 0, F.round(1 - count("passed") / F.greatest(total, F.lit(1)), 4)).otherwise(1.0).alias("filter_rate"),
        count("rejected_blacklist").alias("rejected_blacklist"),
        count("rejected_wordcount").alias("rejected_wordcount"),
        count("rejected_quality").alias("rejected_quality"),
    )


#: word and c, how often it occurs, of each word of an array: runs of the sorted array, found within the row, in time linear in its length. An array of one
#: holds what is used many times, so that it is computed once.
RUNS = """transform(array(array_sort(words)), s -> transform(array(filter(sequence(0, size(s)), i -> i < size(s) AND (i = 0 OR get(s, i) <> get(s, i - 1)))),
    t -> transform(t, (at, k) -> struct(get(s, at) AS word, coalesce(get(t, k + 1), size(s)) - at AS c)))[0])[0]"""


def tfidf_scores(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """How rare a line's words are in the batch, scaled to [0, 1]: key, tfidf. lines: key, en_text.

    Lines without words score like 0 before scaling; a single line, or lines that are all alike, get 0.5. The number of lines
    and the range are one row each, joined as such: no window gathers the batch in one task.
    """
    words = F.filter(F.regexp_extract_all(F.lower("en_text"), F.lit("([a-z']+)"), F.lit(1)), lambda w: ~w.isin(*sorted(FUNCTION_WORDS)) & (F.length(w) > 2))
    split = lines.select(key, words.alias("words"))
    total = split.agg(F.count(F.lit(1)).alias("n"))
    counts = split.select(key, F.size("words").alias("size"), F.explode(F.expr(RUNS)).alias("w")).select(key, "size", "w.*")
    seen = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rated = counts.join(seen, "word").crossJoin(F.broadcast(total))  # one row
    raw = rated.groupBy(key).agg(F.sum(F.col("c") * F.col("c") / F.col("size") / F.col("size") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    every = split.select(key).join(raw, key, "left").select(key, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    span = every.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return every.crossJoin(F.broadcast(span)).select(key, F.when(F.col("high") - F.col("low") < 1e-9, 0.5).otherwise((F.col("raw") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))).alias("tfidf"))


def novelty(lines: DataFrame, known: DataFrame, key: str = "line_id", params: Params = DEFAULT) -> DataFrame:
    """1 less the mean cosine with the nearest known vectors, in [0, 1]; 1 if nothing is known: key, novelty.

    lines: key, embedding; known: node_id, embedding.
    """
    from cueline.operators.vectors import nearest

    near = nearest(lines, known, params.novelty_k, key).groupBy(key).agg(F.avg("similarity").alias("mean"))
    return lines.select(key).join(near, key, "left").select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(1 - F.col("mean"), F.lit(1.0)))).alias("novelty"))


def contextual_scores(lines: DataFrame, known: DataFrame, key: str = "line_id", params: Params = DEFAULT) -> DataFrame:
    """key, tfidf, novelty, contextual, and whether it passes."""
    both = tfidf_scores(lines, key).join(novelty(lines, known, key, params), key)
    score = F.col("tfidf") * params.tfidf_weight + F.col("novelty") * params.novelty_weight
    return both.withColumn("contextual", score).withColumn("passed", F.col("contextual") >= params.context_threshold)


def reevaluate(nodes: DataFrame, restore: bool, params: Params = DEFAULT) -> DataFrame:
    """Nodes with their score computed again; those under the threshold retire, and with `restore` those above it come back."""
    score = spoken_score(F.col("en_text"))
    active = F.when(score < params.quality_threshold, F.lit(False)).otherwise(F.lit(True) if restore else F.col("is_active"))
    return nodes.withColumn("quality_score", score).withColumn("is_active", active)


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank__ = 1").drop("rank__")


