"""Reports over lines, nodes, clips, videos and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.quality import retired_labels
from cueline.operators.quality import first_per_key

ONE = F.count  # of a literal: rows


def _share(part, whole):
    """Rounded to four places; 0 of nothing."""
    return F.when(whole > 0, F.round(part / F.greatest(whole, F.lit(1)), 4)).otherwise(0.0)


def status_distribution(lines: DataFrame) -> DataFrame:
    """Lines by status, with the share of all."""
    counts = lines.groupBy("filter_status").agg(ONE(F.lit(1)).alias("n"))
    total = lines.agg(ONE(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("filter_status", "n", _share(F.col("n"), F.col("total")).alias("share"))  # one row


def node_status(nodes: DataFrame) -> DataFrame:
    """Active nodes in one pass, in all and by difficulty, scene, source of tags and show: dimension, value, total, with_zh, needs_translation, zh_rate."""
    active = nodes.where("is_active").select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in [("all", F.lit("all")), ("difficulty", F.col("difficulty")), ("scene", F.col("scene")), ("tag_source", F.col("tag_source")), ("show", F.col("show_name"))]])).alias("g"),
        (F.coalesce("zh_text", F.lit("")) != "").alias("zh"), "needs_translation",
    )
    total = ONE(F.lit(1))
    return active.groupBy("g.dimension", "g.value").agg(total.alias("total"), F.count_if("zh").alias("with_zh"), F.count_if("needs_translation").alias("needs_translation"), _share(F.count_if("zh"), total).alias("zh_rate"))


def shows(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_active").groupBy("show_name").agg(ONE(F.lit(1)).alias("n"))


def episodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("show_name", "episode").agg(ONE(F.lit(1)).alias("n"))


def batches(lines: DataFrame, show: str | None = None, content_type: str | None = None) -> DataFrame:
    """Batches of lines; a show, if given, decides alone, else the content type."""
    own = lines.where("subtitle_code IS NOT NULL")
    if show:
        own = own.where(F.col("show_name") == show)
    elif content_type:
        own = own.where(F.col("content_type") == content_type)
    return own.groupBy("subtitle_code", "show_name", "en_name", "episode", "content_type").agg(ONE(F.lit(1)).alias("line_count"), F.min("created_at").alias("created_at"))


def upload_shows(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shows that have nodes, with their least English name and their first content type."""
    by = lines.groupBy("show_name", "content_type").agg(F.min("en_name").alias("en_name"))
    return first_per_key(by, ["show_name"], ["content_type"]).join(nodes.select("show_name").distinct(), "show_name", "left_semi")


def clip_quality(clips: DataFrame) -> DataFrame:
    """Clips by show and episode, by show, and in all (rollup; `level` is 0 for the episode, 1 for the show, 3 for all)."""
    count = lambda s: F.count_if(F.col("clip_status") == s).alias(s)
    return clips.rollup("show_name", "episode").agg(F.grouping_id().cast("int").alias("level"), ONE(F.lit(1)).alias("total"), count("matched"), count("unmatched"), count("failed"), F.round(F.coalesce(F.avg("match_confidence"), F.lit(0.0)), 4).alias("avg_confidence"))


def clip_status(clips: DataFrame, nodes: DataFrame, content_type: str | None = None) -> DataFrame:
    """Clips by status, of nodes of a content type if one is given."""
    own = clips if content_type is None else clips.join(nodes.where(F.col("content_type") == content_type).select("node_id"), "node_id", "left_semi")
    return own.groupBy("clip_status").agg(ONE(F.lit(1)).alias("n"))


def clip_breakdown(clips: DataFrame, statuses: list[str]) -> DataFrame:
    """Shows by status, a column for each."""
    return clips.groupBy("show_name").pivot("clip_status", statuses).agg(ONE(F.lit(1))).na.fill(0)


def failed_nodes(clips: DataFrame) -> DataFrame:
    return clips.where("clip_status = 'failed'").select("node_id").distinct()


def video_status(videos: DataFrame) -> DataFrame:
    total = ONE(F.lit(1))
    return videos.agg(total.alias("total"), F.count_if("has_transcript").alias("with_transcript"), (total - F.count_if("has_transcript")).alias("without_transcript"), ONE("last_clipped_at").alias("clipped"))


def feedback_since(feedback: DataFrame, days: int, as_of: DataFrame | None = None) -> DataFrame:
    """Feedback of the last days before as_of (one row with column at); without it, before the last row."""
    at = feedback.agg(F.max("created_at").alias("at")) if as_of is None else as_of
    return feedback.crossJoin(F.broadcast(at)).where(F.col("created_at") >= F.col("at") - F.make_dt_interval(F.lit(days))).drop("at")  # one row


def feedback_by_action(feedback: DataFrame, days: int) -> DataFrame:
    return feedback_since(feedback, days).groupBy("action").agg(ONE(F.lit(1)).alias("n"))


def feedback_top(feedback: DataFrame, days: int, n: int = 20) -> DataFrame:
    """The n most frequent queries."""
    return feedback_since(feedback, days).groupBy("query").agg(ONE(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(n)


def retired_patterns(nodes: DataFrame) -> DataFrame:
    """Labels of retired nodes: count, share of all, mean score, first three examples. nodes: node_id, en_text, quality_score, is_active."""
    own = nodes.where("NOT is_active").select("node_id", "en_text", F.coalesce("quality_score", F.lit(0.0)).alias("score"))
    total = own.agg(ONE(F.lit(1)).alias("total"))
    labelled = own.withColumn("label", F.explode(retired_labels(F.col("en_text"), F.col("score"))))
    first = F.row_number().over(Window.partitionBy("label").orderBy("node_id"))
    ranked = labelled.withColumn("place", first)
    by = ranked.groupBy("label").agg(ONE(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("node_id")))).alias("examples"))
    return by.crossJoin(F.broadcast(total)).select("label", "n", _share(F.col("n"), F.col("total")).alias("share"), "avg_score", "examples")  # one row


BUCKETS = [(0.3, "0.0-0.3"), (0.4, "0.3-0.4"), (0.5, "0.4-0.5"), (0.6, "0.5-0.6")]


def score_distribution(nodes: DataFrame) -> DataFrame:
    """One row: retired nodes by bucket of score, mean, median, standard deviation."""
    s = F.coalesce("quality_score", F.lit(0.0))
    low, columns = None, []
    for top, name in BUCKETS:
        inside = (s < top) if low is None else (s >= low) & (s < top)
        columns.append(F.count_if(inside).alias(f"bucket_{name}"))
        low = top
    columns.append(F.count_if(s >= low).alias("bucket_0.6+"))
    return nodes.where("NOT is_active").agg(ONE(F.lit(1)).alias("total"), *columns, F.round(F.coalesce(F.avg(s), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.median(s), F.lit(0.0)), 4).alias("median"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 4).alias("stdev"))


def recommendations(nodes: DataFrame) -> DataFrame:
    """Signals that the retired nodes give for the gates: signal, confidence, n."""
    own = nodes.where("NOT is_active").select("en_text", F.coalesce("quality_score", F.lit(0.0)).alias("score"))
    labels = retired_labels(F.col("en_text"), F.col("score"))
    has = lambda k: F.count_if(F.array_contains("labels", k))
    total = ONE(F.lit(1))
    one = own.withColumn("labels", labels).agg(total.alias("total"), *[has(k).alias(k) for k in ("stage_direction", "self_introduction", "pronoun_dependent", "unclassified")], F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean"))
    rule = lambda k, yes, sure: F.when(yes, F.struct(F.lit(k).alias("signal"), F.lit(sure).alias("confidence"), (F.col(k) if k in one.columns else F.col("total")).alias("n")))
    over = lambda k, share: (F.col("total") > 0) & (F.col(k) / F.greatest(F.col("total"), F.lit(1)) > share)
    found = F.array_compact(F.array(rule("stage_direction", over("stage_direction", 0.05), "high"), rule("self_introduction", F.col("self_introduction") > 0, "high"), rule("pronoun_dependent", over("pronoun_dependent", 0.10), "medium"), rule("unclassified", over("unclassified", 0.20), "low"), rule("quality_threshold", F.col("mean") > 0.5, "medium")))
    return one.select(F.explode(found).alias("r")).select("r.*")


def latest_labels(nodes: DataFrame, rows: int = 30, top: int = 5) -> DataFrame:
    """The most frequent labels of the latest retired nodes."""
    latest = nodes.where("NOT is_active").orderBy(F.desc("node_id")).limit(rows)
    return latest.select(F.explode(retired_labels(F.col("en_text"), F.col("quality_score"))).alias("label")).groupBy("label").agg(ONE(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)


def merge_preview(pairs: DataFrame) -> DataFrame:
    """Neighbouring pairs by what keeps them apart. pairs: reason."""
    return pairs.groupBy("reason").agg(ONE(F.lit(1)).alias("n"))


def provider_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(ONE(F.lit(1)).alias("calls"), F.round(F.sum("seconds"), 4).alias("seconds"))


def node_detail(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes with the list of their sources, in order."""
    listed = sources.groupBy("node_id").agg(F.array_sort(F.collect_list(F.concat_ws("/", "show_name", "episode"))).alias("sources"))
    return nodes.join(listed, "node_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def paged(table: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page (from 1) in a total order."""
    return table.orderBy(*order).offset((page - 1) * size).limit(size)


def gate_agreement(filtered: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the gate against gold marks. filtered: doc_id, filter_status; gold: doc_id, quality."""
    j = filtered.join(gold, "doc_id").select((F.col("filter_status") == "passed").alias("p"), (F.col("quality") == 1).alias("g"))
    tp, fp, fn = F.count_if(F.col("p") & F.col("g")), F.count_if(F.col("p") & ~F.col("g")), F.count_if(~F.col("p") & F.col("g"))
    return j.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"))
