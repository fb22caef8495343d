"""Changes of the knowledge base as pure transforms: tables in, new versions of tables out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.ranking import rule_tags
from cueline.functions.text import for_duplicates, node_code
from cueline.operators.duplicates import edit_duplicates, first_in_batch, near_each_other, vector_duplicates
from cueline.operators.folds import merge_lines
from cueline.operators.quality import contextual_scores, filter_lines
from cueline.params import DEFAULT, Params
from cueline.workers import forget, kept, stored

if TYPE_CHECKING:
    import pandas as pd

SOURCE = ["node_id", "show_name", "episode"]


def new_episodes(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines of episodes that are not there yet."""
    return lines.join(known.select("show_name", "episode").distinct(), ["show_name", "episode"], "left_anti")


def unsynced(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Passed lines that no node came from."""
    return lines.where("filter_status = 'passed'").join(nodes.where("subtitle_id IS NOT NULL").select(F.col("subtitle_id").alias("line_id")), "line_id", "left_anti")


def subtitle_ids(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows with subtitle_id: the last line of the same episode and text."""
    last = lines.groupBy("episode", "en_text").agg(F.max("line_id").alias("subtitle_id"))
    return rows.join(last, ["episode", "en_text"], "left")


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Sources with new ones, each node, show and episode once; what is there stays."""
    both = sources.select(*SOURCE, F.lit(0).alias("age__")).unionByName(new.select(*SOURCE, F.lit(1).alias("age__")))
    return both.groupBy(*SOURCE).agg(F.min("age__").alias("age__")).select(*SOURCE, (F.col("age__") == 1).alias("is_new"))


def _active(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_active") if "is_active" in nodes.columns else nodes


def _known_to(lines: DataFrame, nodes: DataFrame, params: Params) -> DataFrame:
    """line_id and node_id of the lines that active nodes have: by edit distance, and where there are vectors by these."""
    if "embedding" not in lines.columns:
        return edit_duplicates(lines, _active(nodes), params)
    coarse = edit_duplicates(lines, _active(nodes), params)
    fine = vector_duplicates(lines.join(coarse, "line_id", "left_anti"), nodes, params)
    return coarse.unionByName(fine)


def gate_batch(lines: DataFrame, nodes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The lines of a batch with filter_status and quality_score, and in_context: whether a passed line is rare enough in the batch and new
    enough to the nodes; null for lines that fail before, true where lines have no vectors."""
    gated = filter_lines(lines.withColumn("en_text", F.col("text")), params).drop("en_text")
    if "embedding" not in lines.columns:
        return gated.withColumn("in_context", F.when(F.col("filter_status") == "passed", F.lit(True)))
    gated = kept(gated)
    passed = gated.where("filter_status = 'passed'").select("line_id", F.col("text").alias("en_text"), "embedding")
    scores = contextual_scores(passed, nodes.where("embedding IS NOT NULL").select("node_id", "embedding"), "line_id", params)
    return gated.join(scores.select("line_id", F.col("passed").alias("in_context")), "line_id", "left")


def ingest(lines: DataFrame, nodes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """What becomes of each line of a batch: filter_status, in_context, and for lines that pass both gates outcome and node_id.

    lines: line_id, text, word_count, show_name, episode, start_time, perhaps embedding; nodes: node_id, text, perhaps embedding and is_active. A
    line that an active node has is 'merged' into it. Of the others that read alike the first one counts and the rest are 'repeated'; lines that are
    only near to each other all count, as the batch is compared with what was there before. A line that counts is 'merged' into a node
    of exactly its text, active or not, and else 'created'.
    """
    nodes = kept(nodes)  # read several times, and Spark then knows its size: few vectors are sent to the lines, and these are packed once
    gated = kept(gate_batch(lines, nodes, params))
    live = gated.where("filter_status = 'passed' AND in_context")
    settled = kept(live.join(_known_to(live, nodes, params), "line_id", "left"))
    exact = nodes.groupBy("text").agg(F.min("node_id").alias("exact_id"))
    fresh = first_in_batch(settled.where("node_id IS NULL"), ["line_id"]).join(exact, "text", "left")
    outcome = F.when(~F.col("first_seen"), "repeated").when(F.col("exact_id").isNotNull(), "merged").otherwise("created")
    fresh = fresh.withColumn("outcome", outcome).withColumn("node_id", F.when(F.col("first_seen"), F.col("exact_id"))).drop("first_seen", "exact_id")
    merged = settled.where("node_id IS NOT NULL").withColumn("outcome", F.lit("merged"))
    rest = gated.where("filter_status <> 'passed' OR NOT in_context").withColumn("node_id", F.lit(None).cast("long")).withColumn("outcome", F.lit(None).cast("string"))
    return merged.unionByName(fresh).unionByName(rest)


def ingested_sources(ingested: DataFrame, sources: DataFrame | None = None, first_id: int = 1) -> DataFrame:
    """node_id, show_name, episode, subtitle_id that a batch adds: of merged lines the node's, of created ones their own; each node and episode once.

    subtitle_id is the last line of the episode with the text of the first line that brings the source. sources: those that are there.
    """
    marked = subtitle_ids(ingested.withColumn("en_text", F.col("text")).select("line_id", "episode", "en_text", "show_name", "node_id", "outcome"), ingested.select("episode", F.col("text").alias("en_text"), "line_id"))
    new = marked.where("outcome IN ('merged', 'created')").withColumn("node_id", F.coalesce("node_id", F.col("line_id") + first_id))
    new = new.groupBy(*SOURCE).agg(F.min_by("subtitle_id", "line_id").alias("subtitle_id"))
    return new.join(sources.select(*SOURCE).distinct(), SOURCE, "left_anti") if sources is not None else new


def created_nodes(ingested: DataFrame, first_id: int = 1) -> DataFrame:
    """Nodes of created lines: rule tags, code, one occurrence. Ids are the first id plus the line's."""
    tags = rule_tags(F.col("word_count"))
    made = ingested.where("outcome = 'created'").withColumn("tags", tags)
    return made.select((F.col("line_id") + first_id).alias("node_id"), F.col("line_id").alias("subtitle_id"), F.col("text").alias("en_text"), "show_name", "episode", "start_time", node_code(F.col("show_name"), F.col("episode"), F.col("start_time")).alias("code"), "word_count", F.lit(1).alias("occurrence_count"), "quality_score", "tags.*")


def batch_summary(ingested: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return ingested.agg(count("created"), count("merged"), count("repeated"), F.count_if(F.col("outcome").isNull()).alias("skipped"))


def promote(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines with those of the ids promoted, whatever their status was."""
    marked = ids.select("line_id").distinct().withColumn("hit__", F.lit(True))
    return lines.join(marked, "line_id", "left").withColumn("filter_status", F.when(F.col("hit__"), "promoted").otherwise(F.col("filter_status"))).drop("hit__")


#: So many pairs (16 MB) are settled by one task.
FEW_PAIRS = 1_000_000


def first_in_order(pairs: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """Of lines taken in order those that are not the first of their kind: line_id, merged_into. pairs: earlier, line_id (earlier < line_id), each once.

    A line is created unless an earlier one that it is paired with was created; it is merged into the first of these. Per round, lines without
    undecided earlier partners are created and take their later partners out; when `few` pairs or less are undecided, one task follows them.
    """

    def follow(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for part in [pd.concat(parts)] if (parts := list(rows)) else []:
            gone: set[int] = set()
            for line, earlier in part.sort_values("line_id").groupby("line_id", sort=True)["earlier"]:
                if any(e not in gone for e in earlier):
                    gone.add(line)
            yield pd.DataFrame({"line_id": list(gone)}, dtype="int64")

    pairs = stored(pairs.select("earlier", "line_id"), "pairs")
    as_earlier = lambda t: t.withColumnRenamed("line_id", "earlier")
    left, gone = pairs, pairs.select("line_id").limit(0)
    while left.count() > few:
        first = stored(left.select(F.col("earlier").alias("line_id")).distinct().join(left.select("line_id").distinct(), "line_id", "left_anti"), "first")
        out = stored(left.join(as_earlier(first), "earlier", "left_semi").select("line_id").distinct(), "out")
        decided = first.union(out)
        rest = stored(left.join(decided, "line_id", "left_anti").join(as_earlier(decided), "earlier", "left_anti").select("earlier", "line_id"), "undecided")
        forget(first, *([left] if left is not pairs else []))
        left, gone = rest, gone.union(out)
    gone = stored(gone.union(left.repartition(1).mapInPandas(follow, "line_id long")), "gone")
    return pairs.join(as_earlier(gone), "earlier", "left_anti").groupBy("line_id").agg(F.min("earlier").alias("merged_into"))


def promote_in_order(lines: DataFrame, nodes: DataFrame, params: Params = DEFAULT, few: int = FEW_PAIRS) -> DataFrame:
    """line_id, node_id, merged_into, outcome: the lines of a batch are taken in order, and each one that is created counts for those after it.

    A line like a node merges into it. Another one merges into the first earlier line of its batch that is like it and was itself created. Lines that read
    alike are followed as one, the first of them, as they have the same partners. lines: batch, line_id, text; lines without text are all created.
    """
    into = stored(edit_duplicates(lines, nodes, params), "into")
    rest = lines.join(into, "line_id", "left_anti").select("batch", "line_id", for_duplicates(F.col("text")).alias("x"))
    rest = stored(rest.where("x IS NOT NULL"), "rest")
    alike = stored(rest.groupBy("batch", "x").agg(F.min("line_id").alias("first_id")), "alike")
    pairs = near_each_other(alike.select("batch", F.col("first_id").alias("id"), F.col("x").alias("text")), ["batch"], params)
    settled = first_in_order(pairs.where("y_id < x_id").select(F.col("y_id").alias("earlier"), F.col("x_id").alias("line_id")), few)
    kind = alike.join(settled, F.col("first_id") == F.col("line_id"), "left").select("batch", "x", "first_id", F.coalesce("merged_into", "first_id").alias("kind"))
    inside = rest.join(kind, ["batch", "x"]).select("line_id", F.when(F.col("kind") != F.col("line_id"), F.col("kind")).alias("merged_into"))
    outcome = F.when(F.col("node_id").isNotNull(), "merged").when(F.col("merged_into").isNotNull(), "repeated").otherwise("created")
    return lines.select("line_id").join(into, "line_id", "left").join(inside, "line_id", "left").withColumn("outcome", outcome)


def update_nodes(nodes: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nodes with the values set where the id is on the list; a Chinese text that is set clears needs_translation."""
    marked = ids.select("node_id").distinct().withColumn("hit__", F.lit(True))
    out = nodes.join(marked, "node_id", "left").withColumn("hit__", F.coalesce("hit__", F.lit(False)))
    changed = {k: F.when(F.col("hit__"), v).otherwise(F.col(k)) for k, v in values.items()}
    if "zh_text" in values and "needs_translation" in nodes.columns:
        changed["needs_translation"] = F.when(F.col("hit__") & (F.coalesce(values["zh_text"], F.lit("")) != ""), F.lit(False)).otherwise(F.col("needs_translation"))
    return out.withColumns(changed).drop("hit__")


def delete_nodes(nodes: DataFrame, sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and sources without those of the ids."""
    gone = ids.select("node_id").distinct()
    return nodes.join(gone, "node_id", "left_anti"), sources.join(gone, "node_id", "left_anti")


def retag(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes with the tags of a table where it has them. tags: node_id and any of the tag columns."""
    names = [c for c in tags.columns if c != "node_id"]
    joined = nodes.join(tags.select("node_id", *[F.col(c).alias(f"{c}__") for c in names]), "node_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"{c}__"), F.col(c)) for c in names}).drop(*[f"{c}__" for c in names])


def fill_codes(nodes: DataFrame) -> DataFrame:
    """Nodes with a code where they had none; a code that is taken gets the id behind it."""
    made = F.coalesce(F.col("code"), node_code(F.col("show_name"), F.col("episode"), F.col("start_time")))
    old_first = F.when(F.col("code").isNotNull(), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("made__").orderBy("old__", "node_id"))
    rows = nodes.withColumn("made__", made).withColumn("old__", old_first).withColumn("place__", place)
    return rows.withColumn("code", F.when((F.col("place__") > 1) & (F.col("old__") == 1), F.concat_ws("-", "made__", F.col("node_id").cast("string"))).otherwise(F.col("made__"))).drop("made__", "old__", "place__")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where both have a key the new row's values hold, and old ones where the new ones are null."""
    names = [c for c in table.columns if c not in keys]
    old = table.select(*keys, *[F.col(c).alias(f"{c}__") for c in names])
    return new.join(old, keys, "full").select(*keys, *[F.coalesce(F.col(c), F.col(f"{c}__")).alias(c) if c in new.columns else F.col(f"{c}__").alias(c) for c in names])


def delete_clips(clips: DataFrame, nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips without those of the ids, and nodes with has_any_clip as it then is."""
    left = clips.join(ids.select("clip_id").distinct(), "clip_id", "left_anti")
    return left, flag_clips(nodes, left)


def flag_clips(nodes: DataFrame, clips: DataFrame) -> DataFrame:
    """Nodes with has_any_clip: whether any clip, active or not, is theirs."""
    have = clips.select("node_id").where("node_id IS NOT NULL").distinct().withColumn("hit__", F.lit(True))
    return nodes.drop("has_any_clip").join(have, "node_id", "left").withColumn("has_any_clip", F.coalesce("hit__", F.lit(False))).drop("hit__")


def migrate_status(clips: DataFrame) -> DataFrame:
    """Clips with the three statuses of now; only matched ones are active."""
    old = F.col("clip_status")
    status = F.when(old.isin("done", "confirmed"), "matched").when(old.isin("skipped", "pending", "rejected"), "unmatched").otherwise(old)
    active = F.when(old.isin("done", "confirmed"), F.lit(True)).when(status.isin("unmatched", "failed"), F.lit(False)).otherwise(F.col("is_active"))
    return clips.withColumn("is_active", active).withColumn("clip_status", status)


def add_missing(table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The table with the columns that it lacks at their defaults."""
    return table.withColumns({k: v for k, v in defaults.items() if k not in table.columns})


def merge_adjacent(nodes: DataFrame, gap: float, params: Params = DEFAULT) -> DataFrame:
    """Neighbouring nodes of an episode that make one sentence, merged into the first; the others go. Vectors decide where the words do not."""
    given = nodes.withColumn("zh_text", F.coalesce("zh_text", F.lit("")))
    return merge_lines(given, ["show_name", "episode"], ["node_id"], params, gap, vectors="embedding" in nodes.columns)


def sync_episode(lines: DataFrame, nodes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """What becomes of the passed lines of an episode that no node came from: line_id, outcome ('merged' or 'created'), node_id, created_by.

    A line that an active node has, or that has exactly the text of any node, is merged into it. Of other lines of one exact text the first creates
    a node, and the rest are merged into that one: created_by is the line that made it. Lines that are merely near to each other all create nodes.
    """
    nodes = kept(nodes)
    open_ = kept(unsynced(lines, nodes))
    found = kept(open_.join(_known_to(open_, nodes, params), "line_id", "left").select("line_id", "text", "node_id"))
    exact = nodes.groupBy("text").agg(F.min("node_id").alias("exact_id"))
    fresh = found.where("node_id IS NULL").drop("node_id").join(exact, "text", "left")
    firsts = fresh.where("exact_id IS NULL").groupBy("text").agg(F.min("line_id").alias("created_by"))
    fresh = fresh.join(firsts, "text", "left").select("line_id", F.when(F.col("line_id") == F.col("created_by"), "created").otherwise("merged").alias("outcome"), F.col("exact_id").alias("node_id"), "created_by")
    merged = found.where("node_id IS NOT NULL").select("line_id", F.lit("merged").alias("outcome"), "node_id", F.lit(None).cast("long").alias("created_by"))
    return merged.unionByName(fresh)


def synced_nodes(lines: DataFrame, synced: DataFrame, first_id: int = 1) -> DataFrame:
    """Nodes of lines that sync created, with rule tags and as many occurrences as lines were merged into them."""
    more = synced.where("created_by IS NOT NULL").groupBy(F.col("created_by").alias("line_id")).agg(F.count(F.lit(1)).alias("occurrences"))
    made = lines.join(more, "line_id").withColumn("outcome", F.lit("created"))
    return created_nodes(made, first_id).join(more.select(F.col("line_id").alias("subtitle_id"), "occurrences"), "subtitle_id").withColumn("occurrence_count", F.col("occurrences")).drop("occurrences")
