"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame operations only.

The corpus has as many blocks of `block` words as its words fill. They go to the sources by highest quotients target / (2k - 1),
k = 1, 2, ..; then each source's blocks go to its shards in the same way, by the words of a shard. Quotas are integers. In a shard
the documents lie in an order that a seed fixes, end to end, and are cut into blocks. Whole passes over the shard are taken first;
the rest of its quota are the blocks that come first by a seeded hash of source, shard and block, and the beginning of the next one,
so that a shard gives exactly its quota. A document's words in the picked blocks are what is taken.

Seats need no seat-by-seat loop: with V votes, n parties and B seats, the divisor V / (B - n / 2) gives at most B seats
and V / (B + n / 2) at least B; only the seats between are ranked by quotient, fewer than 2n + 1 in all.

A source is split into shards of about `shard_words` words, so a hot source is many groups; per-source tables are the
only ones that a single task ranks. Texts are read once: their sizes are stored.

Defined cases: null text has size 0 and takes 0; the null source is a source and comes last by order; rows without an id are dealt by
their text; a source without words has target 0; with no words at all every target is 0; repeated rows are rows of their own; other
columns are not touched, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.shared import WORD, partitions_for, stored

CAP = 3  # times that a word may be taken
UNIT = 1 << 20  # parts of a copy, in which shares are added up without rounding


def seeded(seed: int, *columns: Column | str) -> Column:
    """48 bits of a hash that other SQL engines have as well; null columns are left out."""
    given = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in given]).cast("binary")), 1, 12), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """source, source_size, target. sizes: source and size of each document.

    Targets share the sum of all sizes by weight. A target stops at CAP times its source's size; what is left goes to the
    others by weight until none is above. That is min(cap, level * weight) for one level: in the order of cap / weight,
    the sources before some place are at their cap and the others share the rest.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    by = by.withColumn("before_cap", F.sum("cap").over(full) - F.col("cap")).withColumn("rest_weight", F.sum("weight").over(everything) - F.sum("weight").over(full) + F.col("weight"))
    by = by.withColumn("level", (F.sum("source_size").over(everything) - F.col("before_cap")) / F.col("rest_weight"))
    # levels rise up to the first source whose cap is not reached and fall after it: that one's holds for it and all that follow
    by = by.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    return by.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague seats (column quota) of each party within its group, where every row of a group has its seats."""
    w = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(w), F.sum(F.col(votes).cast("double")).over(w)
    p = parties.withColumn("n_", n).withColumn("v_", F.col(votes).cast("double")).withColumn("all_", total)
    share = F.when(F.col("all_") > 0, F.col("v_") / F.col("all_")).otherwise(0.0)
    low = F.greatest(F.lit(0.0), F.ceil(share * F.greatest(F.lit(0.0), F.col(seats) - F.col("n_") / 2) - 0.5) - 1)
    high = F.when(F.col("v_") > 0, F.floor(share * (F.col(seats) + F.col("n_") / 2) + 0.5) + 1).otherwise(0.0)
    p = p.withColumn("low_", low.cast("long")).withColumn("high_", high.cast("long"))
    p = p.withColumn("base_", F.sum("low_").over(w))
    open_seats = p.where("high_ > low_").select(*group, *party, seats, "v_", "base_", F.explode(F.sequence(F.col("low_") + 1, F.col("high_"))).alias("k_"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("v_") / (2 * F.col("k_") - 1)).desc(), "k_", *[F.col(c).asc_nulls_last() for c in party]))
    won = open_seats.withColumn("rank_", rank).where(F.col("rank_") <= F.col(seats) - F.col("base_")).groupBy(*group, *party).agg(F.count(F.lit(1)).alias("won_"))
    keys = [*group, *party]
    won = won.select(*[F.col(c).alias(f"{c}_w") for c in keys], "won_")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_w")) for c in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return p.join(won, on, "left").select(*parties.columns, (F.col("low_") + F.coalesce("won_", F.lit(0))).alias("quota"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and size of each document, and the name by which it is dealt: its id, or else a digest of its text."""
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(text.cast("binary")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), name.alias("name"), *more)


def source_plan(sizes: DataFrame, weights: tuple[float, ...], block: int, shard_words: int) -> DataFrame:
    """Of each source (column source_p): its size, target, number of shards, and its quota of blocks."""
    targets = source_targets(sizes, weights)
    blocks = F.ceil(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / max(shard_words, 64 * block))).cast("long")
    plan = apportion(targets.withColumn("blocks", blocks).withColumn("shards", shards), [], ["source"], "target", "blocks")
    return plan.withColumnRenamed("quota", "source_quota").withColumnRenamed("source", "source_p").drop("blocks")


def _dealt(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The rows with their source's plan and their shard; shard_key names source and shard and is never null."""
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("source_p"))).withColumn("shard", seeded(seed, "name") % F.col("shards"))
    return dealt.withColumn("shard_key", F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit("/"), F.col("shard").cast("string"))).drop("source_p", "shards")


def shard_takes(dealt: DataFrame, seed: int, block: int) -> DataFrame:
    """Of each shard_key: whole passes, and how many words are taken from the beginning of each block beyond them.

    The last block, which is not full, comes last; the others come by their hashes.
    """
    shards = dealt.groupBy("source", "shard", "shard_key").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    q = apportion(shards, ["source"], ["shard"], "shard_size", "source_quota").withColumn("want", F.least(F.col("quota") * block, CAP * F.col("shard_size")))
    q = q.withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("want div shard_size")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("want") - F.col("passes") * F.col("shard_size"))
    q = q.withColumn("picked", F.expr(f"rest div {block}L")).withColumn("part", F.col("rest") % block).withColumn("n_whole", F.expr(f"shard_size div {block}L"))
    numbers = F.when(F.col("n_whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_whole") - 1)).otherwise(F.array().cast("array<long>"))
    q = q.withColumn("ranked", F.transform(numbers, lambda b: F.struct(seeded(seed + 2, "source", "shard", b).alias("hash"), b.alias("b"))))
    q = q.withColumn("edge", F.get(F.array_sort("ranked"), F.col("picked").cast("int")))
    whole = F.transform("ranked", lambda r: F.when(F.col("edge").isNull() | (r < F.col("edge")), F.lit(block).cast("long")).when(r == F.col("edge"), F.col("part")).otherwise(F.lit(0).cast("long")))
    tail = F.when(F.col("picked") >= F.col("n_whole"), F.col("part")).otherwise(F.lit(0).cast("long"))
    return q.select("shard_key", "passes", F.concat(whole, F.array(tail)).alias("takes"))


def _taken(dealt: DataFrame, takes: DataFrame, seed: int, block: int) -> DataFrame:
    """The rows with `taken`, and still in the order of their shard."""
    at = F.sum("size").over(_order(seed).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.join(takes, "shard_key").withColumn("at", at)
    inside = f"greatest(0L, least(at + size, b * {block}L + get(takes, cast(b AS int))) - greatest(at, b * {block}L))"
    beyond = f"aggregate(CASE WHEN size > 0 THEN sequence(at div {block}L, (at + size - 1) div {block}L) ELSE array() END, 0L, (s, b) -> s + {inside})"
    return placed.withColumn("taken", F.col("passes") * F.col("size") + F.expr(beyond))


def _order(seed: int):
    return Window.partitionBy("shard_key").orderBy(seeded(seed + 1, "name"), "name", "size")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 7, block: int = 256, shard_words: int = 1 << 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document; see the module's text.

    block: words of a block. shard_words: words of a shard, about; at least 64 blocks.
    """
    sizes = stored(_sized(docs), "sizes")
    dealt = _dealt(sizes, stored(source_plan(sizes, weights, block, shard_words), "source-plan"), seed)
    return _taken(dealt, shard_takes(dealt, seed, block), seed, block).select("doc_id", "size", "source_size", "target", "taken")


def repeat_by_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 7, block: int = 256, shard_words: int = 1 << 17) -> DataFrame:
    """The rows, whole, as often as the mix takes them.

    Most documents lie in blocks that are taken or in others, and stay or go with them. Shares of a document are rounded along the seeded
    order of its shard: one more copy comes each time that the sum of shares passes the next whole number, so that the copies of a
    shard are its shares to within one. Words then differ from the quota by what the rounded documents are longer or shorter.
    """
    sizes = stored(_sized(docs), "sizes")
    # stored, these tables have a known size: Spark sends the small ones around, and texts move once, to their shards
    plan = stored(source_plan(sizes, weights, block, shard_words), "source-plan")
    takes = stored(shard_takes(_dealt(sizes, plan, seed), seed, block), "shard-takes")
    rows = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    share = F.when(F.col("size") > 0, F.expr(f"taken * {UNIT}L div size")).otherwise(F.lit(0).cast("long"))
    dealt = _dealt(rows, plan, seed).repartition(partitions_for(docs), "shard_key")
    shared = _taken(dealt, takes, seed, block).withColumn("share", share)
    upto = F.sum("share").over(_order(seed).rowsBetween(Window.unboundedPreceding, 0)) + seeded(seed + 3, "shard_key") % UNIT
    copies = shared.withColumn("upto", upto).withColumn("copies", F.expr(f"(upto div {UNIT}L) - ((upto - share) div {UNIT}L)")).where("copies > 0")
    return copies.select("document", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("document.*")
