"""A vector index that grows by segments: added rows and retired ids are appended, and dead rows go when they are too many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.sources import snapshots as S

#: A row is dead once its id was retired at a later version than it came with.
VECTORS, GONE = "vectors", "gone"


def _rows(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """All rows of the segments, with gone_at: the last version that retired their id, null if none did."""
    gone = S.read_table(spark, path, GONE, version).groupBy("node_id").agg(F.max("version").alias("gone_at"))
    return S.read_table(spark, path, VECTORS, version).join(gone, "node_id", "left")


def indexed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """node_id and embedding of the rows that are not dead."""
    return _rows(spark, path, version).where("gone_at IS NULL OR gone_at <= version").select("node_id", "embedding")


def _stamped(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("version", F.lit(version).cast("long"))


def create_index(nodes: DataFrame, path: str) -> int:
    """The first version of an index. nodes: node_id, each once, and embedding; rows without one are left out."""
    rows = _stamped(nodes.where("embedding IS NOT NULL").select("node_id", "embedding"), 1)
    return S.commit(nodes.sparkSession, path, {VECTORS: rows, GONE: rows.select("node_id", "version").where(F.lit(False))}, 0)


def add_vectors(nodes: DataFrame, path: str) -> int:
    """Append vectors; those of ids that are there take the place of the old ones. nodes: node_id, each once, and embedding."""
    spark, version = nodes.sparkSession, S.last_version(nodes.sparkSession, path)
    rows = _stamped(nodes.where("embedding IS NOT NULL").select("node_id", "embedding"), version + 1)
    known = rows.select("node_id", "version").join(indexed(spark, path, version).select("node_id"), "node_id", "left_semi")
    return S.commit(spark, path, {}, version, {VECTORS: rows, GONE: known})


def retire(ids: DataFrame, path: str) -> int:
    """Retire the ids of a table (node_id); ids that are not there do no harm."""
    spark, version = ids.sparkSession, S.last_version(ids.sparkSession, path)
    return S.commit(spark, path, {}, version, {GONE: _stamped(ids.select("node_id").where("node_id IS NOT NULL").distinct(), version + 1)})


def dead_share(spark: SparkSession, path: str, version: int | None = None) -> float:
    """The share of the segments' rows that are dead; 0 without rows. No vector is read."""
    dead, total = _rows(spark, path, version).agg(F.count_if(F.col("gone_at") > F.col("version")), F.count(F.lit(1))).first()
    return dead / total if total else 0.0


def compact(spark: SparkSession, path: str) -> int:
    """One segment of the rows that are not dead, and no retired ids."""
    version = S.last_version(spark, path)
    rows = _stamped(indexed(spark, path, version), version + 1)
    return S.commit(spark, path, {VECTORS: rows, GONE: rows.select("node_id", "version").where(F.lit(False))}, version)


def sync_index(nodes: DataFrame, path: str, share: float = 0.05, full: bool = False) -> int:
    """Bring an index in line with nodes: active ones with a vector that it lacks are added, others that it has are retired; returns the version.

    All is written anew if it is asked for, or if there is no index yet; and one segment is made of several when more than `share` of their rows would be
    dead. A node whose vector has changed counts as known: add_vectors takes the new one. nodes: node_id, embedding, is_active.
    """
    spark, version = nodes.sparkSession, S.last_version(nodes.sparkSession, path)
    active = nodes.where("is_active AND embedding IS NOT NULL").select("node_id", "embedding")
    if version == 0:
        return create_index(active, path)
    if full:
        rows = _stamped(active, version + 1)
        return S.commit(spark, path, {VECTORS: rows, GONE: rows.select("node_id", "version").where(F.lit(False))}, version)
    live = indexed(spark, path, version).select("node_id")
    missing = _stamped(active.join(live, "node_id", "left_anti"), version + 1)
    over = _stamped(live.join(active.select("node_id"), "node_id", "left_anti"), version + 1)
    version = S.commit(spark, path, {}, version, {VECTORS: missing, GONE: over})
    return compact(spark, path) if dead_share(spark, path, version) > share else version
