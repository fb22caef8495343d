"""A vector index on disk: versions of a table, of which readers see the last whole one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_version(spark: SparkSession, path: str) -> int:
    """The last version that was written whole; 0 if there is none."""
    try:
        return spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def save_index(nodes: DataFrame, path: str) -> int:
    """Write the next version of the index and return its number. nodes: node_id, embedding.

    The version is named only once its rows are there: until then, and if the job fails, readers get the one before. One writer at a time.
    """
    version = last_version(nodes.sparkSession, path) + 1
    nodes.where("embedding IS NOT NULL").select("node_id", "embedding").write.mode("overwrite").parquet(f"{path}/version-{version}")
    nodes.sparkSession.range(version, version + 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{path}/versions")
    return version


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """node_id and embedding of the last whole version."""
    version = last_version(spark, path)
    if not version:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.parquet(f"{path}/version-{version}")
