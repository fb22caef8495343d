"""Python workers and this package, and what passes from step to step in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver has it on its path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Folders that this driver has made, with what removes each.
_MADE: dict[str, tuple] = {}
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a URI, in that of spark.checkpoint.dir, which the driver and all executors see; it goes when the driver ends.

    With a local master, whose executors are this machine, a folder of it will do; anywhere else one must be named.
    """
    let_workers_import(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    if not _MADE:
        atexit.register(lambda: [_remove(x) for x in list(_MADE)])
    _MADE[uri] = (path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return uri


def _remove(uri: str) -> None:
    store, path = _MADE.pop(uri)
    try:
        store.delete(path, True)
    except Exception as e:  # the JVM or the store may be gone by now
        print(f"left behind: {uri} ({type(e).__name__})")


def stored(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write a table to the shared folder and read it again: it is computed once, and what follows does not depend on executors that may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        if (uri := _FOLDERS.pop(df, None)) in _MADE:
            _remove(uri)


kept = stored
