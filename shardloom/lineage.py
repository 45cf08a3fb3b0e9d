"""Intermediate results that outlive the executors that made them."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .hadoop import path_of, remove, system_of

__all__ = ["cut", "release", "remove", "scratch", "scratch_path", "shared_folder"]

_BLOCKS = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent, a local folder is made and set if Spark runs on this machine alone (tests, a laptop);
    a cluster without the setting is refused, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share; it is not set")
        folder = "file://" + tempfile.mkdtemp(prefix="shardloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when the application ends."""
    context = spark.sparkContext
    own = getattr(context, "_shardloom_scratch", None)
    if own is None:
        own = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        fs = system_of(spark, own)
        fs.mkdirs(path_of(spark, own))
        fs.deleteOnExit(path_of(spark, own))
        context._shardloom_scratch = own
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted with all others when the application ends, or earlier: see below."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for block in getattr(_BLOCKS, "open", [])[-1:]:
        block.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was written to scratch paths within. No result that is read later may rest on it."""
    blocks = _BLOCKS.__dict__.setdefault("open", [])
    mine: list[str] = []
    blocks.append(mine)
    try:
        yield
    finally:
        blocks.remove(mine)
        for path in mine:
            remove(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes all scratch paths made so far. For long applications, once all results made so far have been read."""
    own = getattr(spark.sparkContext, "_shardloom_scratch", None)
    if own:
        remove(spark, own)
        spark.sparkContext._shardloom_scratch = None


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
