"""Session factory and table registration."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for every session the engine makes. Sizes of partitions are left to AQE and to the
#: cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def create_session(app: str = "shardloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments with dots written as ``__`` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_shardloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shardloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._shardloom_shipped = True


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register_dual(spark: SparkSession) -> None:
    """The one-row table that table-less SELECTs name."""
    spark.range(1).selectExpr("'X' AS dummy").createOrReplaceTempView("dual")


def register_tables(spark: SparkSession, directory: str, names: list[str] | None = None) -> list[str]:
    """Registers each ``*.parquet`` of a directory as a view and returns the names."""
    if names is None:
        path = spark._jvm.org.apache.hadoop.fs.Path(directory)
        listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        found = (os.path.basename(str(x.getPath().getName())) for x in listed)
        names = sorted(x.removesuffix(".parquet") for x in found if x.endswith(".parquet"))
    for name in names:
        read_table(spark, directory, name).createOrReplaceTempView(name)
    register_dual(spark)
    return names
