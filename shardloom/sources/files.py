"""Bulk import and export, copies of tables, and streamed results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text")


def load(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Reads files. Text formats want a schema, so that no pass over the data is spent on guessing it."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {', '.join(FORMATS)}")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"a schema is needed to read {fmt}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def store(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", rows_per_file: int | None = None, partition_by: list[str] | None = None, **options: str) -> None:
    """Writes files in parallel, one or more a task, cut at ``rows_per_file``."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt} is none of {', '.join(FORMATS)}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of another database; with a numeric column and its bounds it is read by several tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def fetch(df: DataFrame) -> Iterator[Row]:
    """Rows one after another; the driver holds two partitions at a time, never the whole result."""
    return df.toLocalIterator(prefetchPartitions=True)
