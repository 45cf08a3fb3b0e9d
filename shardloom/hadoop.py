"""Small files on the file systems Spark knows."""

from __future__ import annotations

import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: One process puts one file at a time; between processes the file system's rename decides.
_LOCK = threading.Lock()


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def system_of(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def statuses(spark: SparkSession, folder: str) -> list:
    """What is in a folder; nothing if it does not exist."""
    try:
        return list(system_of(spark, folder).listStatus(path_of(spark, folder)))
    except Py4JJavaError as problem:
        if "FileNotFoundException" in str(problem.java_exception.getClass()):
            return []
        raise


def names(spark: SparkSession, folder: str) -> list[str]:
    return [f.getPath().getName() for f in statuses(spark, folder)]


def read_text(spark: SparkSession, path: str) -> str:
    stream = system_of(spark, path).open(path_of(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file that appears whole or not at all, unless there is one of the name; whether it did."""
    fs, jvm = system_of(spark, path), spark._jvm
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    out = fs.create(path_of(spark, draft), True)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path_of(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    with _LOCK:
        try:
            context.rename(path_of(spark, draft), path_of(spark, path), no_options)
        except Py4JJavaError as problem:
            fs.delete(path_of(spark, draft), False)
            if "FileAlreadyExistsException" in str(problem.java_exception.getClass()):
                return False
            raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    system_of(spark, path).delete(path_of(spark, path), True)
