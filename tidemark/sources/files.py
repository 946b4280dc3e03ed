"""Small files and folders on whatever file system a path names, through Spark's own client."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, where: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, where: str) -> bool:
    fs, p = _at(spark, where)
    return fs.exists(p)


def delete(spark: SparkSession, where: str) -> None:
    fs, p = _at(spark, where)
    fs.delete(p, True)


def listed(spark: SparkSession, pattern: str, hours: float = 0) -> list[str]:
    """The paths that match, those that have changed within the last hours left out."""
    fs, p = _at(spark, pattern)
    upto = (time.time() - hours * 3600) * 1000
    return [x.getPath().toString() for x in fs.globStatus(p) or [] if not hours or x.getModificationTime() <= upto]


def create(spark: SparkSession, where: str, text: str) -> None:
    """Creates a file as a whole: written under another name and renamed. Raises FileExistsError if there is one of its name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = where.rpartition("/")
    fs, target = _at(spark, where)
    _, part = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        # Unlike the file system's own rename, this one refuses a name that is taken.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(part, False)
        if fs.exists(target):
            raise FileExistsError(where) from e
        raise
