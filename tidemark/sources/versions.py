"""A keyed table as versions: a base and later changes, merged when they are read.

A version is a small numbered file that names the folders of rows that make it up, oldest first. A writer adds
a folder and then the next version; if another writer was faster, it goes by that one's version and tries
again, so no change is lost, and a writer that dies leaves the last version as it was. After ``DELTAS``
changes the merged rows become the base of the next version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files

DELTAS = 8  #: changes that are merged at every reading, at most
TRIES = 20


def last(spark: SparkSession, where: str) -> tuple[int, list[str]]:
    """The number of the last version and its folders."""
    found = sorted(files.listed(spark, f"{where}/versions/*.json"))
    if not found:
        return 0, []
    return int(found[-1].rsplit("/", 1)[1].removesuffix(".json")), json.loads(spark.read.text(found[-1]).first()[0])


def merged(spark: SparkSession, where: str, folders: list[str], schema: StructType, key: tuple[str, ...]) -> DataFrame:
    """For each key, the last value of each column that isn't null."""
    if not folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{where}/data/{f}").withColumn("_v", F.lit(i)) for i, f in enumerate(folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(folders) == 1:
        return rows.select(*schema.names)
    rest = [c for c in schema.names if c not in key]
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in rest]).select(*schema.names)


def read(spark: SparkSession, where: str, schema: StructType, key: tuple[str, ...]) -> DataFrame:
    return merged(spark, where, last(spark, where)[1], schema, key)


def upsert(spark: SparkSession, where: str, rows: DataFrame, schema: StructType, key: tuple[str, ...]) -> None:
    """Adds rows (one for each key); a null keeps the value that is there."""
    change = uuid.uuid4().hex
    rows.select(*schema.names).write.parquet(f"{where}/data/{change}")
    for _ in range(TRIES):
        n, folders = last(spark, where)
        try:
            files.create(spark, f"{where}/versions/{n + 1:08d}.json", json.dumps([*folders, change]))
            break
        except FileExistsError:
            continue
    else:
        raise RuntimeError(f"{where}: other writers were faster {TRIES} times")
    if len(folders) >= DELTAS:
        compact(spark, where, schema, key)


def compact(spark: SparkSession, where: str, schema: StructType, key: tuple[str, ...]) -> bool:
    """Makes the merged rows the base of the next version; tells whether that stood, or another writer was faster."""
    n, folders = last(spark, where)
    base = uuid.uuid4().hex
    merged(spark, where, folders, schema, key).write.parquet(f"{where}/data/{base}")
    try:
        files.create(spark, f"{where}/versions/{n + 1:08d}.json", json.dumps([base]))
    except FileExistsError:
        return False
    return True
