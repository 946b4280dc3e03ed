"""Relations that are written once to the folder that the cluster shares, and read by all that follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session that runs in one process, as in tests, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def compiled_by_parts(spark: SparkSession) -> None:
    """Has a session's projections compiled as many small methods where one for a whole stage would be larger than the JVM compiles: it would interpret that one, which takes several times as long."""
    if spark.conf.get(LIMIT) == "65535":
        spark.conf.set(LIMIT, "8000")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by hash of the keys over as many tasks as the session has cores: for a small file's rows that each become many."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: computed once, pruned by column at every use."""
    where = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
