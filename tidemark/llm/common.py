"""Small helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\v\f\r"
HOT = 500_000  #: oversize buckets up to this many are sent to all tasks; more are joined by a shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can read.

    Only a session that runs in one process, as in tests, may name none: it gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """A checkpointed df, marked to be sent to all tasks if it has so many rows at most; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normal(line: Column) -> Column:
    """A line without the white space around it, lower-cased."""
    return F.lower(F.btrim(line, F.lit(SPACE)))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at these places (from 0), in time that grows with its length alone; where gone is null, as it is."""
    keep = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i))
    bound = F.transform(F.array(lines_of(text)), keep)  # split once, not for each line
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.get(bound, 0), "\n"))


def ranked_by_hash(rows: DataFrame, group: str, digest: str, tie: str, per_bucket: int, total: int) -> DataFrame:
    """rows with place: the place of each in its group, from 0, by a hex digest (32 digits), then by tie (a checksum of 32 bits, nulls first).

    No group is sorted in one task: rows are ranked within buckets of the digest's first digits, of about
    per_bucket rows, and a bucket starts where the ones before it end. A bucket that is far larger holds rows
    of one digest; it is split by the tie's first digits, and where the ties are equal too by a salt, since
    the order of equal rows isn't defined. The buckets' counts are added up in two steps, by the first half
    of the digits and within it.
    """
    digits = min(8, max(1, math.ceil(math.log(max(2, total / per_bucket), 16))))
    half = digits // 2
    o, b, c, n, first = fresh(rows, "_order", "_bucket", "_coarse", "_n", "_first")
    # "-" stands before all digits. The salt is written with the rows, so that every later step sees the same.
    checksum = F.coalesce(F.lpad(F.hex(F.col(tie).cast("long")), 8, "0"), F.lit("-" * 8))
    salt = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    rows = checkpointed(rows.withColumn(o, F.concat(F.col(digest), checksum, salt)).withColumn(b, F.substring(o, 1, digits)))
    for cut in (32 + digits, 40 + digits):
        hot = checkpointed(rows.groupBy(group, b).agg(F.count("*").alias(n)).filter(F.col(n) > 8 * per_bucket))
        if hot.isEmpty():
            break
        rows = rows.join(small(hot, HOT), [group, b], "left").withColumn(b, F.when(F.col(n).isNull(), F.col(b)).otherwise(F.substring(o, 1, cut))).drop(n)
    fine = rows.groupBy(group, b).agg(F.count("*").alias(n)).withColumn(c, F.substring(b, 1, half))
    coarse = fine.groupBy(group, c).agg(F.sum(n).alias(n))
    before = lambda *by: F.sum(n).over(Window.partitionBy(*by).orderBy(c if by == (group,) else b)) - F.col(n)
    coarse = coarse.select(group, c, before(group).alias("_a"))
    fine = fine.select(group, b, c, before(group, c).alias("_b")).join(coarse, [group, c]).select(group, b, (F.col("_a") + F.col("_b")).alias(first))
    own = F.row_number().over(Window.partitionBy(group, b).orderBy(o)) - 1
    return rows.withColumn("place", own).join(fine, [group, b]).withColumn("place", (F.col("place") + F.col(first)).cast("long")).drop(o, b, first)
