"""The observed calendar: sessions are the days on which a market has bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.dates import last_final_session, run_is_due
from tidemark.params import Params


def by_market() -> WindowSpec:
    return Window.partitionBy("market").orderBy("session")


def sessions(rows: DataFrame) -> DataFrame:
    """market, session, n: the distinct sessions of any dated table, numbered from 1 in each market.

    Only these few rows are windowed by market; the table's own rows are reduced by aggregation first.
    """
    return rows.select("market", "session").distinct().withColumn("n", F.row_number().over(by_market()))


def session_before(rows: DataFrame, back: int = 1) -> DataFrame:
    """market, session, before: for each session with rows, the one that is that many such sessions earlier."""
    return rows.select("market", "session").distinct().withColumn("before", F.lag("session", back).over(by_market()))


def last_session(bars: DataFrame) -> DataFrame:
    return bars.groupBy("market", "symbol").agg(F.max("session").alias("last_session"))


def due(markets: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    """markets (market, latest) with last_final and run_due."""
    m = F.col("market")
    return markets.withColumn("last_final", last_final_session(m, now, params)).withColumn("run_due", run_is_due(F.col("latest"), m, now, params))


def to_backfill(runs: DataFrame, calendar: DataFrame, targets: DataFrame) -> DataFrame:
    """market, session: what a run for each target (market, target) must compute.

    Sessions after the latest published one and up to the target, and the target itself, bar or not, less
    those that have a run record; only the target where nothing has been published yet.
    """
    latest = runs.filter("status = 'published'").groupBy("market").agg(F.max("session").alias("latest"))
    gaps = calendar.select("market", "session").distinct().join(F.broadcast(targets), "market").join(F.broadcast(latest), "market")
    gaps = gaps.filter((F.col("session") > F.col("latest")) & (F.col("session") <= F.col("target"))).select("market", "session")
    wanted = gaps.union(targets.select("market", F.col("target").alias("session"))).distinct()
    return wanted.join(runs.select("market", "session"), ["market", "session"], "left_anti")
