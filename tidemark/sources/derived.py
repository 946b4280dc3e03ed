"""Bars and their companions, derived from the order tables.

Symbol: supplier; session: ISO week; the close walks on discounts, the range comes from taxes, the volume
from quantities. Everything else (labels, index bars, instruments, fetch outcomes, runs) follows from these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import INDEXES
from tidemark.sources.shared import dealt, stored

MARKET = "CASE WHEN k % 2 = 0 THEN 'US' ELSE 'IDX' END"
SYMBOL = "concat('S', lpad(CAST(k AS STRING), 5, '0'))"
WEEK = "CAST(datediff(session, DATE '1995-01-02') div 7 AS BIGINT)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as delivered, phantom bars (without volume) included."""
    lines = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS k", "CAST(date_trunc('week', l_shipdate) AS DATE) AS session", "CAST(round(l_discount * 100) AS INT) - 5 AS d",
        "CAST(round(l_tax * 100) AS INT) AS t", "CAST(l_quantity AS BIGINT) AS q",
    )
    weeks = lines.groupBy("k", "session").agg(F.sum("d").alias("d"), F.max("t").alias("t"), F.sum("q").alias("vol"))
    walk = weeks.selectExpr("*", f"(k * 7 + {WEEK}) % 23 AS ph", "sum(d) OVER (PARTITION BY k ORDER BY session) AS c").withColumn("p", F.col("c") - F.col("d"))
    # Each exponential and the close are computed once a row. exp never falls, so the greater of two is that of the greater.
    walk = walk.selectExpr("*", "100D * exp(p / 100D) AS a", "100D * exp(c / 100D) AS b").withColumn("close", F.round("b", 4))
    return walk.selectExpr(
        f"{MARKET} AS market", f"{SYMBOL} AS symbol", "session",
        "round(a, 4) AS open",
        "round(greatest(a, b) * (1 + t / 200D), 4) AS high",
        "round(least(a, b) / (1 + t / 200D), 4) AS low",
        "close",
        "CASE WHEN k % 7 = 0 AND session < DATE '1998-01-05' THEN round(b * 0.5D, 4) ELSE close END AS adj_close",
        "CAST(CASE WHEN ph = 0 THEN 0 ELSE vol END AS BIGINT) AS volume",
    )


def index_bars(bars: DataFrame) -> DataFrame:
    """One reference bar per market and session, at the average close."""
    name = F.when(F.col("market") == "US", INDEXES["US"]).otherwise(INDEXES["IDX"])
    # In whole ten-thousandths, so that halves round up exactly.
    level = bars.groupBy("market", "session").agg(F.sum(F.round(F.col("close") * 10000).cast("long")).alias("s"), F.count("*").alias("n"))
    level = level.select("market", "session", F.expr("((2 * s + n) div (2 * n)) / 10000D").alias("c"))
    return level.select("market", name.alias("symbol"), "session", *[F.col("c").alias(x) for x in ("open", "high", "low", "close", "adj_close")], F.lit(1).cast("long").alias("volume"))


def traded_and_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Traded bars of all instruments, and those of the indexes, one on every session. Stored, as the indexes are read from the others: the order tables are read once."""
    traded = stored(raw_bars(spark, sf_dir).filter("volume > 0"), "bars")
    return traded, stored(index_bars(traded), "index_bars")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded bars of all instruments, the indexes included."""
    return DataFrame.unionByName(*traded_and_index(spark, sf_dir))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "CASE k % 11 WHEN 5 THEN 'Acme Warrant' WHEN 6 THEN 'Beta American Depositary Shares' ELSE 'Corp - Common Stock' END AS name"
    own = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k").selectExpr(f"{MARKET} AS market", f"{SYMBOL} AS symbol", "'candidate' AS role", names)
    refs = spark.createDataFrame([(m, s, "reference", "") for m, s in INDEXES.items()], "market string, symbol string, role string, name string")
    return own.unionByName(refs)


def resolutions(spark: SparkSession, sf_dir: str, traded: DataFrame) -> DataFrame:
    """market, symbol, session, status: the fetch outcome of every candidate on every session of its market."""
    days = traded.select("market", "session").distinct()
    own = _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k").selectExpr("k", f"{MARKET} AS market", f"{SYMBOL} AS symbol")
    own = dealt(own, "market", "symbol")
    status = f"CASE WHEN k % 50 = 49 THEN 'refused' WHEN (k * 31 + {WEEK}) % 17 = 0 THEN 'unresolved' ELSE 'resolved' END"
    return own.join(F.broadcast(days), "market").selectExpr("market", "symbol", "session", f"{status} AS status")


def labels(spark: SparkSession, sf_dir: str, traded: DataFrame) -> DataFrame:
    """market, symbol, sector, industry, as_of: region and nation of the supplier."""
    last = traded.groupBy("market").agg(F.max("session").alias("last"))
    s, n, r = (_read(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    own = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).withColumnRenamed("s_suppkey", "k").filter("k % 20 <> 3")
    own = own.selectExpr("k", f"{MARKET} AS market", f"{SYMBOL} AS symbol", "r_name AS sector", "n_name AS industry")
    return own.join(F.broadcast(last), "market").selectExpr("market", "symbol", "sector", "industry", "date_sub(last, CAST(k % 30 AS INT)) AS as_of")


def runs(spark: SparkSession, sf_dir: str, traded: DataFrame) -> DataFrame:
    """One run per market and session; every thirteenth week is quarantined."""
    counts = resolutions(spark, sf_dir, traded).groupBy("market", "session").agg(F.count_if(F.col("status") != "refused").cast("int").alias("symbols_enumerated"), F.count_if(F.col("status") == "resolved").cast("int").alias("symbols_resolved"))
    return counts.selectExpr("market", "session", f"CASE WHEN {WEEK} % 13 = 0 THEN 'quarantined' ELSE 'published' END AS status", "symbols_enumerated", "symbols_resolved", "CAST(date_add(session, 1) AS TIMESTAMP) AS created_at")
