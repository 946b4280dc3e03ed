"""Listing files of the two markets, as instruments (market, symbol, role, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.params import INDEXES


def index_rows(spark: SparkSession, market: str) -> DataFrame:
    return spark.range(1).select(F.lit(market).alias("market"), F.lit(INDEXES[market]).alias("symbol"), F.lit("reference").alias("role"), F.lit("").alias("name"))


def us_listing(lines: DataFrame) -> DataFrame:
    """One pipe-delimited file as instruments; lines: one string column and the header among its rows.

    Columns are found by the header's names (``Symbol`` or ``ACT Symbol``). The footer, rows that are too
    short and test issues are dropped.
    """
    rows = lines.select(F.col(lines.columns[0]).alias("line")).filter(F.trim("line") != "").withColumn("f", F.split("line", r"\|"))
    is_header = F.array_contains("f", "Security Name") & F.array_contains("f", "Test Issue")
    head = rows.filter(is_header).agg(F.min("f").alias("f"))
    place = lambda *names: F.coalesce(*[F.nullif(F.array_position("f", n), F.lit(0)) for n in names]).cast("int")
    at = head.select(place("Symbol", "ACT Symbol").alias("s"), place("Security Name").alias("n"), place("ETF").alias("e"), place("Test Issue").alias("t")).first()
    if at is None or any(x is None for x in at):
        raise ValueError("the header lacks a column")
    cell = lambda i: F.trim(F.col("f")[i - 1])
    body = rows.filter(~is_header & ~F.col("line").startswith("File Creation Time") & (F.size("f") >= max(at)))
    body = body.filter(cell(at["t"]) != "Y")
    role = F.when(cell(at["e"]) == "Y", "reference").otherwise("candidate")
    return body.select(F.lit("US").alias("market"), cell(at["s"]).alias("symbol"), role.alias("role"), cell(at["n"]).alias("name"))


def us_instruments(spark: SparkSession, *paths: str) -> DataFrame:
    out = index_rows(spark, "US")
    for p in paths:
        out = out.unionByName(us_listing(spark.read.text(p)))
    return out


def idx_instruments(symbols: DataFrame) -> DataFrame:
    """Every screened symbol (one string column) is a candidate without a name."""
    rows = symbols.select(F.lit("IDX").alias("market"), F.trim(F.col(symbols.columns[0])).alias("symbol"), F.lit("candidate").alias("role"), F.lit("").alias("name"))
    return index_rows(symbols.sparkSession, "IDX").unionByName(rows.filter(F.col("symbol") != ""))
