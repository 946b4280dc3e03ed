"""Raw bar rows as typed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The raw columns and what they are called here.
RAW = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close"}


def parse_bars(rows: DataFrame, *keep: str) -> DataFrame:
    """market, symbol, session and prices of rows whose Date is a date, a timestamp or an ISO string; and the columns keep."""
    return rows.select(
        "market", "symbol", F.to_date(F.substring(F.col("Date").cast("string"), 1, 10)).alias("session"),
        *[F.col(f"`{a}`").cast("double").alias(b) for a, b in RAW.items()], F.col("Volume").cast("long").alias("volume"), *keep,
    )
