"""The stored tables' columns, and the reconciling of tables with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files

#: Each table's columns, in order.
TABLES = {
    "runs": "market string, session date, status string, symbols_enumerated int, symbols_resolved int, created_at timestamp",
    "universe": "market string, session date, symbol string",
    "bars": "market string, symbol string, session date, open double, high double, low double, close double, adj_close double, volume bigint",
    "ranks": "market string, session date, symbol string, lookback string, percentile double, raw_return double",
    "follow_through": "market string, session date, broke_out boolean, index_close double",
    "labels": "market string, symbol string, sector string, industry string, as_of date",
    "detections": "market string, symbol string, session date, detector_version int, trigger double, stop double, stopw_adr double, base_len int, "
    "move_gain double, adr double, close double, cluster_k int, cluster_high double, cluster_low double, cluster_range_adr double, line_ok boolean, "
    "touch_zones int, overshoot_adr double, slope double, line_end double, base_low double, churn_l double, sma20_rising boolean, dryup double",
    "digest_breaks": "market string, session date, symbol string",
    "digest_reports": "market string, session date, text string",
    "symbol_state": "market string, session date, symbol string, bars bigint, member boolean, last_report date",
}
KEYS = {
    "runs": ("market", "session"),
    "universe": ("market", "session", "symbol"),
    "bars": ("market", "symbol", "session"),
    "ranks": ("market", "session", "symbol", "lookback"),
    "follow_through": ("market", "session"),
    "labels": ("market", "symbol"),
    "detections": ("market", "session", "symbol"),
    "digest_breaks": ("market", "session", "symbol"),
    "digest_reports": ("market", "session"),
    "symbol_state": ("market", "session", "symbol"),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def check_stored(spark: SparkSession, where: str, wanted: T.StructType, table: str, partitions: list[str]) -> None:
    """Raises if a stored column has another type than is declared: by the footers of each market's last partition, before any scan."""
    last = {}
    for folder in sorted(files.listed(spark, "/".join([where, *(f"{p}=*" for p in partitions)]))):
        last[folder.split("/")[-len(partitions)]] = folder
    for folder in last.values():
        have = {f.name: f.dataType for f in spark.read.parquet(folder).schema.fields}
        drift = [f"{f.name}: {have[f.name].simpleString()}, declared {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name] != f.dataType]
        if drift:
            raise TypeError(f"{table}: stored {'; '.join(drift)}")


def reconcile(df: DataFrame, table: str) -> DataFrame:
    """df with the table's declared columns: missing ones are null, others stay behind them, another type raises."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wanted = schema(table)
    drift = [f"{f.name}: {have[f.name].simpleString()}, declared {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name] != f.dataType]
    if drift:
        raise TypeError(f"{table}: {'; '.join(drift)}")
    columns = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*columns, *[F.col(c) for c in df.columns if c not in wanted.names])
