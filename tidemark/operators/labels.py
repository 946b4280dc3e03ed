"""The rolling refresh of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import upsert
from tidemark.params import Params


def to_fetch(members: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """market, symbol, is_new: members without a label, and the stalest slice of those with one."""
    key = ["market", "symbol"]
    new = members.select(*key).distinct().join(labels, key, "left_anti").withColumn("is_new", F.lit(True))
    held = labels.join(members.select(*key).distinct(), key, "left_semi")
    # How many of the stalest: counted by aggregation; ranked by market, a row a symbol.
    size = held.groupBy("market").agg(F.ceil(F.count("*") / params.label_slice).alias("_size"))
    n = F.row_number().over(Window.partitionBy("market").orderBy("as_of", "symbol"))
    stale = held.withColumn("_n", n).join(F.broadcast(size), "market").filter(F.col("_n") <= F.col("_size"))
    return new.unionByName(stale.select(*key, F.lit(False).alias("is_new")))


def resolved(members: DataFrame, labels: DataFrame, fetched: DataFrame, params: Params = Params()) -> DataFrame:
    """Of fetched (market, symbol, status, sector, industry, as_of), what was to be fetched and resolved: a failed fetch leaves the cached label."""
    return fetched.join(to_fetch(members, labels, params).select("market", "symbol"), ["market", "symbol"], "left_semi").filter("status = 'resolved'")


def refresh(members: DataFrame, labels: DataFrame, fetched: DataFrame, params: Params = Params()) -> DataFrame:
    """labels after the night's fetches."""
    return upsert(labels, resolved(members, labels, fetched, params).select(*labels.columns))


def coverage(members: DataFrame, labels: DataFrame) -> DataFrame:
    """market, session, symbol of members that have a label."""
    return members.join(labels.select("market", "symbol"), ["market", "symbol"], "left_semi")
