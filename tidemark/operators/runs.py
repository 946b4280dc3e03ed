"""Runs: what is published, what is due, and whether a pull was complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dates import run_is_due
from tidemark.params import Params


def latest_published(runs: DataFrame) -> DataFrame:
    """The last published run of each market."""
    last = runs.filter("status = 'published'").groupBy("market").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "market"]), "session").alias("r"))
    return last.select("market", "r.*")


def unresolved(instruments: DataFrame, resolutions: DataFrame) -> DataFrame:
    """market, session, symbol of candidates that a session didn't resolve."""
    days = resolutions.select("market", "session").distinct()
    who = instruments.filter("role = 'candidate'").select("market", "symbol").join(F.broadcast(days), "market")
    return who.join(resolutions.filter("status = 'resolved'"), ["market", "session", "symbol"], "left_anti").select("market", "session", "symbol")


def run_gate(instruments: DataFrame, resolutions: DataFrame, published: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """market, session, status, symbols_enumerated, symbols_resolved.

    Published if enough of what could resolve did (refusals leave the count), and if the enumeration is not
    much smaller than that of the last published run before. published: earlier published runs; without
    them, the sessions given stand for it, each measured against the last one that passes the first gate.
    """
    who = instruments.filter("role = 'candidate'").select("market", "symbol")
    counts = resolutions.join(who, ["market", "symbol"], "left_semi").groupBy("market", "session")
    out = counts.agg(F.count_if(F.col("status") != "refused").cast("int").alias("symbols_enumerated"), F.count_if(F.col("status") == "resolved").cast("int").alias("symbols_resolved"))
    out = out.withColumn("_whole", F.col("symbols_resolved") >= params.resolution_floor * F.col("symbols_enumerated"))
    if published is None:
        w = Window.partitionBy("market").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.last(F.when(F.col("_whole"), F.col("symbols_enumerated")), ignorenulls=True).over(w))
    else:
        last = latest_published(published).select("market", F.col("symbols_enumerated").alias("_before"))
        out = out.join(F.broadcast(last), "market", "left")
    fine = F.col("_whole") & (F.col("_before").isNull() | (F.col("symbols_enumerated") >= params.enumeration_floor * F.col("_before")))
    return out.select("market", "session", F.when(fine, "published").otherwise("quarantined").alias("status"), "symbols_enumerated", "symbols_resolved")


def runs_summary(runs: DataFrame, universe: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    """market, latest (the last published run), universe_size, run_due, stale (a newer run is quarantined)."""
    newest = runs.groupBy("market").agg(F.max_by("status", "session").alias("newest"))
    latest = latest_published(runs)
    size = universe.join(F.broadcast(latest.select("market", "session")), ["market", "session"], "left_semi").groupBy("market").agg(F.count("*").cast("int").alias("n"))
    run = F.struct("session", "status", "symbols_enumerated", "symbols_resolved", "created_at")
    out = newest.join(latest, "market", "left").join(size, "market", "left")
    return out.select(
        "market", F.when(F.col("session").isNotNull(), run).alias("latest"), F.coalesce("n", F.lit(0)).alias("universe_size"),
        run_is_due(F.col("session"), F.col("market"), now, params).alias("run_due"), (F.col("session").isNotNull() & (F.col("newest") == "quarantined")).alias("stale"),
    )
