"""Breaks: closes above the trigger of the session of detections before, and the report of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.candidates import scored
from tidemark.operators.copies import carried, placed
from tidemark.operators.detection import stop_width
from tidemark.params import Params

KEY = ["market", "session", "symbol"]


def breaks(detections: DataFrame, bars: DataFrame, nights: DataFrame) -> DataFrame:
    """market, session, symbol, before (the session of the trigger), trigger, adr, close, low, for every break.

    nights: market, session. Each night reads the latest earlier session with detections, so that a night
    without any leaves older triggers live. Tested is the bar of the night itself. Scores, industries and copies stay.
    """
    days = detections.select("market", F.col("session").alias("before")).distinct()
    w = Window.partitionBy("market").orderBy("session", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = nights.select("market", "session", F.lit(None).cast("date").alias("before"), F.lit(0).alias("_kind")).unionByName(days.select("market", F.col("before").alias("session"), "before", F.lit(1).alias("_kind")))
    live = both.withColumn("before", F.last("before", ignorenulls=True).over(w)).filter("_kind = 0 AND before IS NOT NULL").select("market", "session", "before").distinct()
    setups = detections.select("market", "symbol", F.col("session").alias("before"), "trigger", "adr", "line_ok", *[c for c in ("score", "industry") if c in detections.columns], *carried(detections))
    today = bars.select("market", "symbol", "session", F.col("close"), F.col("low"))
    out = setups.join(F.broadcast(live), ["market", "before"]).join(today, ["market", "symbol", "session"])
    return out.filter(F.col("close") > F.col("trigger"))


def digest(detections: DataFrame, bars: DataFrame, ranks: DataFrame, labels: DataFrame, nights: DataFrame, reported: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """market, session, position, symbol, score, industry, stopw_adr, close, trigger, pct_through, repeat, last_reported.

    reported: earlier reports (market, session, symbol) from before these nights.
    """
    out = breaks(scored(detections, ranks, labels, params), bars, nights)  # each detection is scored once, so that equal ones don't meet each other
    best = (F.desc("score"), F.desc("line_ok"))
    ties = ("industry", "close", "low", "trigger")  # only where symbols are shared does a session have several breaks of one; both windows take these in one order
    seen = Window.partitionBy("market", "symbol").orderBy("session", *best, *ties)
    if reported is None:
        out = out.withColumn("last_reported", F.lag("session").over(seen))
    else:
        known = out.withColumn("_new", F.lit(True)).unionByName(reported.select("market", "session", "symbol"), allowMissingColumns=True)
        out = known.withColumn("last_reported", F.lag("session").over(seen)).filter("_new").drop("_new")
    order = Window.partitionBy("market", "session").orderBy(*best, "symbol", *ties)
    out = placed(out, order, "position").withColumn("last_reported", F.when(F.col("_copy") == 0, F.col("last_reported")).otherwise(F.col("session")))
    out = out.withColumn("stopw_adr", stop_width(F.col("trigger") - F.col("low"), F.col("trigger"), F.col("adr")))
    through = F.try_divide(F.col("close") - F.col("trigger"), F.col("trigger")) * 100
    return out.select("market", "session", "position", "symbol", "score", "industry", "stopw_adr", "close", "trigger", through.alias("pct_through"), F.col("last_reported").isNotNull().alias("repeat"), "last_reported")


def report(digests: DataFrame, nights: DataFrame) -> DataFrame:
    """market, session, text: the whole report of each night, quiet ones included. Halves of a cent are rounded up."""
    stars = F.concat(F.regexp_replace(F.format_string("%.1f", F.col("score")), r"\.0$", ""), F.lit("★"))
    marker = F.when(F.col("repeat"), F.concat(F.lit("↺ last reported "), F.col("last_reported").cast("string"))).otherwise("")
    row = F.format_string(
        "| %s | %s | %s | %.2f | %.2f | %.2f | %+.2f%% | %s |", F.col("symbol"), stars, F.coalesce(F.nullif(F.col("industry"), F.lit("")), F.lit("—")),
        F.col("stopw_adr"), F.col("close"), F.col("trigger"), F.col("pct_through"), marker,
    )
    rows = digests.select("market", "session", "position", row.alias("line")).groupBy("market", "session").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("rows"))
    out = nights.select("market", "session").distinct().join(rows, ["market", "session"], "left")
    head = F.concat(
        F.lit("# "), F.col("market"), F.lit(" digest — "), F.col("session").cast("string"),
        F.lit("\n\nReport a name when today's close is above yesterday's trigger — i.e. today's close is above the last four sessions' high.\n\n"),
    )
    table = "| Ticker | Score | Industry | Stop ÷ADR | Close | Trigger | % through | |\n|---|---|---|---|---|---|---|---|\n"
    body = F.when(F.col("rows").isNull(), F.lit("No breaks tonight.")).otherwise(F.concat(F.lit(table), F.array_join(F.transform("rows", lambda x: x["line"]), "\n")))
    return out.select("market", "session", F.concat(head, body, F.lit("\n")).alias("text"))


def write_report(reports: DataFrame, path: str) -> None:
    """One text file for each market and session, in folders of those names; a report that is written again takes the old one's place."""
    rows = reports.withColumn("text", F.regexp_replace("text", r"\n$", "")).repartition("market", "session")
    rows.write.partitionBy("market", "session").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)
