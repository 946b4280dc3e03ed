"""Market regime, breadth and index follow-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.params import INDEXES, Params

#: What each state advises.
POSTURE = {"FRIENDLY": "full size", "CHOPPY": "reduced", "HOSTILE": "sit out"}


def _averages(bars: DataFrame, params: Params) -> DataFrame:
    """bars with the two averages of the adjusted close, and the same some bars ago; null during warm-up."""
    out = bars.select("market", "symbol", "session", "adj_close", ind.steady(ind.sma("adj_close", 10)).alias("fast"), ind.steady(ind.sma("adj_close", 20)).alias("slow"))
    for x in ("fast", "slow"):
        out = out.withColumn(f"{x}_before", F.lag(x, params.rising_lag).over(ind.by_symbol()))
    return out.withColumn("warm", F.row_number().over(ind.by_symbol()) >= params.warm_up)


def _above_rising() -> Column:
    c = F.col
    return c("warm") & (c("adj_close") > c("fast")) & (c("adj_close") > c("slow")) & (c("fast") > c("fast_before")) & (c("slow") > c("slow_before"))


def regime_states(index_bars: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, state, posture for each bar of the markets' indexes; null during warm-up."""
    names = F.coalesce(*[F.when(F.col("market") == k, F.lit(v)) for k, v in INDEXES.items()])
    out = _averages(index_bars.filter(F.col("symbol") == names), params)
    down = (F.col("fast") < F.col("fast_before")) & (F.col("slow") < F.col("slow_before")) & (F.col("fast") < F.col("slow"))
    state = F.when(~F.col("warm"), None).when(down, "HOSTILE").when(_above_rising(), "FRIENDLY").otherwise("CHOPPY")
    words = F.create_map(*[F.lit(x) for kv in POSTURE.items() for x in kv])
    return out.withColumn("state", state).select("market", "session", "state", words[F.col("state")].alias("posture"))


def breadth(universe: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, breadth: the share of members above both rising averages as of their last bar; the young count as not."""
    flags = _averages(bars, params).withColumn("up", F.coalesce(_above_rising(), F.lit(False)).cast("double"))
    at = ind.as_of(flags, universe.select("market", "symbol", F.col("session").alias("day")), ["up"])
    return at.groupBy("market", F.col("day").alias("session")).agg(F.avg(F.coalesce("up", F.lit(0.0))).alias("breadth"))


def regime(bars: DataFrame, universe: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, state, posture, breadth (null without members)."""
    return regime_states(bars, params).join(breadth(universe, bars, params), ["market", "session"], "left")


def follow_through(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, broke_out (null under 21 bars), index_close for each bar of the markets' indexes."""
    names = F.coalesce(*[F.when(F.col("market") == k, F.lit(v)) for k, v in INDEXES.items()])
    before = ind.by_symbol().rowsBetween(-params.breakout, -1)
    out = F.when(F.count("*").over(before) == params.breakout, F.col("adj_close") > F.max("adj_close").over(before))
    return bars.filter(F.col("symbol") == names).select("market", "session", out.alias("broke_out"), F.col("adj_close").alias("index_close"))
