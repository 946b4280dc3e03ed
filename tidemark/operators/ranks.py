"""Ranks of members by their returns, the gates on them, and the leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import indicators as ind
from tidemark.operators.calendar import session_before
from tidemark.operators.copies import carried, placed, weight
from tidemark.params import LOOKBACKS, Params
from tidemark.sources.shared import stored

KEY = ["market", "session", "symbol"]


def large(members: DataFrame, rows: int) -> bool:
    """Whether a session has more members than one task should sort."""
    return not members.groupBy("market", "session").agg(F.count("*").alias("n")).filter(F.col("n") > rows).isEmpty()


def spread_cume_dist(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with percentile: the cume_dist of value (a double, no nulls) in its group by by, without sorting a group in one task.

    Equal values are counted once before they are shuffled. The different ones go into ranges of 2^-10, which are
    split into ranges of 2^-22; counts of ranges are carried from the finer to the coarser and added back, so that
    what one task sorts are the ranges of a group, the at most 4,096 parts of one, or the values in one part.
    Infinite values and NaN have ranges of their own, at the ends.
    """
    part = lambda scale: F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(F.floor(F.col(value) * float(scale)))
    upto = lambda keys, order: F.sum("_n").over(Window.partitionBy(*keys).orderBy(order))
    keys = [[*by, "_range"], [*by, "_range", "_part"]]
    rows = stored(rows, "ranked")  # read twice: for the counts, and to be given its shares
    values = rows.groupBy(*by, value).agg(F.sum(weight(rows)).alias("_n")).withColumn("_range", part(1 << 10)).withColumn("_part", part(1 << 22))
    values = stored(values, "values")
    parts = values.groupBy(*keys[1]).agg(F.sum("_n").alias("_n"))
    ranges = parts.groupBy(*keys[0]).agg(F.sum("_n").alias("_n"))
    ranges = ranges.select(*keys[0], (upto(by, "_range") - F.col("_n")).alias("_a"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    parts = parts.select(*keys[1], (upto(keys[0], "_part") - F.col("_n")).alias("_b")).join(ranges, keys[0])
    shares = values.select(*keys[1], value, upto(keys[1], value).alias("_c")).join(parts, keys[1])
    shares = shares.select(*by, value, ((F.col("_a") + F.col("_b") + F.col("_c")) / F.col("_all")).alias("percentile"))
    return rows.join(shares, [*by, value]).select(*rows.columns, "percentile")


def ranks(universe: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, symbol, lookback, percentile, raw_return: the share of members with a return that is no greater.

    Sessions of more than sorted_rows members are ranked by ranges, others by a window each; the shares are the same.
    Copies of members stay, and count in the shares.
    """
    got, by = ind.calendar_returns(bars, universe), ["market", "session", "lookback"]
    if large(universe, params.sorted_rows):
        got = spread_cume_dist(got, by, "raw_return")
    elif carried(got):
        among = Window.partitionBy(*by)
        got = got.withColumn("percentile", F.sum("copies").over(among.orderBy("raw_return").rangeBetween(Window.unboundedPreceding, 0)) / F.sum("copies").over(among))
    else:
        got = got.withColumn("percentile", F.cume_dist().over(Window.partitionBy(*by).orderBy("raw_return")))
    return got.select(*KEY, "lookback", "percentile", "raw_return", *carried(got))


def breadth_counts(ranks: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, symbol, breadth: in how many lookbacks each is in the top decile."""
    return ranks.groupBy(*KEY).agg(breadth(ranks, params))


def breadth(ranks: DataFrame, params: Params = Params()) -> Column:
    """An aggregate of a name's ranks: how many are in the top decile, copies included."""
    return F.sum(F.when(F.col("percentile") >= params.top_decile, weight(ranks)).otherwise(0)).cast("int").alias("breadth")


def decile_gate(ranks: DataFrame, params: Params = Params(), lookbacks: tuple = tuple(LOOKBACKS)) -> DataFrame:
    """market, session, symbol of those in the top decile of any of the lookbacks."""
    return ranks.filter((F.col("percentile") >= params.top_decile) & F.col("lookback").isin(*lookbacks)).select(*KEY).distinct()


def detection_gate(ranks: DataFrame, params: Params = Params()) -> DataFrame:
    return decile_gate(ranks, params, params.gate_lookbacks)


def board_rows(ranks: DataFrame, params: Params = Params()) -> DataFrame:
    """The best of each lookback by return, with rank from 1. Tasks send the best of their own rows only, so a large group isn't sorted in one."""
    order = Window.partitionBy("market", "session", "lookback").orderBy(F.desc("raw_return"), "symbol")
    return placed(ranks, order, "rank", params.board_size).drop("_copy")


def boards(returns: DataFrame, params: Params = Params()) -> DataFrame:
    """The board_rows of the ranks of returns (market, symbol, session, lookback, raw_return), for which no group is sorted or exchanged whole.

    Returns are read twice: for each group's size and the range of 2^-4 in which its board ends, by counts, and for the
    returns from that range on. All that are greater than one on a board are on it too, so their number gives its share.
    """
    by = ["market", "session", "lookback"]
    part = F.when(F.isnan("raw_return"), F.lit(2**63 - 1)).otherwise(F.floor(F.col("raw_return") * 16.0))
    rows = stored(returns, "returns").withColumn("_part", part)
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    greater = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("_greater", greater).groupBy(*by).agg(F.sum("_n").alias("_n"), F.min(F.when(F.col("_greater") < params.board_size, F.col("_part"))).alias("_end"))
    best = board_rows(rows.join(F.broadcast(ends), by).filter(F.col("_part") >= F.col("_end")), params)  # a row a board, as many as sessions and lookbacks
    above = F.rank().over(Window.partitionBy(*by).orderBy(F.desc("raw_return"))) - 1
    return best.withColumn("percentile", (F.col("_n") - above) / F.col("_n")).select(*KEY, "lookback", "percentile", "raw_return", "rank")


def board_names(ranks: DataFrame, params: Params = Params()) -> DataFrame:
    return board_rows(ranks, params).select(*KEY).distinct()


def leaderboards(ranks: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, lookback, rank, symbol, raw_return, breadth, is_new, surge, adr.

    New: not on the same board on the session of ranks before. ADR is read at the session itself, and only for names on a board.
    """
    rows = board_rows(ranks, params)
    before = session_before(ranks).select("market", "session", "before")
    earlier = rows.select("market", F.col("session").alias("before"), "lookback", "symbol", F.lit(True).alias("_was"))
    out = rows.join(F.broadcast(before), ["market", "session"]).join(earlier, ["market", "before", "lookback", "symbol"], "left")
    out = out.join(breadth_counts(ranks.filter(F.col("percentile") >= params.top_decile), params), KEY, "left")  # a tenth of the ranks; none is 0
    own = bars.select("market", "symbol", "session", ind.adr(params).alias("adr"))
    out = out.join(own, ["market", "symbol", "session"], "left")
    surge = (F.col("lookback") == params.short_lookback) & (F.col("raw_return") >= params.surge)
    return out.select("market", "session", "lookback", "rank", "symbol", "raw_return", F.coalesce("breadth", F.lit(0)).alias("breadth"), F.col("_was").isNull().alias("is_new"), surge.alias("surge"), "adr")


def without_low_adr(boards: DataFrame, params: Params = Params()) -> DataFrame:
    return boards.filter(F.col("adr").isNull() | (F.col("adr") >= params.low_adr))
