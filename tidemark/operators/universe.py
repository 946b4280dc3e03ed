"""Who belongs to the tradeable universe, session by session.

A candidate's session gives a signal: null (fetch unresolved, or liquidity between the two floors: keep
what was), 0 (a hard gate fails, or liquidity is below the exit floor) or 1 (liquidity reaches the entry
floor). Membership is the last signal that isn't null, so the whole history is one window, not a recursion.

On a session whose universe would come out empty, the next one still sees that as the state before it.

Where candidates share a symbol, a symbol's session is one row with the number of rows that it stands for
(candidates by outcomes by bars), so that the joins don't multiply the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dates import floor
from tidemark.operators import indicators as ind
from tidemark.operators.calendar import sessions
from tidemark.operators.copies import carried, spread
from tidemark.operators.hygiene import dollar_volume, is_common_stock
from tidemark.params import Params
from tidemark.sources.shared import dealt


def candidate_sessions(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """market, symbol, name, session, n for every candidate on every session of its market, sent as a bounded calendar."""
    who = dealt(instruments.filter("role = 'candidate'").select("market", "symbol", "name"), "market", "symbol")
    return who.join(F.broadcast(sessions(bars)), "market")


def density(grid: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """grid with traded, dense (enough of the last sessions traded, and one of the latest), age and liquidity as of the session."""
    own = bars.select("market", "symbol", "session", F.lit(1).alias("traded"), ind.median_dollar_volume(params).alias("dv"), (F.row_number().over(ind.by_symbol())).alias("bar_no"))
    out = grid.join(own, ["market", "symbol", "session"], "left").withColumn("traded", F.coalesce("traded", F.lit(0)))
    upto = ind.by_symbol().rowsBetween(ind.Window.unboundedPreceding, 0)
    out = out.withColumn("dense", (F.sum("traded").over(ind.last_rows(params.window)) >= params.density_min) & (F.max("traded").over(ind.last_rows(params.density_recent)) == 1))
    return out.withColumn("age", F.coalesce(F.last("bar_no", ignorenulls=True).over(upto), F.lit(0))).withColumn("liquidity", F.coalesce(F.last("dv", ignorenulls=True).over(upto), F.lit(0.0))).drop("dv", "bar_no")


def membership(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, params: Params = Params(), prior: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """market, symbol, session, signal, member on every session; prior: members (market, symbol) before the first session.

    A candidate session without an outcome counts as resolved.
    """
    # Outcomes are joined before any window, so that both joins share one exchange and all windows another.
    grid = candidate_sessions(instruments, bars if days is None else days).join(resolutions.select("market", "symbol", "session", "status"), ["market", "symbol", "session"], "left")
    out = density(grid, bars, params)
    least = floor(F.col("market"), params)
    hard = is_common_stock(F.col("name")) & (F.col("age") >= params.min_bars) & F.col("dense")
    signal = F.when(F.col("status") != "resolved", F.lit(None)).when(~hard, 0).when(F.col("liquidity") >= least, 1).when(F.col("liquidity") < params.exit_share * least, 0)
    out = out.withColumn("signal", signal.cast("int"))
    start = F.lit(0)
    if prior is not None:
        out = out.join(prior.select("market", "symbol", F.lit(1).alias("_prior")).distinct(), ["market", "symbol"], "left")
        start = F.coalesce("_prior", F.lit(0))
    upto = ind.by_symbol().rowsBetween(ind.Window.unboundedPreceding, 0)
    return out.withColumn("member", F.coalesce(F.last("signal", ignorenulls=True).over(upto), start) == 1)


def symbols_shared(instruments: DataFrame) -> bool:
    """Whether candidates of a market share a symbol."""
    n = instruments.filter("role = 'candidate'").groupBy("market", "symbol").agg(F.count("*").alias("n"))
    return not n.filter("n > 1").isEmpty()


def shared_sessions(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, days: DataFrame | None, *figures: Column) -> DataFrame:
    """One row for each symbol of candidates and session of its market: copies, _common, _all_common (of its names), _settled, and _bars and figures of its bars (null if there are none)."""
    key, on = ["market", "symbol"], ["market", "symbol", "session"]
    names = [f(is_common_stock(F.col("name"))).alias(c) for f, c in ((F.bool_or, "_common"), (F.bool_and, "_all_common"))]
    who = instruments.filter("role = 'candidate'").groupBy(*key).agg(F.count("*").alias("_who"), *names)
    settled = F.bool_or(F.coalesce(F.col("status") == "resolved", F.lit(True)))
    outcomes = resolutions.groupBy(*on).agg(F.count("*").alias("_outcomes"), settled.alias("_settled"))
    own = bars.groupBy(*on).agg(F.count("*").alias("_bars"), *figures)
    out = dealt(who, *key).join(F.broadcast(sessions(bars if days is None else days)), "market").join(outcomes, on, "left").join(own, on, "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    return out.withColumn("copies", F.col("_who") * one("_outcomes") * one("_bars"))


def shared_membership(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, params: Params = Params(), prior: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """market, symbol, session, signal, member, copies: membership with one row for all rows of a symbol's session.

    The grid's rows of a session (candidates by outcomes by bars) have no order among themselves. Age and liquidity are
    those of the last bar for all of them, bars of a session going by their dollar volume. The signal is that of the last one that has any, and that one is a common
    stock's if there is one; between the floors it is 0 if another name or the density gate fails at any row. Density counts rows, so it goes by their
    places: a frame of so many rows is a range of places, less what the earliest session in it has before the frame.
    """
    key, on = ["market", "symbol"], ["market", "symbol", "session"]
    by = Window.partitionBy(*key).orderBy("session", dollar_volume().asc_nulls_last())
    own = bars.select(*on, ind.median_dollar_volume(params, by).alias("dv"), F.row_number().over(by).alias("bar_no"))
    out = shared_sessions(instruments, own, resolutions, days, F.max("bar_no").alias("bar_no"), F.max_by("dv", "bar_no").alias("dv"))
    out = out.withColumn("traded", F.col("_bars").isNotNull().cast("int"))
    upto = lambda by: Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_end", F.sum("copies").over(upto("session")))  # the place of a session's last row
    last = lambda n: Window.partitionBy(*key).orderBy("_end").rangeBetween(-(n - 1), 0)
    before = lambda c: F.lag(c, 1, 0).over(Window.partitionBy(*key).orderBy("_end"))
    trades = F.col("traded") * F.col("copies")
    total = lambda n: F.sum(trades).over(last(n)) - F.first("traded").over(last(n)) * F.greatest(F.sum("copies").over(last(n)) - n, F.lit(0))
    recent = lambda n: F.max("traded").over(last(n))
    out = out.withColumns({"_total": total(params.window), "_less": total(params.window - 1), "_recent": recent(params.density_recent), "_lately": recent(params.density_recent - 1)})
    out = out.withColumns({"age": F.coalesce(F.last("bar_no", ignorenulls=True).over(upto("_end")), F.lit(0)), "liquidity": F.coalesce(F.last("dv", ignorenulls=True).over(upto("_end")), F.lit(0.0))})
    out = out.withColumns({"_first_total": before("_less") + F.col("traded"), "_first_recent": F.greatest(before("_lately"), "traded")})
    dense = (F.col("_total") >= params.density_min) & (F.col("_recent") == 1)
    throughout = F.col("_all_common") & (F.col("_first_total") >= params.density_min) & (F.col("_first_recent") == 1)
    least = floor(F.col("market"), params)
    hard = F.col("_common") & (F.col("age") >= params.min_bars) & dense
    signal = F.when(~F.coalesce("_settled", F.lit(True)), F.lit(None)).when(~hard, 0).when(F.col("liquidity") >= least, 1).when((F.col("liquidity") < params.exit_share * least) | ~throughout, 0)
    out = out.withColumn("signal", signal.cast("int"))
    start = F.lit(0)
    if prior is not None:
        out = out.join(prior.select(*key, F.lit(1).alias("_prior")).distinct(), key, "left")
        start = F.coalesce("_prior", F.lit(0))
    out = out.withColumn("member", F.coalesce(F.last("signal", ignorenulls=True).over(upto("_end")), start) == 1)
    return out.select(*on, "signal", "member", "copies")


def counted(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, params: Params = Params(), prior: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """market, session, symbol of the members; where candidates share symbols, each once, with copies. days: market and session of all bars, if they are known."""
    got = (shared_membership if symbols_shared(instruments) else membership)(instruments, bars, resolutions, params, prior, days).filter("member")
    return got.select("market", "session", "symbol", *carried(got))


def universe(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, params: Params = Params(), prior: DataFrame | None = None) -> DataFrame:
    """market, session, symbol of the members."""
    return spread(counted(instruments, bars, resolutions, params, prior))
