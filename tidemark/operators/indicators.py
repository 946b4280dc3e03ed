"""Rolling statistics over traded bars, and returns between calendar days.

Each function takes bars (market, symbol, session, prices, volume) and adds columns by windows over one
(market, symbol) partitioning, so that Spark shuffles bars once for all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.operators.copies import carried
from tidemark.operators.hygiene import dollar_volume
from tidemark.params import LOOKBACKS, Params

EMA_RADIX = 8
EMA_NOTHING = 1e-24  #: the weight of what is left out, far below a double's last place


def by_symbol() -> WindowSpec:
    return Window.partitionBy("market", "symbol").orderBy("session")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def numbered(bars: DataFrame) -> DataFrame:
    """With idx, the bar's place in its symbol's history, from 0."""
    return bars.withColumn("idx", F.row_number().over(by_symbol()) - 1)


def full_mean(value: Column, n: int) -> Column:
    """Mean over the last n bars; null until there are n values."""
    w = last_rows(n)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def adr(params: Params = Params()) -> Column:
    """Average daily range, as a share of the low."""
    return full_mean(F.try_divide(F.col("high"), F.col("low")) - 1, params.window)


def sma(value: str, n: int) -> Column:
    return full_mean(F.col(value), n)


def median_dollar_volume(params: Params = Params(), by: WindowSpec | None = None) -> Column:
    """Over as many of the last bars as there are, up to the window; by: a symbol's bars in another order than that of sessions."""
    known = F.sort_array(F.collect_list(dollar_volume()).over(last_rows(params.window) if by is None else by.rowsBetween(-(params.window - 1), 0)))
    middle = lambda v: 0.5 * F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + 0.5 * F.get(v, F.floor(F.size(v) / 2).cast("int"))
    return F.transform(F.array(known), middle)[0]


def steady(value: Column) -> Column:
    """To ten places: what is left is no noise of summation, so equal means compare as equal."""
    return F.round(value, 10)


def rising(value: str, lag: int = 5) -> Column:
    """Greater than lag bars ago; the sign only."""
    x = steady(F.col(value))
    return F.coalesce(x > F.lag(x, lag).over(by_symbol()), F.lit(False))


def rolling(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """idx, adr, adr_abs, averages of close and adjusted close, their rises, and median dollar volume."""
    out = numbered(bars).withColumn("adr", adr(params)).withColumn("adr_abs", F.col("adr") * F.col("close"))
    for n in (10, 20, 50):
        out = out.withColumn(f"sma{n}", sma("close", n))
    for n in (10, 20):
        out = out.withColumn(f"adj_sma{n}", sma("adj_close", n))
    for x in ("sma20", "adj_sma10", "adj_sma20"):
        out = out.withColumn(f"{x}_rising", rising(x, params.rising_lag))
    return out.withColumn("dollar_volume", median_dollar_volume(params))


def ema(bars: DataFrame, n: int = Params().ema) -> DataFrame:
    """market, symbol, session, ema of close: seeded with the first full mean, then alpha = 2 / (n + 1).

    A scan of the affine maps e -> keep * e + alpha * close: each pass joins EMA_RADIX spans of equal length into
    one, all passes share one sort, and they end when what lies before the spans weighs nothing. Closes that are
    null or no bar take no part: a session without one has no ema.
    """
    return _scanned(bars.filter("close IS NOT NULL").select("market", "symbol", "session", "close"), by_symbol(), n).select("market", "symbol", "session", "ema")


def with_ema(bars: DataFrame, n: int = Params().ema) -> DataFrame:
    """bars with ema, null where close is: bars without a close are windowed by themselves, so that the rest needs no join to come back to them."""
    out = _scanned(bars.withColumn("_none", F.col("close").isNull()), Window.partitionBy("market", "symbol", "_none").orderBy("session"), n)
    return out.withColumn("ema", F.when(~F.col("_none"), F.col("ema"))).drop("_none")


def _scanned(bars: DataFrame, w: WindowSpec, n: int) -> DataFrame:
    """bars with ema over w."""
    alpha = 2 / (n + 1)
    out = bars.withColumn("_no", F.row_number().over(w)).withColumn("_first", F.avg("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("ema", F.when(F.col("_no") < n, 0.0).when(F.col("_no") == n, F.col("_first")).otherwise(alpha * F.col("close"))).drop("_first")
    span = 1
    while (1 - alpha) ** span > EMA_NOTHING:
        earlier = [(1 - alpha) ** (i * span) * F.lag("ema", i * span, 0.0).over(w) for i in range(EMA_RADIX - 1, 0, -1)]
        out = out.withColumn("ema", reduce(add, [*earlier, F.col("ema")]))
        span *= EMA_RADIX
    return out.withColumn("ema", F.when(F.col("_no") >= n, F.col("ema"))).drop("_no")


def as_of(bars: DataFrame, probes: DataFrame, columns: list[str]) -> DataFrame:
    """probes (market, symbol, day, ...) with the columns of the last bar on or before their day; null if there is none.

    Bars and probes are sorted together within each symbol, so a probe costs a row, not a range join.
    """
    value = F.struct(*[F.col(c) for c in columns])
    rest = [c for c in probes.columns if c not in ("market", "symbol", "day")]
    b = bars.select("market", "symbol", F.col("session").alias("day"), F.lit(0).alias("_kind"), value.alias("_bar"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest])
    p = probes.select("market", "symbol", "day", F.lit(1).alias("_kind"), F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar"), *rest)
    w = Window.partitionBy("market", "symbol").orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = b.unionByName(p).withColumn("_bar", F.last("_bar", ignorenulls=True).over(w)).filter("_kind = 1")
    return found.select(*probes.columns, *[F.col(f"_bar.{c}").alias(c) for c in columns])


def calendar_returns(bars: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """market, symbol, session, lookback, raw_return for each key (market, symbol, session) and lookback that has one; without keys, for each bar.

    From the last adjusted close on or before the anchor day to the last on or before the session. Keys are sorted
    with bars once, and a window's range of days or months ends at the anchor: no row a lookback is sorted. Copies of keys stay.
    """
    more = [] if keys is None else carried(keys)
    rows = bars.select("market", "symbol", "session", F.lit(True).alias("_key"), F.struct("adj_close").alias("_bar"))
    end = F.col("_bar")["adj_close"]
    if keys is not None:
        none = F.lit(None).cast(rows.schema["_bar"].dataType)
        rows = rows.withColumn("_key", F.lit(False)).unionByName(keys.select("market", "symbol", "session", F.lit(True).alias("_key"), none.alias("_bar"), *more), allowMissingColumns=True)
        end = _last_bar("CURRENT ROW")
    starts = [_last_bar(f"{n} PRECEDING" if unit == "days" else f"INTERVAL '{n}' MONTH PRECEDING").alias(name) for name, (unit, n) in LOOKBACKS.items()]
    at = rows.select("market", "symbol", "session", *more, "_key", end.alias("end"), *starts).filter("_key")
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("lookback"), (F.try_divide("end", x) - 1).alias("raw_return")) for x in LOOKBACKS]))
    return at.select("market", "symbol", "session", *more, long.alias("x")).select("market", "symbol", "session", "x.*", *more).filter("raw_return IS NOT NULL")


def _last_bar(upto: str) -> Column:
    """The adjusted close of the last bar up to there. In SQL, as a Window's ranges know no months; these clamp at their ends."""
    return F.expr(f"last(_bar, true) OVER (PARTITION BY market, symbol ORDER BY session RANGE BETWEEN UNBOUNDED PRECEDING AND {upto})")["adj_close"]
