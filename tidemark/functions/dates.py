"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import LOOKBACKS, Params


def anchor_date(day: Column, lookback: str) -> Column:
    """The day that a return over the lookback starts from; month ends clamp."""
    unit, n = LOOKBACKS[lookback]
    return F.date_sub(day, n) if unit == "days" else F.add_months(day, -n)


def anchors(day: Column) -> Column:
    """An array of (lookback, anchor) for all lookbacks."""
    return F.array(*[F.struct(F.lit(k).alias("lookback"), anchor_date(day, k).alias("anchor")) for k in LOOKBACKS])


def _by_market(market: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(market == k, F.lit(v)) for k, v in values.items()])


def zone(market: Column, params: Params = Params()) -> Column:
    return _by_market(market, params.zones)


def floor(market: Column, params: Params = Params()) -> Column:
    return _by_market(market, params.floors)


def final_at(session: Column, market: Column, params: Params = Params()) -> Column:
    """The instant (UTC) after which a session's bar is final."""
    local = session.cast("timestamp") + F.make_dt_interval(mins=F.lit(params.close_minutes))
    return F.to_utc_timestamp(local, zone(market, params))


def is_final(session: Column, market: Column, now: Column, params: Params = Params()) -> Column:
    """Strictly after the close and its margin, in the exchange's own zone."""
    return now > final_at(session, market, params)


def last_final_session(market: Column, now: Column, params: Params = Params()) -> Column:
    """The latest weekday whose bar is final, up to ten days back; else the tenth day back."""
    today = F.to_date(F.from_utc_timestamp(now, zone(market, params)))
    days = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.date_sub(today, i.cast("int")))
    fine = F.filter(days, lambda d: (F.weekday(d) < 5) & is_final(d, market, now, params))
    return F.coalesce(F.array_max(fine), F.date_sub(today, 10))


def run_is_due(latest: Column, market: Column, now: Column, params: Params = Params()) -> Column:
    return latest.isNull() | (latest < last_final_session(market, now, params))
