"""Small series as DataFrames."""

from __future__ import annotations

from datetime import date, timedelta

BARS = "market string, symbol string, session date, open double, high double, low double, close double, adj_close double, volume bigint"


def rows(symbol, series, start=date(2026, 1, 1), market="US", volumes=None, days=None):
    """series: (high, low, close) or a close alone for each bar."""
    out = []
    for i, x in enumerate(series):
        h, low, c = (x, x, x) if isinstance(x, (int, float)) else x
        day = days[i] if days else start + timedelta(days=i)
        out.append((market, symbol, day, float(c), float(h), float(low), float(c), float(c), volumes[i] if volumes else 1000))
    return out


def bars(spark, *groups):
    return spark.createDataFrame([r for g in groups for r in g], BARS)


def weekdays(n, start=date(2026, 1, 5)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out
