import random
from datetime import date, timedelta

import pytest
from helpers import bars, rows
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import indicators as ind


def last(df, column):
    return df.orderBy(F.desc("session")).first()[column]


def test_adr_needs_a_full_window(spark):
    full = bars(spark, rows("A", [(110, 100, 105)] * 20))
    assert last(ind.rolling(full), "adr") == pytest.approx(0.10)
    assert last(ind.rolling(bars(spark, rows("A", [(110, 100, 105)] * 19))), "adr") is None


def test_adr_is_null_with_a_zero_low(spark):
    assert last(ind.rolling(bars(spark, rows("A", [(110, 100, 105)] * 19 + [(110, 0, 105)]))), "adr") is None


def test_sma(spark):
    df = bars(spark, rows("A", list(range(1, 11))))
    assert last(df.select("session", ind.sma("adj_close", 10).alias("x")), "x") == 5.5
    assert last(df.select("session", ind.sma("adj_close", 3).alias("x")), "x") == 9.0


def test_ema_is_seeded_with_the_mean(spark):
    got = [r["ema"] for r in ind.ema(bars(spark, rows("A", [1, 2, 3, 4, 5])), 3).orderBy("session").collect()]
    assert [None if x is None or x != x else x for x in got] == [None, None, 2.0, 3.0, 4.0]
    short = ind.ema(bars(spark, rows("A", [1, 2])), 3).collect()
    assert [r["ema"] for r in short] == [None, None]


@pytest.mark.parametrize("n", [1, 3, 65, 400])
def test_ema_against_the_recursion(spark, n):
    rng = random.Random(n)
    closes = {s: [rng.uniform(1, 1e6) if rng.random() < 0.1 else rng.uniform(1, 50) for _ in range(size)] for s, size in {"A": 3000, "B": 700, "C": n, "D": max(1, n - 1)}.items()}
    got = {}
    for r in ind.ema(bars(spark, *[rows(s, x) for s, x in closes.items()]), n).orderBy("symbol", "session").collect():
        got.setdefault(r["symbol"], []).append(r["ema"])
    for s, x in closes.items():
        want = [None] * min(n - 1, len(x))
        for i in range(n - 1, len(x)):
            want.append(sum(x[:n]) / n if i == n - 1 else 2 / (n + 1) * x[i] + (n - 1) / (n + 1) * want[-1])
        assert got[s] == [None if y is None else pytest.approx(y, rel=1e-12) for y in want]


def test_ema_leaves_out_null_closes(spark):
    df = bars(spark, rows("A", [1, 2, 3, 4, 5])).withColumn("close", F.expr("CASE WHEN close <> 2 THEN close END"))
    assert [r["ema"] for r in ind.ema(df, 2).orderBy("session").collect()] == [None, 2.0, pytest.approx(10 / 3), pytest.approx(40 / 9)]


def test_ema_is_one_sort_without_python(spark):
    plan = ind.ema(bars(spark, rows("A", [1.0] * 5)), 65)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_median_dollar_volume(spark):
    df = bars(spark, rows("A", list(range(1, 26)), volumes=[1] * 25))
    assert last(df.select("session", ind.median_dollar_volume().alias("x")), "x") == 15.5


@pytest.mark.parametrize(
    ("day", "lookback", "want"),
    [
        (date(2026, 7, 15), "1w", date(2026, 7, 8)), (date(2026, 8, 5), "1m", date(2026, 7, 5)), (date(2026, 8, 5), "3m", date(2026, 5, 5)),
        (date(2026, 8, 5), "12m", date(2025, 8, 5)), (date(2026, 3, 31), "1m", date(2026, 2, 28)),
    ],
)
def test_anchors(spark, day, lookback, want):
    assert spark.range(1).select(dates.anchor_date(F.lit(day), lookback)).first()[0] == want


def test_returns(spark):
    df = bars(spark, rows("A", [100] * 7 + [120] * 7))
    keys = df.filter(F.col("session") == date(2026, 1, 14)).select("market", "symbol", "session")
    got = {r["lookback"]: r["raw_return"] for r in ind.calendar_returns(df, keys).collect()}
    assert got == {"1w": pytest.approx(0.20)}


def test_as_of_takes_the_last_bar_on_or_before(spark):
    df = bars(spark, rows("A", [1, 2, 3], days=[date(2026, 1, 1), date(2026, 1, 5), date(2026, 1, 9)]))
    probes = spark.createDataFrame([("US", "A", date(2025, 12, 31), 1), ("US", "A", date(2026, 1, 5), 2), ("US", "A", date(2026, 1, 8), 3), ("US", "B", date(2026, 1, 8), 4)], "market string, symbol string, day date, n int")
    got = {r["n"]: r["close"] for r in ind.as_of(df, probes, ["close"]).collect()}
    assert got == {1: None, 2: 2.0, 3: 2.0, 4: None}


def test_finality_and_last_final_session(spark):
    ask = lambda market, now: spark.range(1).select(dates.last_final_session(F.lit(market), F.lit(now).cast("timestamp"))).first()[0]
    final = lambda now: spark.range(1).select(dates.is_final(F.lit(date(2026, 7, 15)), F.lit("US"), F.lit(now).cast("timestamp"))).first()[0]
    assert [final(x) for x in ("2026-07-15 20:15:00", "2026-07-15 20:30:00", "2026-07-15 20:45:00")] == [False, False, True]  # 16:15, 16:30, 16:45 in New York
    assert ask("US", "2026-07-15 20:45:00") == date(2026, 7, 15)
    assert ask("US", "2026-07-15 20:15:00") == date(2026, 7, 14)
    assert ask("IDX", "2026-07-19 12:00:00") == date(2026, 7, 17)  # a Sunday
    assert ask("US", "2026-01-15 21:15:00") == date(2026, 1, 14)  # 16:15 in winter
    due = spark.range(1).select(dates.run_is_due(F.lit(None).cast("date"), F.lit("US"), F.lit("2026-07-15 20:45:00").cast("timestamp")), dates.run_is_due(F.lit(date(2026, 7, 15)), F.lit("US"), F.lit("2026-07-15 20:45:00").cast("timestamp"))).first()
    assert tuple(due) == (True, False)


def test_empty(spark):
    df = bars(spark, rows("A", [1])).limit(0)
    assert ind.rolling(df).count() == 0 and ind.ema(df).count() == 0
    assert ind.calendar_returns(df, df.select("market", "symbol", "session")).count() == 0


def test_many_symbols_stay_apart(spark):
    df = bars(spark, rows("A", [1, 2, 3]), rows("A", [10, 20, 30], market="IDX"), rows("B", [7] * 3, start=date(2026, 1, 1) + timedelta(days=1)))
    got = {(r["market"], r["symbol"]): r["x"] for r in df.select("market", "symbol", "session", ind.sma("close", 3).alias("x")).filter("x IS NOT NULL").collect()}
    assert got == {("US", "A"): 2.0, ("IDX", "A"): 20.0, ("US", "B"): 7.0}


def test_returns_sort_no_row_a_lookback(spark):
    """Keys meet bars as they are, not once for each lookback; month ends clamp, and keys need no bar of their own day."""
    days = [date(2024, 1, 31), date(2024, 2, 27), date(2024, 2, 29), date(2024, 3, 30)]
    df = spark.createDataFrame([("US", "A", d, float(2**i)) for i, d in enumerate(days)], "market string, symbol string, session date, adj_close double")
    keys = spark.createDataFrame([("US", "A", date(2024, 3, 31)), ("US", "A", date(2024, 3, 28)), ("US", "A", date(2023, 1, 1))], "market string, symbol string, session date")
    got = ind.calendar_returns(df, keys)
    assert {(r["session"].day, r["lookback"]): r["raw_return"] for r in got.collect()} == {(31, "1w"): 1.0, (31, "1m"): 1.0, (28, "1w"): 0.0, (28, "1m"): 1.0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window") and plan.count("Generate") == 1


def test_ema_beside_bars_without_a_close(spark):
    df = bars(spark, rows("A", [float(i % 7 + 1) for i in range(40)]), rows("B", [3.0] * 4)).withColumn("close", F.when(F.col("session") != date(2026, 1, 10), F.col("close")))
    got = {(r["symbol"], r["session"]): r["ema"] for r in ind.with_ema(df, 5).collect()}
    want = {(r["symbol"], r["session"]): r["ema"] for r in ind.ema(df, 5).collect()}
    assert len(got) == 44 and got.pop(("A", date(2026, 1, 10))) is None and got == want


def test_chart_exchanges_bars_once(spark):
    from tidemark.operators import chart

    df = bars(spark, rows("A", [float(i % 7 + 1) for i in range(40)]))
    symbols = spark.createDataFrame([("US", "A", date(2026, 2, 1))], "market string, symbol string, as_of date")
    found = spark.createDataFrame([], "market string, symbol string, session date, base_len int, cluster_k int, cluster_high double, slope double")
    plan = chart.chart_rows(df, symbols, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # bars, symbols, setups and their join; ten before
