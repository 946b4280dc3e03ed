from datetime import date, timedelta

import pytest
from helpers import bars, rows, weekdays
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import chart, tables
from tidemark.params import Params
from tidemark.plans import nights
from tidemark.queries import Tables
from tidemark.streaming import ingest

DATA = "/root/testdata/sf0.001"
P = Params(floors={"US": 1.0, "IDX": 1.0})
RAW = "market string, symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint"


@pytest.fixture(scope="module")
def market(spark):
    """An index, one leader that ran up and rests, and two flat names."""
    days = weekdays(130)
    flat = [(10.1 - i / 1000, 9.9 - i / 1000, 10.0 - i / 1000) for i in range(130)]
    lead = [(50.5, 49.5, 50.0)] * 60 + [(50 + 3.5 * i + 0.5, 50 + 3.5 * i - 0.5, 50 + 3.5 * i) for i in range(15)] + [(100.5, 99.5, 100.0)] * 55
    df = bars(spark, rows("LEAD", lead, days=days), rows("FLAT", flat, days=days), rows("LEVEL", flat, days=days), rows("^IXIC", [100.0 + i for i in range(130)], days=days))
    who = spark.createDataFrame([("US", s, "candidate", "Corp") for s in ("LEAD", "FLAT", "LEVEL")] + [("US", "^IXIC", "reference", "")], "market string, symbol string, role string, name string")
    labels = spark.createDataFrame([("US", s, "Energy", "Oil", days[0]) for s in ("LEAD", "FLAT", "LEVEL")], schemas.TABLES["labels"])
    return days, df, who, labels


def outcomes(spark, days):
    return spark.createDataFrame([("US", s, d, "resolved") for s in ("LEAD", "FLAT", "LEVEL") for d in days], "market string, symbol string, session date, status string")


def test_end_to_end(spark, market):
    days, df, who, labels = market
    last = spark.createDataFrame([("US", days[104])], "market string, session date")
    night = nights.compute(who, df.filter(F.col("session") <= days[104]), outcomes(spark, days), labels, last, None, P)
    assert {r["symbol"] for r in night.universe.collect()} == {"LEAD", "FLAT", "LEVEL"}
    assert [r["symbol"] for r in nights.candidate_list(night, labels, P).collect()] == ["LEAD"]
    top = night.ranks.filter("lookback = '3m' AND percentile = 1.0").collect()
    assert [r["symbol"] for r in top] == ["LEAD"]


def test_backfill_equals_nightly_runs(spark, market, tmp_path):
    days, df, who, labels = market
    now = F.lit("2026-12-01 00:00:00").cast("timestamp")

    def run(base, targets):
        tables.append_bars(spark, base, df)
        for d in targets:
            target = spark.createDataFrame([("US", d)], "market string, target date")
            nights.run_market(spark, base, who, outcomes(spark, [d]), labels, target, now, P)
        return {t: sorted(map(str, tables.read(spark, base, t).collect())) for t in ("universe", "ranks", "detections", "follow_through", "digest_breaks", "runs")}

    start, stop = 103, 105
    one = run(str(tmp_path / "one"), days[start : stop + 1])
    two = run(str(tmp_path / "two"), [days[start], days[stop]])
    assert one == two
    assert len(one["runs"]) == 3 and one["detections"]


def test_a_broken_run_is_repeated(spark, market, tmp_path, monkeypatch):
    days, df, who, labels = market
    base, now = str(tmp_path), F.lit("2026-12-01").cast("timestamp")
    assert tables.append_bars(spark, base, df) == df.count() and tables.append_bars(spark, base, df) == 0
    target = spark.createDataFrame([("US", days[104])], "market string, target date")
    fetched = spark.createDataFrame([("US", s, "resolved", "Tech", "Chips", days[104]) for s in ("LEAD", "NONE")], "market string, symbol string, status string, sector string, industry string, as_of date")
    go = lambda: nights.run_market(spark, base, who, outcomes(spark, [days[104]]), labels.filter("symbol <> 'LEAD'"), target, now, P, fetched)
    with monkeypatch.context() as m:
        m.setattr(nights.detection, "detections", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            go()
    assert tables.read(spark, base, "universe").count() == 0 and tables.read(spark, base, "runs").count() == 0  # nothing of it is seen
    assert go().count() == 1
    assert tables.read(spark, base, "universe").count() == 3 and tables.read(spark, base, "detections").count() == 1
    assert {r["symbol"]: r["sector"] for r in tables.read(spark, base, "labels").collect()} == {"LEAD": "Tech", "FLAT": "Energy", "LEVEL": "Energy"}
    text = "\n".join(r["value"] for r in spark.read.text(tables.path(base, "reports")).collect())
    assert text.startswith(f"# US digest — {days[104]}")


def test_ranks_beyond_retention_go(spark, tmp_path):
    base = str(tmp_path)
    row = lambda d: ("US", d, "A", "1w", 1.0, 0.1)
    tables.append_once(spark, base, "ranks", spark.createDataFrame([row(date(2024, 1, 5)), row(date(2024, 7, 1)), row(date(2026, 6, 30))], schemas.TABLES["ranks"]))
    tables.prune(spark, base, "ranks", 24)
    assert sorted(r["session"] for r in tables.read(spark, base, "ranks").collect()) == [date(2024, 7, 1), date(2026, 6, 30)]


def test_shared_relations_are_read_once(spark):
    """Composite queries read the order tables through bars that are written once."""
    from tidemark.queries import QUERIES

    for name in ("candidates", "digest", "acceptance", "chart_bundle", "backfill"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and plan.count("Exchange ") <= 40, name


def test_incomplete_pulls_are_quarantined(spark, market, tmp_path):
    days, df, who, labels = market
    base = str(tmp_path)
    tables.append_bars(spark, base, df)
    bad = outcomes(spark, [days[100]]).withColumn("status", F.when(F.col("symbol") == "FLAT", "unresolved").otherwise("resolved"))
    got = nights.run_market(spark, base, who, bad, labels, spark.createDataFrame([("US", days[100])], "market string, target date"), F.lit("2026-12-01").cast("timestamp"), P).collect()
    assert [(r["session"], r["status"]) for r in got] == [(days[100], "quarantined")]
    assert tables.read(spark, base, "universe").count() == 0


def test_set_wise_equals_session_by_session(spark):
    t = Tables(spark, DATA)
    last = [r["session"] for r in t.sessions.filter("market = 'US'").orderBy(F.desc("session")).limit(2).collect()]
    days = spark.createDataFrame([("US", d) for d in last], "market string, session date")
    together = nights.compute(t.instruments, t.bars, t.resolutions, t.labels, days, None, t.params)
    single = []
    for d in last:
        upto = t.bars.filter(F.col("session") <= d)
        one = nights.compute(t.instruments, upto, t.resolutions, t.labels, spark.createDataFrame([("US", d)], "market string, session date"), None, t.params)
        single += map(str, one.ranks.collect())
    assert single and sorted(map(str, together.ranks.collect())) == sorted(single)


def test_stream_appends_once(spark, tmp_path):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "base")
    now = F.lit("2026-07-15 20:15:00").cast("timestamp")
    row = lambda d, c, v=5: ("US", "A", d, c, c, c, c, c, v)
    go = lambda: ingest.start(spark, raw, base, str(tmp_path / "check"), now).awaitTermination()
    spark.createDataFrame([row("2026-07-13", 1.0), row("2026-07-14", 2.0, 0), row("2026-07-15", 3.0)], RAW).write.parquet(raw)
    go()
    spark.createDataFrame([row("2026-07-13", 9.0), row("2026-07-14", 4.0)], RAW).write.mode("append").parquet(raw)
    go()
    got = {r["session"]: r["close"] for r in tables.read(spark, base, "bars").collect()}
    assert got == {date(2026, 7, 13): 1.0, date(2026, 7, 14): 4.0}


def test_chart_bundle(spark, market):
    days, df, who, labels = market
    day = days[104]
    night = nights.compute(who, df, outcomes(spark, days), labels, spark.createDataFrame([("US", day)], "market string, session date"), None, P)
    symbols = spark.createDataFrame([("US", "LEAD", day), ("US", "FLAT", day)], "market string, symbol string, as_of date")
    got = {r["symbol"]: r for r in chart.chart_bundle(df, symbols, night.detections, night.ranks, labels, P).collect()}
    lead, flat = got["LEAD"], got["FLAT"]
    assert len(lead["candles"]) == 105 and lead["candles"][-1]["session"] == day and len(lead["ema65"]) == 41 and len(lead["sma50"]) == 56
    assert flat["setup"] is None and flat["facts"] is None
    s = lead["setup"]
    assert s["trigger"] == 100.5 and s["cluster_start"] == days[98] and len(s["envelope"]) == lead["facts"]["base_len"] and s["envelope"][-1]["value"] <= s["trigger"]
    assert len(s["breakdown"]) == 8 and lead["facts"]["decile_ranks"]["3m"] == 1.0 and lead["facts"]["sector"] == "Energy"
    assert day - days[98] > timedelta(0)


def test_chart_keeps_the_last_bars(spark, market):
    days, df, _, _ = market
    none = spark.createDataFrame([], schemas.TABLES["detections"])
    symbols = spark.createDataFrame([("US", "FLAT", days[120])], "market string, symbol string, as_of date")
    out = chart.chart_rows(df, symbols, none, Params(chart_bars=30)).collect()
    assert len(out) == 30 and all(r["sma50"] is not None and not r["in_base"] for r in out)
