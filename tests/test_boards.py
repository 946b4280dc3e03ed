import random
from datetime import date, timedelta

import pytest
from helpers import bars, rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import acceptance, candidates, digest, indicators, ranks, regime, sectors
from tidemark.params import DIMENSIONS, Params

DAY = date(2026, 7, 15)
RANKS = "market string, session date, symbol string, lookback string, percentile double, raw_return double"
LABELS = "market string, symbol string, sector string, industry string, as_of date"
DET = {
    "detector_version": 1, "trigger": 17.88, "stop": 1.0, "stopw_adr": 0.5, "base_len": 14, "move_gain": 50.0, "adr": 0.05, "close": 17.0, "cluster_k": 5, "cluster_high": 17.88,
    "cluster_low": 16.0, "cluster_range_adr": 1.0, "line_ok": True, "touch_zones": 2, "overshoot_adr": 0.0, "slope": 0.0, "line_end": 17.0, "base_low": 15.0, "churn_l": 0.45, "sma20_rising": True, "dryup": 0.95,
}


def detections(spark, *changes):
    from tidemark import schemas

    wanted = schemas.schema("detections")
    return spark.createDataFrame([tuple(({"market": "US", "symbol": "A", "session": DAY} | DET | c)[n] for n in wanted.names) for c in changes], wanted)


def ranked(spark, data):
    return spark.createDataFrame([("US", d, s, x, float(p), float(r)) for d, s, x, p, r in data], RANKS)


def labelled(spark, sector_of, industry="Ind"):
    return spark.createDataFrame([("US", s, x, industry, DAY) for s, x in sector_of.items()], LABELS)


def test_percentiles_and_young_names(spark):
    days = [DAY - timedelta(days=400 - i) for i in range(401)]
    old = [rows(f"S{i}", [100.0] * 400 + [100.0 + i], days=days) for i in range(1, 11)]
    df = bars(spark, *old, rows("NEW", [100.0] * 10, days=days[-10:]))
    keys = df.filter(F.col("session") == DAY).select("market", "session", "symbol")
    got = ranks.ranks(keys, df)
    one = {r["symbol"]: r["percentile"] for r in got.filter("lookback = '12m'").collect()}
    assert one["S10"] == 1.0 and one["S1"] == 0.1 and one["S5"] == 0.5 and "NEW" not in one
    assert [r["lookback"] for r in got.filter("symbol = 'NEW'").collect()] == ["1w"]


def test_top_thirty_surge_and_new(spark):
    yesterday = [(DAY - timedelta(days=1), f"S{i:02}", "1w", 0.5, i / 100) for i in range(20)]
    today = [(DAY, f"S{i:02}", "1w", 0.5, i / 100) for i in range(40)] + [(DAY, "S01", "1m", 0.5, 0.3)]
    got = ranks.leaderboards(ranked(spark, yesterday + today), bars(spark, rows("S39", [10.0])))
    week = {r["symbol"]: r for r in got.filter((F.col("session") == DAY) & (F.col("lookback") == "1w")).collect()}
    assert len(week) == 30 and week["S39"]["rank"] == 1 and "S09" not in week
    assert week["S30"]["surge"] and not week["S29"]["surge"] and week["S39"]["is_new"] and not week["S15"]["is_new"]
    month = got.filter("lookback = '1m'").first()
    assert month["is_new"] and not month["surge"]


def test_sector_board(spark):
    data = [(DAY, s, x, 0.95 if (s, x) == ("A", "1w") else 0.2, 0.1) for s in "ABCD" for x in ("1w", "6m")]
    got = {r["sector"]: r for r in sectors.sector_board(ranked(spark, data), labelled(spark, dict.fromkeys("ABCD", "Energy"))).collect()}
    assert len(got) == 11
    e = got["Energy"]
    assert (e["members"], e["decile_counts"]["1w"], e["shares"]["1w"], e["shape_differential"], e["temporal_delta"], e["rotation_eligible"]) == (4, 1, 0.25, 0.25, None, False)
    assert got["Utilities"]["members"] == 0 and e["position"] == 1


def test_temporal_delta(spark):
    days = [DAY - timedelta(days=20 - i) for i in range(21)]
    data = [(d, s, "1m", 0.95 if s in ("A" if d == days[0] else "ABC") else 0.1, 0.1) for d in days for s in "ABCD"]
    got = sectors.sector_board(ranked(spark, data), labelled(spark, dict.fromkeys("ABCD", "Energy"))).filter("sector = 'Energy'")
    assert got.filter(F.col("session") == DAY).first()["temporal_delta"] == pytest.approx(0.5)
    assert got.filter(F.col("session") < DAY).filter("temporal_delta IS NOT NULL").count() == 0


def test_leave_one_out(spark):
    data = [(DAY, s, "1m", 0.95 if s in "AB" else 0.1, 0.1) for s in "ABCDE"]
    got = {r["symbol"]: r["share"] for r in sectors.leave_one_out(ranked(spark, data), labelled(spark, {"A": "X", "B": "X", "C": "X", "D": "Y", "E": ""})).collect()}
    assert got == {"A": 0.5, "B": 0.5, "C": 1.0, "D": 0.0}


def shares_of(df):
    return sorted((r["g"], str(r["v"]), r["n"], r["percentile"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_by_ranges_equal_those_of_a_window(spark, seed):
    rng = random.Random(seed)
    odd = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1e300, -1e300, 5e-324, 0.1, 0.1 + 2**-40]
    data = [("big", rng.choice(odd) if rng.random() < 0.2 else rng.gauss(0, 0.3) if rng.random() < 0.5 else 0.5 + rng.random() * 2**-21, i) for i in range(3000)]
    data += [("ties", 0.25, i) for i in range(500)] + [("one", -3.0, 0)]
    df = spark.createDataFrame(data, "g string, v double, n int").repartition(4)
    want = df.withColumn("percentile", F.cume_dist().over(Window.partitionBy("g").orderBy("v")))
    assert shares_of(ranks.spread_cume_dist(df, ["g"], "v")) == shares_of(want)
    assert ranks.spread_cume_dist(df.limit(0), ["g"], "v").count() == 0


def test_large_sessions_are_ranked_alike(spark):
    series = bars(spark, *[rows(f"S{i:03}", [100.0] * 10 + [100.0 + i % 40] * 10) for i in range(120)])
    members = series.select("market", "session", "symbol")
    a, b = (ranks.ranks(members, series, Params(sorted_rows=n)) for n in (10**6, 100))
    assert "cume_dist" in plan_of(a) and "cume_dist" not in plan_of(b)
    assert a.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tasks_send_the_best_of_their_rows_only(spark):
    df = spark.createDataFrame([("US", DAY, "A", "1w", 1.0, 0.1)], RANKS)
    assert "Partial" in plan_of(ranks.board_rows(df)) and "WindowGroupLimit" in plan_of(ranks.board_rows(df))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stars(spark, change, prior=True, share=0.10):
    score, rows_ = candidates.star_score(F.lit(prior), F.lit(share))
    r = detections(spark, change).select(score.alias("s"), rows_.alias("b")).first()
    assert [(x["dimension"], x["weight"]) for x in r["b"]] == list(DIMENSIONS)
    assert sum(x["weight"] for x in r["b"] if x["hit"]) / 2 == r["s"]
    return r["s"]


def test_score_thresholds(spark):
    assert stars(spark, {}) == 5.0
    assert stars(spark, {"cluster_k": 4, "churn_l": 0.61, "base_len": 15, "sma20_rising": False, "dryup": 0.951, "adr": 0.049}, False, 0.099) == 0.0
    for change, lost in (({"cluster_k": 4}, 1), ({"churn_l": 0.299}, 1), ({"churn_l": 0.60}, 0), ({"churn_l": 0.30}, 0), ({"base_len": 15}, 0.5), ({"dryup": 0.96}, 0.5), ({"adr": 0.049}, 0.5)):
        assert stars(spark, change) == 5.0 - lost


def test_candidate_order(spark):
    det = detections(spark, {"symbol": "B"}, {"symbol": "A", "line_ok": False}, {"symbol": "C"}, {"symbol": "LOW", "cluster_k": 3, "stopw_adr": 1.01})
    got = candidates.candidates(det, ranked(spark, [(DAY, "C", "1m", 0.95, 0.1)]), labelled(spark, {"C": "X"})).orderBy("position").collect()
    assert [r["symbol"] for r in got] == ["C", "B", "A", "LOW"]
    assert [r["affordable"] for r in got] == [True, True, True, False] and got[0]["breadth"] == 1 and got[1]["industry"] is None


def test_digest_and_report(spark):
    tomorrow = DAY + timedelta(days=1)
    det = detections(spark, {"symbol": "A"}, {"symbol": "B", "trigger": 20.0}, {"symbol": "GONE"})
    df = bars(spark, rows("A", [(18.2, 17.0, 18.04)], start=tomorrow), rows("B", [(20.0, 19.0, 20.0)], start=tomorrow))
    nights = spark.createDataFrame([("US", tomorrow), ("US", DAY)], "market string, session date")
    reported = spark.createDataFrame([("US", DAY - timedelta(days=9), "A")], "market string, session date, symbol string")
    out = digest.digest(det, df, ranked(spark, [(DAY, "A", "1m", 0.95, 0.1)]), labelled(spark, {"A": "X"}), nights, reported)
    r = out.collect()
    assert len(r) == 1 and r[0]["symbol"] == "A" and r[0]["pct_through"] == pytest.approx((18.04 - 17.88) / 17.88 * 100)
    assert r[0]["stopw_adr"] == pytest.approx((17.88 - 17.0) / 17.88 / 0.05) and r[0]["repeat"] and r[0]["last_reported"] == DAY - timedelta(days=9)
    text = {x["session"]: x["text"] for x in digest.report(out, nights).collect()}
    assert "No breaks tonight." in text[DAY] and "| A | 4.5★ | Ind | 0.98 | 18.04 | 17.88 | +0.89% | ↺ last reported 2026-07-06 |" in text[tomorrow]


def test_quiet_nights_leave_triggers_live(spark):
    later = DAY + timedelta(days=5)
    nights = spark.createDataFrame([("US", later)], "market string, session date")
    got = digest.breaks(detections(spark, {}), bars(spark, rows("A", [(18.2, 17.0, 18.04)], start=later)), nights)
    assert got.first()["before"] == DAY


@pytest.mark.parametrize(
    ("closes", "want"),
    [(range(1, 31), "FRIENDLY"), (range(60, 30, -1), "HOSTILE"), ([50] * 30, "CHOPPY"), (range(1, 25), None), ([50 + 1e-6 * i for i in range(30)], "FRIENDLY")],
)
def test_regime(spark, closes, want):
    df = bars(spark, rows("^IXIC", [float(x) for x in closes]))
    r = regime.regime_states(df).orderBy(F.desc("session")).first()
    assert r["state"] == want
    assert r["posture"] == regime.POSTURE.get(want)


def test_breadth_and_follow_through(spark):
    days = 30
    up, down, young = rows("UP", [float(x) for x in range(1, days + 1)]), rows("DN", [float(x) for x in range(60, 60 - days, -1)]), rows("NEW", [5.0], start=date(2026, 1, 30))
    df = bars(spark, up, down, young, rows("^IXIC", [10.0] * 20 + [11.0] + [11.0] * 9))
    day = date(2026, 1, 30)
    members = spark.createDataFrame([("US", day, s) for s in ("UP", "DN", "NEW", "NONE")], "market string, session date, symbol string")
    assert regime.breadth(members, df).first()["breadth"] == 0.25
    ft = {r["session"]: r["broke_out"] for r in regime.follow_through(df).collect()}
    assert ft[date(2026, 1, 20)] is None and ft[date(2026, 1, 21)] is True and ft[date(2026, 1, 22)] is False


def test_acceptance_deviation(spark):
    ask = lambda m, e: spark.range(1).select(acceptance.deviates(F.lit(m), F.lit(e).cast("double"))).first()[0]
    assert [ask(110.0, 100), ask(110.1, 100), ask(0.0, 0), ask(0.1, 0), ask(5.0, None)] == [False, True, False, True, False]
    members = spark.createDataFrame([("US", DAY, s) for s in ("BABA", "SE", "X")], "market string, session date, symbol string")
    got = {r["symbol"] for r in acceptance.spot_check(members).filter("present").collect()}
    assert got == {"BABA", "SE"} and acceptance.spot_check(members).count() == 12
    assert Params().board_size == 30


def test_report_files(spark, tmp_path):
    nights = spark.createDataFrame([("US", DAY), ("IDX", DAY)], "market string, session date")
    none = digest.digest(detections(spark, {}).limit(0), bars(spark, rows("A", [1.0])), ranked(spark, [(DAY, "A", "1m", 0.1, 0.1)]), labelled(spark, {"A": "X"}), nights)
    digest.write_report(digest.report(none, nights), str(tmp_path / "digests"))
    files = list((tmp_path / "digests" / "market=US" / "session=2026-07-15").glob("*.txt"))
    text = files[0].read_text()
    assert len(files) == 1 and text.startswith("# US digest — 2026-07-15\n\n") and text.endswith("\nNo breaks tonight.\n")


def test_boards_of_returns_equal_those_of_ranks(spark):
    rng, data = random.Random(3), []
    for day, n in ((date(2026, 1, 5), 400), (date(2026, 1, 6), 31), (date(2026, 1, 7), 7)):
        for lookback, odd in (("1w", [0.0, -0.0, 0.5]), ("1m", [float("inf"), float("nan"), -1.0]), ("12m", [2.0] * 3)):
            values = [rng.choice([rng.gauss(0, 0.4), round(rng.gauss(0, 0.4), 1), *odd]) for _ in range(n)]
            data += [("US", f"S{i:03d}", day, lookback, x) for i, x in enumerate(values)]
    data += [("IDX", f"S{i}", date(2026, 1, 5), "1w", 0.25) for i in range(50)]  # all alike
    returns = spark.createDataFrame(data, "market string, symbol string, session date, lookback string, raw_return double")
    share = F.cume_dist().over(Window.partitionBy("market", "session", "lookback").orderBy("raw_return"))
    want = ranks.board_rows(returns.withColumn("percentile", share)).select("market", "session", "symbol", "lookback", "percentile", "raw_return", "rank")
    got = ranks.boards(returns)
    assert got.columns == want.columns
    text = lambda df: sorted(str(tuple(x)).replace("-0.0,", "0.0,") for x in df.collect())
    assert text(got) == text(want) and len(text(got)) == 3 * (30 + 30 + 7) + 30


def test_bars_are_sorted_once_for_returns_and_no_group_for_boards(spark):
    day = date(2026, 1, 5)
    df = spark.createDataFrame([("US", f"S{i}", day + timedelta(days=7 * k), 1.0 + i * k) for i in range(3) for k in range(60)], "market string, symbol string, session date, adj_close double")
    returns = indicators.calendar_returns(df)
    plan = lambda x: x._jdf.queryExecution().sparkPlan().toString()
    assert plan(returns).count("Window [") == 1 and "Union" not in plan(returns)
    assert plan(indicators.calendar_returns(df, df.select("market", "symbol", "session"))).count("Window [") == 1
    assert "cume_dist" not in plan(ranks.boards(returns))
    keyed = indicators.calendar_returns(df, df.select("market", "symbol", "session"))
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, returns.collect())) and returns.count() > 500
