from datetime import date, timedelta

import numpy as np
import pytest
from helpers import bars, rows

from tidemark.operators import detection, ranks
from tidemark.params import Params

START = date(2026, 1, 1)
FLAT = (50.5, 49.5, 50.0)


def textbook():
    run_up = [(50 + 49 * i / 14 + 0.5, 50 + 49 * i / 14 - 0.5, 50 + 49 * i / 14) for i in range(15)]
    return [FLAT] * 60 + run_up + [(100.5, 99.5, 100.0)] * 30


def detect(spark, series, volumes=None):
    """The detection of a name that passes the decile gate, as of its last bar."""
    df = bars(spark, rows("A", series, START, volumes=volumes))
    day = START + timedelta(days=len(series) - 1)
    members = spark.createDataFrame([("US", day, "A")], "market string, session date, symbol string")
    ranked = spark.createDataFrame([("US", day, "A", "1m", 1.0, 0.5)], "market string, session date, symbol string, lookback string, percentile double, raw_return double")
    return detection.detections(members, ranked, df).first()


def test_textbook_base(spark):
    d = detect(spark, textbook())
    assert (d["cluster_k"], d["base_len"], d["trigger"], d["cluster_high"], d["stop"], d["line_ok"]) == (7, 30, 100.5, 100.5, 1.0, True)
    assert d["churn_l"] == pytest.approx(1.0) and d["dryup"] == pytest.approx(1.0)
    assert d["slope"] <= 0 and d["line_end"] <= d["trigger"] and d["detector_version"] == 1


def test_piercing_bar(spark):
    series = textbook()
    series[80] = (120.0, 99.5, 100.0)
    d = detect(spark, series)
    assert d["base_len"] == 25 and not d["line_ok"] and d["overshoot_adr"] > 1.0


def test_too_short_not_caught_up_no_cluster(spark):
    assert detect(spark, [FLAT] * 50) is None
    assert detect(spark, [FLAT] * 100 + [(x + 0.5, x - 0.5, x) for x in (110.0, 120.0, 130.0)]) is None
    assert detect(spark, [FLAT] * 90 + [(x + 0.5, x - 0.5, x) for x in (60.0, 55.0, 62.0, 54.0, 63.0, 56.0, 61.0)]) is None


def test_dry_up(spark):
    volumes = [100] * 75 + [40] * 30
    assert detect(spark, textbook(), volumes)["dryup"] == pytest.approx(0.4)


def test_history_takes_81_bars(spark):
    series = textbook()
    assert detect(spark, series[24:]) is not None
    assert detect(spark, series[25:]) is None


def test_gates(spark):
    data = [("WEEK", "1w", 1.0), ("OLD", "12m", 1.0), ("REAL", "3m", 0.95), ("AT", "6m", 0.90), ("UNDER", "1m", 0.89)]
    r = spark.createDataFrame([("US", START, s, x, p, 0.1) for s, x, p in data], "market string, session date, symbol string, lookback string, percentile double, raw_return double")
    assert {x["symbol"] for x in ranks.detection_gate(r).collect()} == {"REAL", "AT"}
    assert {x["symbol"] for x in ranks.decile_gate(r).collect()} == {"WEEK", "OLD", "REAL", "AT"}


def brute_fit(high, adr_abs, anchor, k, p=Params()):
    """The grid search, bar by bar."""
    top, base = high[0], high[1:]
    best = None
    for s in range(p.slopes):
        m = -p.max_slope * adr_abs * (1 - s / (p.slopes - 1))
        loss = round(sum(3 * g if g > 0 else -g for g in (h - (top + m * (t - anchor)) for t, h in enumerate(base))), 9)
        if best is None or loss < best[0]:
            best = loss, m
    m = best[1]
    gaps = [h - (top + m * (t - anchor)) for t, h in enumerate(base)]
    touches = [t for t, g in enumerate(gaps) if abs(g) <= 0.35 * adr_abs and t < len(base) - k]
    zones = (1 + sum(b - a >= 3 for a, b in zip(touches, touches[1:], strict=False))) if touches else 0
    over = max([g / adr_abs for g in gaps if g > 0.35 * adr_abs], default=0.0)
    ok = (zones >= 2 or (zones >= 1 and touches[0] <= 0.6 * len(base))) and over <= 1.0
    return m, ok, zones, over, top + m * (len(base) - anchor)


def test_fit_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rng.integers(3, 46)), int(rng.integers(3, 8))
        high = 100 + np.round(rng.normal(0, 3, n).cumsum() * rng.random(), 4)
        cluster = high[-k:]
        anchor = max(0, n - k) + int(cluster.argmax())
        got = detection.fit_envelope(np.r_[cluster.max(), high], 2.5, anchor, k)
        want = brute_fit([float(cluster.max()), *high.tolist()], 2.5, anchor, k)
        assert got[1:3] == want[1:3]
        assert got == pytest.approx(want, abs=1e-9)


def test_last_slope_is_plain_zero():
    slope = detection.fit_envelope(np.array([10.0, 1.0, 10.0, 10.0, 10.0]), 1.0, 1, 3)[0]
    assert str(slope) in ("0.0",) or slope < 0


def brute_run_up(series, i, n):
    """low, its place, the highest high from there on and its place; the first of each."""
    span = series[max(0, i - n + 1) : i + 1]
    start = i - len(span) + 1
    at = min(range(len(span)), key=lambda j: (span[j][1], j))
    peak = min(range(at, len(span)), key=lambda j: (-span[j][0], j))
    top = min(range(len(span)), key=lambda j: (-span[j][0], j))
    return span[at][1], start + at, span[peak][0], start + peak, start + top


def test_run_ups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    groups = {}
    for name, n, top in (("TIES", 300, 4), ("WIDE", 260, 400), ("FEW", 7, 9), ("ONE", 1, 9), ("FLAT", 150, 1)):
        low = rng.integers(1, top + 1, n)
        groups[name] = [(float(x + rng.integers(0, top)), float(x), float(x)) for x in low]
    sizes = {"a": 1, "b": 2, "c": 22, "d": 45, "e": 64, "f": 127}
    df = detection.ind.numbered(bars(spark, *[rows(s, x, START) for s, x in groups.items()]))
    got = detection.run_ups(df, sizes).collect()
    assert len(got) == sum(map(len, groups.values()))
    for r in got:
        for name, n in sizes.items():
            x = r[name]
            assert (x["low"], x["at"], x["peak"]["high"], -x["peak"]["back"], -x["top"]["back"]) == brute_run_up(groups[r["symbol"]], r["idx"], n), (r["symbol"], r["idx"], n)


def test_bars_of_bases_are_bounded(spark):
    p = Params()
    reach = p.base_max + p.dryup_bars
    series = [float(i + 1) for i in range(4 * reach)]
    df = detection.ind.numbered(bars(spark, rows("A", series, START), rows("B", series[:3], START)))
    wanted = df.filter(df["idx"].isin(0, 2, reach - 1, reach, 2 * reach + 7)).selectExpr("market", "symbol", "session", "idx", "greatest(idx - 2, 0) AS base_start")
    got = {(r["symbol"], r["idx"]): ([x["idx"] for x in r["win"]], [x["idx"] for x in r["base"]]) for r in detection.with_bars(wanted, df, p).collect()}
    ends = [("A", i) for i in (0, 2, reach - 1, reach, 2 * reach + 7)] + [("B", 0), ("B", 2)]
    assert got == {(s, i): (list(range(max(0, i - reach + 1), i + 1)), list(range(max(0, i - 2), i + 1))) for s, i in ends}


def test_one_sort_for_gates_and_run_ups(spark):
    """Bars are exchanged by symbol once, and sorted once, for all of the window columns."""
    plan = detection.bar_gates(bars(spark, rows("A", textbook(), START)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_fits_together_equal_fits_one_by_one():
    r, p = np.random.default_rng(1), Params()
    bases = []
    for i in range(400):
        n, k = int(r.integers(3, 46)), int(r.integers(3, 8))
        high = np.full(n + 1, 9.5) if i % 7 == 0 else np.round(100 + np.cumsum(r.normal(0, 1.5, n + 1)), 4)
        bases.append((high, round(float(r.uniform(0.2, 4)), 4), int(n - r.integers(1, k + 1)), k))
    high, adr_abs, anchor, k = zip(*bases, strict=True)
    got = detection.fit_envelopes(list(high), np.array(adr_abs), np.array(anchor), np.array(k), p)
    assert [tuple(x) for x in got.itertuples(index=False)] == [detection.fit_envelope(*x, p) for x in bases]
    assert len(detection.fit_envelopes([], np.array([]), np.array([]), np.array([]), p)) == 0


def test_bars_of_bases_are_cut_not_searched(spark):
    """The rows are computed once, and no function is called for each bar of an array to find those of a base."""
    df = bars(spark, rows("A", textbook(), START))
    base = detection.base_span(detection.bar_gates(df).filter("passes AND move IS NOT NULL"))
    out = detection.with_bars(base, df.selectExpr("*", "0 AS idx"))
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "slice(" in plan and " filter(" not in plan and "Window" not in plan


def test_moves_of_few_rows_equal_those_of_every_bar(spark):
    rng, p = np.random.default_rng(7), Params()
    series = {name: [(float(x + rng.integers(0, top)), float(x), float(x)) for x in rng.integers(0, top + 1, n)] for name, n, top in (("TIES", 300, 4), ("WIDE", 260, 400), ("FEW", 4, 9), ("SIX", 6, 9))}
    df = detection.ind.numbered(bars(spark, *[rows(s, x, START) for s, x in series.items()]))
    want = detection.prior_move(df, p).selectExpr("symbol", "idx", "move.gain AS gain", "move.peak AS peak", "recent").collect()
    got = detection.moves(detection.last_bars(df.select("market", "symbol", "session", "idx"), df, 127), p).selectExpr("symbol", "idx", "move.gain AS gain", "move.peak AS peak", "recent").collect()
    assert len(want) == 570 and set(got) == set(want)


def test_run_ups_of_detections_are_those_of_few_rows(spark):
    """No bar that isn't gated and passing has its run-ups computed: the windows of detections have no doubled spans."""
    plan = detection.cheap_gates(bars(spark, rows("A", textbook(), START)))._jdf.queryExecution().executedPlan().toString()
    assert "_up1" not in plan and "_move" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_stages_are_compiled_by_parts(spark):
    from tidemark.queries import Tables
    from tidemark.sources.shared import LIMIT

    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "65535")
        Tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(LIMIT) == "8000"
    finally:
        spark.conf.set(LIMIT, before)


def test_order_tables_are_read_once_for_bars(spark):
    from tidemark.sources import derived

    got = derived.bars(spark, "/root/testdata/sf0.001")
    assert "l_suppkey" not in got._jdf.queryExecution().optimizedPlan().toString() and got.filter("symbol LIKE '^%'").count() > 0


def test_only_bars_that_pass_are_sorted_with_sessions(spark):
    rng = np.random.default_rng(11)
    days = sorted(int(x) for x in rng.choice(400, 150, replace=False))
    data = [("US", s, START + timedelta(days=d), i, 1.0, 1.0, float(d), (7, 1.0, 1.0, 1.0), True, bool(rng.random() < 0.4)) for s in "ABC" for i, d in enumerate(days)]
    gates = spark.createDataFrame(data, "market string, symbol string, session date, idx int, adr double, adr_abs double, close double, cluster struct<k:int,high:double,low:double,range_adr:double>, sma20_rising boolean, passes boolean")
    gated = spark.createDataFrame([("US", s, START + timedelta(days=d)) for s in "ABCD" for d in range(410)], "market string, symbol string, session date")
    own = {(x[1], x[2]): x for x in data}
    want = {}
    for s in "ABC":
        last = None
        for d in range(410):
            day = START + timedelta(days=d)
            last = own.get((s, day), last)
            if last and last[-1]:
                want[s, day] = last[6]
    got = detection.passing(gates, gated)
    assert {(r["symbol"], r["session"]): r["close"] for r in got.collect()} == want and 300 < len(want) < 900
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "passes" in plan[plan.index("Union") :] and "passes" not in plan[: plan.index("Union")]
