"""Candidates that share a symbol: rows that stand for several give what these rows themselves would give."""

from datetime import date, timedelta
from itertools import product
from statistics import median

from helpers import bars, rows
from pyspark.sql import functions as F

from tidemark.operators import candidates, chart, copies, digest, ranks, universe
from tidemark.params import Params
from tidemark.streaming import members

DAY = date(2026, 3, 2)
PARAMS = Params(floors={"US": 1000.0}, window=4, density_min=3, density_recent=2, min_bars=3)


def instruments(spark, *names):
    return spark.createDataFrame([("US", s, "candidate", n) for s, n in names], "market string, symbol string, role string, name string")


def outcomes(spark, *found):
    return spark.createDataFrame([("US", s, d, x) for s, d, x in found], "market string, symbol string, session date, status string")


def bag(df):
    return sorted(map(str, df.collect()))


def members_of_rows(names, days, status, volumes):
    """symbol's (session, copies) by all rows of the grid one by one, peers in the order that shared_membership names."""
    p, placed, bars_, got, member = PARAMS, [], [], [], False
    for d in days:
        own = volumes.get(d, [])
        bars_ += own
        dv = median(bars_[-p.window :]) if bars_ else 0.0
        peers = list(product(names, status.get(d, [None]), own or [None]))
        signals = []
        for _ in peers:
            placed.append(1 if own else 0)
            dense = sum(placed[-p.window :]) >= p.density_min and max(placed[-p.density_recent :]) == 1
            signals.append(0 if len(bars_) < p.min_bars or not dense else 1 if dv >= 1000 else 0 if dv < p.exit_share * 1000 else None)
        if any(x in (None, "resolved") for x in status.get(d, [None])):
            settled = signals[-1] if any("Warrant" not in x for x in names) else 0
            if settled is None and (0 in signals or any("Warrant" in x for x in names)):
                settled = 0
            member = member if settled is None else settled == 1
        if member:
            got.append((d, len(peers)))
    return got


def shared_names(spark):
    """Names with one and with several candidates, outcomes and bars a session: (instruments, bars, outcomes), and their members row by row."""
    days = [DAY + timedelta(days=i) for i in range(14)]
    names = {"ONE": ["Corp"], "TWO": ["Corp", "Corp"], "MIX": ["Corp", "Corp Warrant"], "BAD": ["Warrant"], "FEW": ["Corp", "Corp"]}
    traded = {
        "ONE": {d: [1000.0] for d in days if d != days[6]}, "TWO": {d: [900.0, 1100.0] if i < 5 else [850.0] for i, d in enumerate(days) if i not in (7, 8)},
        "MIX": {d: [1200.0] if i < 8 else [900.0] for i, d in enumerate(days)}, "BAD": {d: [5000.0] for d in days}, "FEW": {d: [2000.0] for d in days[::3]},
    }
    status = {"ONE": {days[9]: ["unresolved"]}, "TWO": {d: ["resolved", "unresolved"] if i % 4 else ["unresolved", "refused"] for i, d in enumerate(days)}, "MIX": {}, "BAD": {}, "FEW": {}}
    series = [("US", s, d, 1.0, 1.0, 1.0, 1.0, 1.0, int(v)) for s, x in traded.items() for d, vs in x.items() for v in vs]
    df = bars(spark, series)
    who = instruments(spark, *[(s, n) for s, x in names.items() for n in x])
    found = outcomes(spark, *[(s, d, x) for s, by in status.items() for d, xs in by.items() for x in xs])
    return (who, df, found), {s: members_of_rows(names[s], days, status[s], traded[s]) for s in names}


def test_shared_symbols_by_rows(spark):
    (who, df, found), want = shared_names(spark)
    got = universe.counted(who, df, found, PARAMS)
    have = {s: sorted((r["session"], r["copies"]) for r in got.filter(F.col("symbol") == s).collect()) for s in want}
    assert have == want and want["ONE"] and want["TWO"] and want["MIX"] and not want["BAD"]
    assert universe.universe(who, df, found, PARAMS).count() == sum(n for x in want.values() for _, n in x)


def test_shared_symbols_in_a_stream(spark, tmp_path):
    (who, df, found), want = shared_names(spark)
    grid = members.grid(who, df, found, PARAMS).cache()
    days = sorted({r["session"] for r in grid.select("session").distinct().collect()})
    assert grid.count() == len(want) * len(days)  # a row for each symbol's session, however many share it
    raw, where, check = (str(tmp_path / x) for x in ("raw", "members", "check"))
    for a, b in ((4, 7), (5, 8), (8, 14)):
        grid.filter((F.col("session") >= days[a]) & (F.col("session") <= days[b - 1])).write.mode("append").parquet(raw)
        members.start_members(spark, raw, where, check, grid.filter(F.col("session") < days[4]), PARAMS, shared=True).awaitTermination()
    got = members.read(spark, where, members.SHARED_MEMBERS)
    assert bag(got.select("symbol", "session", "copies")) == bag(spark.createDataFrame([(s, d, n) for s, x in want.items() for d, n in x if d >= days[4]], "symbol string, session date, copies bigint"))


def test_one_candidate_a_symbol_is_as_before(spark):
    who, df = instruments(spark, ("A", "Corp"), ("B", "Corp Warrant")), bars(spark, *[rows(s, [10.0 + i % 5 for i in range(30)], volumes=[100 + 7 * i % 40 for i in range(30)]) for s in "AB"])
    found = outcomes(spark, ("A", date(2026, 1, 20), "unresolved"))
    prior = spark.createDataFrame([("US", "A")], "market string, symbol string")
    a, b = (f(who, df, found, PARAMS, prior) for f in (universe.shared_membership, universe.membership))
    assert bag(a.filter("copies = 1").select("symbol", "session", "signal", "member")) == bag(b.select("symbol", "session", "signal", "member"))
    assert universe.counted(who, df, found, PARAMS).columns == ["market", "session", "symbol"]


def shared(spark, n):
    """Ranks of three sessions, with copies."""
    some = [("US", DAY + timedelta(days=d), f"S{i}", x, 0.0, (i * 7 + d * 3) % 5 / 10, 1 + (i + d) % 4) for d, i, x in product(range(3), range(n), ("1w", "1m"))]
    got = spark.createDataFrame(some, "market string, session date, symbol string, lookback string, percentile double, raw_return double, copies bigint")
    return got.withColumn("percentile", F.lit(0.85) + F.col("raw_return") / 4)


def test_ranks_and_boards_with_copies(spark):
    df = bars(spark, *[rows(f"S{i}", [10.0 + (i + j) % 7 for j in range(40)], start=date(2026, 1, 1)) for i in range(9)])
    keys = df.filter("session > DATE '2026-01-30'").select("market", "session", "symbol").withColumn("copies", F.length("symbol") + F.substring("symbol", 2, 1).cast("bigint") % 3)
    for n in (10**6, 1):
        a, b = (ranks.ranks(x, df, Params(sorted_rows=n)) for x in (keys, copies.spread(keys)))
        assert bag(copies.spread(a)) == bag(b) and a.count() < b.count()
    got, params = shared(spark, 12), Params(board_size=10)
    each = copies.spread(got)
    assert bag(ranks.board_rows(got, params)) == bag(ranks.board_rows(each, params))
    assert bag(ranks.breadth_counts(got)) == bag(ranks.breadth_counts(each))
    assert bag(ranks.leaderboards(got, df, params)) == bag(ranks.leaderboards(each, df, params))


DETECTION = {
    "detector_version": 1, "trigger": 18.0, "stop": 1.0, "stopw_adr": 0.5, "base_len": 10, "move_gain": 50.0, "adr": 0.06, "close": 17.0, "cluster_k": 5, "cluster_high": 18.0, "cluster_low": 17.0,
    "cluster_range_adr": 1.0, "line_ok": True, "touch_zones": 2, "overshoot_adr": 0.0, "slope": -0.01, "line_end": 17.5, "base_low": 15.0, "churn_l": 0.4, "sma20_rising": True, "dryup": 0.9,
}


def detections(spark, *found):
    out = spark.createDataFrame(found, "market string, symbol string, session date, copies bigint")
    return out.select("market", "symbol", "session", *[F.lit(v).alias(k) for k, v in DETECTION.items()], "copies")


def test_scores_and_digest_with_copies(spark):
    """Each detection is scored and tested once: equal ones don't meet each other."""
    got = shared(spark, 6)
    det = detections(spark, ("US", "S1", DAY, 3), ("US", "S2", DAY, 1), ("US", "S1", DAY + timedelta(days=1), 2))
    labels = spark.createDataFrame([("US", "S1", "Energy", "Oil"), ("US", "S1", "Energy", "Gas"), ("US", "S2", "Energy", "Oil"), ("US", "S3", "Energy", "Oil")], "market string, symbol string, sector string, industry string")
    nights = got.select("market", "session").distinct()
    df = bars(spark, *[rows(s, [20.0] * 3, start=DAY) for s in ("S1", "S2")])
    each = copies.spread(det), copies.spread(got)
    assert bag(copies.spread(candidates.scored(det, got, labels))) == bag(candidates.scored(*each, labels)) and candidates.scored(*each, labels).count() == 11
    places = lambda x: bag(x.select("session", "position", "symbol", "score", "breadth"))
    assert places(candidates.candidates(det, got, labels)) == places(candidates.candidates(*each, labels))
    share = {r["symbol"]: r["sector_share"] for r in candidates.scored(det, got.withColumn("percentile", F.lit(0.95)), labels).collect()}
    assert share == {"S1": 1.0, "S2": 1.0}
    a, b = (digest.digest(*x, labels, nights) for x in ((det, df, got), (each[0], df, each[1])))
    told = lambda x: bag(x.select("session", "position", "symbol", "score", "repeat", "last_reported"))
    assert told(a) == told(b) and a.count() == 2 * 3 + 1 + 2 * 2


def test_charts_of_a_symbol_that_is_asked_for_twice(spark):
    df = bars(spark, rows("S1", [10.0 + i % 4 for i in range(90)], start=DAY - timedelta(days=89)), rows("S2", [10.0 + i % 3 for i in range(90)], start=DAY - timedelta(days=89)))
    det = detections(spark, ("US", "S1", DAY, 3))
    ask = lambda *s: spark.createDataFrame([("US", x, DAY) for x in s], "market string, symbol string, as_of date")
    params = Params(chart_bars=50)
    once = copies.spread(chart.chart_rows(df, ask("S1", "S2"), det, params))
    assert once.groupBy("symbol").count().orderBy("symbol").collect() == [("S1", 150), ("S2", 50)]
    twice = copies.spread(chart.chart_rows(df, ask("S1", "S2", "S2"), det, params)).filter("symbol = 'S2'")
    want = once.filter("symbol = 'S2' AND back < 25").select("session", "close", "ema65", "sma10")
    assert bag(twice.select("session", "close", "ema65", "sma10")) == bag(want.union(want))
    assert sorted(r["back"] for r in twice.collect()) == list(range(50))
    bundle = chart.chart_bundle(df, ask("S1", "S2"), det, shared(spark, 3), spark.createDataFrame([("US", "S1", "Energy", "Oil")], "market string, symbol string, sector string, industry string"), params)
    n = {r["symbol"]: (r["copies"], len(r["candles"]), r["facts"] and r["facts"]["sector"]) for r in bundle.collect()}
    assert n == {"S1": (3 * 2, 150, "Energy"), "S2": (3, 50, None)}
