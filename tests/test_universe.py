import random
from datetime import date, timedelta

import pytest
from helpers import bars, rows, weekdays
from pyspark.sql import functions as F

from tidemark.operators import hygiene, universe
from tidemark.params import Params

P = Params(floors={"US": 1000.0, "IDX": 1000.0})
DAYS = weekdays(40)


def members(spark, groups, status=(), names=None, params=P, prior=None):
    df = bars(spark, *groups)
    who = sorted({(r[0], r[1]) for g in groups for r in g})
    instruments = spark.createDataFrame([(m, s, "candidate", (names or {}).get(s, "Corp")) for m, s in who], "market string, symbol string, role string, name string")
    outcomes = spark.createDataFrame([("US", s, d, x) for s, d, x in status], "market string, symbol string, session date, status string")
    return {(r["symbol"], r["session"]) for r in universe.universe(instruments, df, outcomes, params, prior).collect()}


def series(symbol, days, value):
    """Bars whose dollar volume is the given one, or one for each day."""
    v = value if isinstance(value, list) else [value] * len(days)
    return rows(symbol, [10.0] * len(days), days=days, volumes=[int(x / 10) for x in v])


def test_hysteresis(spark):
    fine = series("X", DAYS, 5000)
    got = members(spark, [fine, series("LOW", DAYS, 900), series("WAS", DAYS, [1100] * 22 + [900] * 18), series("OUT", DAYS, [1100] * 22 + [700] * 18)])
    last = DAYS[-1]
    assert ("X", last) in got and ("LOW", last) not in got and ("WAS", last) in got
    assert ("OUT", DAYS[21]) in got and ("OUT", last) not in got


def test_sticky_suspended_young_and_warrant(spark):
    last = DAYS[-1]
    groups = [series("X", DAYS, 5000), series("HELD", DAYS, [5000] * 30 + [10] * 10), series("GONE", DAYS[:-4], 5000), series("NEAR", DAYS[:-3], 5000), series("YOUNG", DAYS[-19:], 5000), series("WAR", DAYS, 5000)]
    status = [("HELD", d, "unresolved") for d in DAYS[25:]]
    got = members(spark, groups, status, {"WAR": "Acme Warrant"})
    assert {s for s, d in got if d == last} == {"X", "HELD", "NEAR"}


def test_density_16_of_20(spark):
    fine = series("X", DAYS, 5000)
    gaps = lambda n: [d for d in DAYS if d not in DAYS[-19 : -19 + n]]
    got = members(spark, [fine, series("S16", gaps(4), 5000), series("S15", gaps(5), 5000)])
    assert {s for s, d in got if d == DAYS[-1]} == {"X", "S16"}


def test_a_prior_state_holds_until_a_signal(spark):
    prior = spark.createDataFrame([("US", "Y")], "market string, symbol string")
    status = [("Y", d, "unresolved") for d in DAYS] + [("Z", d, "unresolved") for d in DAYS]
    got = members(spark, [series("Y", DAYS, 5000), series("Z", DAYS, 5000)], status, prior=prior)
    assert {s for s, _ in got} == {"Y"} and len(got) == len(DAYS)


def test_membership_equals_the_recursion(spark):
    rng = random.Random(5)
    days = weekdays(90)
    values = {s: [rng.choice([600, 700, 850, 950, 1050, 1500]) for _ in days] for s in ("A", "B", "C", "D")}
    status = [(s, d, "unresolved") for s in values for d in days if rng.random() < 0.2]
    p = Params(floors={"US": 1000.0}, window=3, density_min=3, min_bars=3)
    got = members(spark, [series(s, days, v) for s, v in values.items()], status, params=p)
    missed = {(s, d) for s, d, _ in status}
    for s, v in values.items():
        was = False
        for i, d in enumerate(days):
            if (s, d) not in missed:
                seen = sorted(v[max(0, i - 2) : i + 1])
                was = i >= 2 and len(seen) == 3 and seen[1] >= 1000 * (0.8 if was else 1.0)
            assert ((s, d) in got) == was


@pytest.mark.parametrize(
    ("name", "keeps"),
    [
        ("", True), ("Corp - Common Stock", True), ("Beta American Depositary Shares", True), ("Unity Software Inc.", True), ("Bondholder Corp", True), ("Acme Warrant", False),
        ("Acme Corp. Rights", False), ("Acme Units", False), ("5% Notes due 2030", False), ("Acme PREFERRED Series A", False), ("Acme Pfd", False), ("Realty Trust", False), ("Growth Fund", False),
    ],
)
def test_names(spark, name, keeps):
    assert spark.range(1).select(hygiene.is_common_stock(F.lit(name))).first()[0] is keeps


def test_phantoms_and_finality(spark):
    df = bars(spark, rows("A", [1.0, 2.0, 3.0], start=date(2026, 7, 13), volumes=[5, 0, 5]))
    got = [r["session"] for r in hygiene.clean(df, F.lit("2026-07-15 20:15:00").cast("timestamp")).collect()]
    assert got == [date(2026, 7, 13)]
    assert timedelta(0) == got[0] - date(2026, 7, 13)


def test_sessions_of_candidates_are_made_by_all_tasks(spark):
    """A small file of instruments is one partition; its rows, one for each session, aren't one task's."""
    df = bars(spark, *[series(f"S{i}", DAYS, 5000) for i in range(60)])
    who = spark.createDataFrame([("US", f"S{i}", "candidate", "Corp") for i in range(60)], "market string, symbol string, role string, name string").coalesce(1)
    got = universe.candidate_sessions(who, df).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in got) == 60 * len(DAYS) and len(got) == spark.sparkContext.defaultParallelism
