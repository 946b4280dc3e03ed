from datetime import date, datetime, timedelta

import pytest
from helpers import bars, rows, weekdays
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import calendar, labels, runs, tables
from tidemark.sources import bars as bar_source
from tidemark.sources import listings

DAY = date(2026, 7, 15)
RUNS = schemas.TABLES["runs"]


def run_rows(spark, *data):
    return spark.createDataFrame([("US", d, s, e, 90, datetime(2026, 1, 1)) for d, s, e in data], RUNS)


def test_keep_first_append(spark, tmp_path):
    base = str(tmp_path)
    first = bars(spark, rows("A", [1.0, 2.0]))
    tables.append_bars(spark, base, first)
    tables.append_bars(spark, base, bars(spark, rows("A", [9.0, 9.0, 3.0]), rows("B", [5.0])))
    got = {(r["symbol"], r["session"]): r["close"] for r in tables.read(spark, base, "bars").collect()}
    assert got == {("A", date(2026, 1, 1)): 1.0, ("A", date(2026, 1, 2)): 2.0, ("A", date(2026, 1, 3)): 3.0, ("B", date(2026, 1, 1)): 5.0}


def test_keep_first_within_a_batch(spark):
    both = bars(spark, rows("A", [1.0])).withColumn("delivery", F.lit(2)).unionByName(bars(spark, rows("A", [7.0])).withColumn("delivery", F.lit(1)))
    assert [r["close"] for r in tables.keep_first(both).collect()] == [7.0]


def test_append_once_and_discard(spark, tmp_path):
    base = str(tmp_path)
    members = spark.createDataFrame([("US", DAY, "A"), ("US", DAY, "B")], schemas.TABLES["universe"])
    tables.append_once(spark, base, "universe", members)
    with pytest.raises(ValueError):
        tables.append_once(spark, base, "universe", members)
    assert tables.discard_session(spark, base, "universe", "US", str(DAY)) == 2
    assert tables.discard_session(spark, base, "universe", "US", str(DAY)) == 0
    tables.append_once(spark, base, "universe", members)
    tables.append_once(spark, base, "runs", run_rows(spark, (DAY, "published", 100)))
    with pytest.raises(ValueError):
        tables.discard_session(spark, base, "universe", "US", str(DAY))


def test_readable_and_debris(spark):
    members = spark.createDataFrame([("US", DAY, "A"), ("US", DAY - timedelta(days=1), "A")], schemas.TABLES["universe"])
    known = run_rows(spark, (DAY, "published", 1))
    assert [r["session"] for r in tables.readable(members, known).collect()] == [DAY]
    assert [r["session"] for r in tables.debris(members, known).collect()] == [DAY - timedelta(days=1)]


def test_retention_clamps_leap_days(spark):
    days = [date(2024, 2, 29), date(2022, 2, 28), date(2022, 2, 27)]
    df = spark.createDataFrame([("US", d, "A", "1w", 1.0, 1.0) for d in days], schemas.TABLES["ranks"])
    assert {r["session"] for r in tables.retained(df).collect()} == set(days[:2])


def test_upsert(spark):
    old = spark.createDataFrame([("US", "A", "X", "I", DAY), ("US", "B", "Y", "J", DAY)], schemas.TABLES["labels"])
    new = spark.createDataFrame([("US", "B", "Z", None, DAY + timedelta(days=1)), ("US", "C", "W", "K", DAY)], schemas.TABLES["labels"])
    got = {r["symbol"]: (r["sector"], r["industry"]) for r in tables.upsert(old, new).collect()}
    assert got == {"A": ("X", "I"), "B": ("Z", "J"), "C": ("W", "K")}


def test_reconcile(spark):
    df = spark.createDataFrame([("US", DAY, "extra")], "market string, session date, more string")
    out = schemas.reconcile(df, "follow_through")
    assert out.columns == ["market", "session", "broke_out", "index_close", "more"] and out.first()["broke_out"] is None
    with pytest.raises(TypeError):
        schemas.reconcile(spark.createDataFrame([("US", "2026-07-15")], "market string, session string"), "follow_through")


def test_label_refresh(spark):
    names = [f"S{i:02}" for i in range(60)]
    cached = spark.createDataFrame([("US", s, "X", "I", DAY - timedelta(days=i)) for i, s in enumerate(names)], schemas.TABLES["labels"])
    members = spark.createDataFrame([("US", DAY, s) for s in [*names, "NEW", "MISS"]], schemas.TABLES["universe"])
    asked = {r["symbol"]: r["is_new"] for r in labels.to_fetch(members, cached).collect()}
    assert asked == {"S59": False, "S58": False, "NEW": True, "MISS": True}
    fetched = spark.createDataFrame([("US", s, st, "Z", "K", DAY) for s, st in (("S59", "resolved"), ("S58", "unresolved"), ("NEW", "resolved"), ("MISS", "unresolved"), ("S00", "resolved"))], "market string, symbol string, status string, sector string, industry string, as_of date")
    got = {r["symbol"]: r["sector"] for r in labels.refresh(members, cached, fetched).collect()}
    assert (got["S59"], got["S58"], got["NEW"], got["S00"], len(got)) == ("Z", "X", "Z", "X", 61)


def outcomes(spark, resolved, unresolved, refused=0):
    data = [("US", f"R{i}", DAY, "resolved") for i in range(resolved)] + [("US", f"U{i}", DAY, "unresolved") for i in range(unresolved)] + [("US", f"X{i}", DAY, "refused") for i in range(refused)]
    return spark.createDataFrame(data, "market string, symbol string, session date, status string")


@pytest.mark.parametrize(("counts", "before", "want"), [((99, 1, 50), None, "published"), ((98, 2, 0), None, "quarantined"), ((99, 1, 0), 111, "published"), ((99, 1, 0), 112, "quarantined")])
def test_run_gate(spark, counts, before, want):
    got = outcomes(spark, *counts)
    who = got.select("market", "symbol").withColumn("role", F.lit("candidate"))
    published = run_rows(spark, *([(DAY - timedelta(days=1), "published", before)] if before else []))
    r = runs.run_gate(who, got, published).first()
    assert (r["status"], r["symbols_enumerated"]) == (want, sum(counts[:2]))


def test_backfill_sessions(spark):
    days = weekdays(10)
    cal = spark.createDataFrame([("US", d) for d in days], "market string, session date")
    target = spark.createDataFrame([("US", days[9])], "market string, target date")
    done = run_rows(spark, (days[3], "published", 1), (days[5], "quarantined", 1))
    assert [r["session"] for r in calendar.to_backfill(done, cal, target).orderBy("session").collect()] == [days[4], *days[6:]]
    assert [r["session"] for r in calendar.to_backfill(done.limit(0), cal, target).collect()] == [days[9]]


def test_runs_summary(spark):
    members = spark.createDataFrame([("US", DAY, "A"), ("US", DAY, "B")], schemas.TABLES["universe"])
    known = run_rows(spark, (DAY, "published", 5), (DAY + timedelta(days=1), "quarantined", 5))
    r = runs.runs_summary(known, members, F.lit("2026-07-16 20:45:00").cast("timestamp")).first()
    assert (r["latest"]["session"], r["universe_size"], r["run_due"], r["stale"]) == (DAY, 2, True, True)


def test_listings(spark, tmp_path):
    one, two = tmp_path / "one.txt", tmp_path / "two.txt"
    one.write_text("Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\nAAA| A Corp |Q|N|N|100|N|N\nTST|Test|Q|Y|N|100|N|N\nFND|A Fund|G|N|N|100|Y|N\nBAD|x\nFile Creation Time: 0715202621:30|||||||\n")
    two.write_text("ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol\nBBB|B Corp|N|BBB|N|100|N|BBB\n")
    got = {(r["symbol"], r["role"], r["name"]) for r in listings.us_instruments(spark, str(one), str(two)).collect()}
    assert got == {("^IXIC", "reference", ""), ("AAA", "candidate", "A Corp"), ("FND", "reference", "A Fund"), ("BBB", "candidate", "B Corp")}
    idx = listings.idx_instruments(spark.createDataFrame([("BBCA.JK",)], "s string")).collect()
    assert {(r["symbol"], r["role"]) for r in idx} == {("^JKSE", "reference"), ("BBCA.JK", "candidate")}
    with pytest.raises(ValueError):
        listings.us_listing(spark.createDataFrame([("A|B",)], "value string"))


def test_parse_bars(spark):
    for value, kind in (("2026-07-15T00:00:00", "string"), (DAY, "date"), (datetime(2026, 7, 15, 4), "timestamp")):
        raw = spark.createDataFrame([("US", "A", value, 1.0, 2.0, 0.5, 1.5, 1.4, 7.0)], f"market string, symbol string, Date {kind}, Open double, High double, Low double, Close double, `Adj Close` double, Volume double")
        r = bar_source.parse_bars(raw).first()
        assert (r["session"], r["adj_close"], r["volume"]) == (DAY, 1.4, 7)
