"""Sessions are published whole or not at all, and nights go on from what earlier ones have left."""

import threading
from datetime import date

import pytest
from helpers import bars, rows, weekdays
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import tables
from tidemark.params import Params
from tidemark.plans import nights
from tidemark.sources import files, versions

DAY = date(2026, 7, 15)
READ = ("runs", "universe", "ranks", "detections", "follow_through", "digest_breaks", "symbol_state")


def all_rows(spark, base):
    """Of each market, the rows of each table."""
    out = {m: {t: [] for t in READ} for m in ("US", "IDX")}
    for t in READ:
        for r in tables.read(spark, base, t).coalesce(1).collect():
            out[r["market"]][t].append(str(r))
    return {m: {t: sorted(x) for t, x in found.items()} for m, found in out.items()}


def members(spark, *symbols, day=DAY, market="US"):
    return spark.createDataFrame([(market, day, s) for s in symbols], schemas.TABLES["universe"])


def test_uncommitted_attempts_are_never_seen(spark, tmp_path):
    base = str(tmp_path)
    tables.stage(spark, base, "universe", members(spark, "LOST"), "dead")
    assert tables.read(spark, base, "universe").count() == 0
    tables.append_once(spark, base, "universe", members(spark, "A", "B"))
    assert {r["symbol"] for r in tables.read(spark, base, "universe").collect()} == {"A", "B"}
    assert tables.vacuum(spark, base, "universe") == 0  # too young: its night may be at work
    assert tables.vacuum(spark, base, "universe", hours=-1) == 1
    assert {r["symbol"] for r in tables.read(spark, base, "universe").collect()} == {"A", "B"}
    assert [(r["table"], r["rows"]) for r in tables.commits(spark, base).collect()] == [("universe", 2)]


def test_of_two_runs_of_a_market_one_fails(spark, tmp_path):
    base = str(tmp_path)
    seen = tables.last_commits(spark, base)
    for attempt, s in (("one", "A"), ("two", "B")):
        tables.stage(spark, base, "universe", members(spark, s), attempt)
        tables.stage(spark, base, "universe", members(spark, s, market="IDX"), attempt)
    tables.commit(spark, base, "one", ("universe",), [("US", DAY)], seen)
    with pytest.raises((ValueError, FileExistsError)):
        tables.commit(spark, base, "two", ("universe",), [("US", DAY)], seen)
    other = date(2026, 7, 16)
    with pytest.raises(FileExistsError):
        tables.commit(spark, base, "two", ("universe",), [("US", other)], seen)
    tables.commit(spark, base, "two", ("universe",), [("IDX", DAY)], seen)  # another market isn't in the way
    assert {(r["market"], r["symbol"]) for r in tables.read(spark, base, "universe").collect()} == {("US", "A"), ("IDX", "B")}


def test_files_are_created_whole_and_once(spark, tmp_path):
    where, won = f"{tmp_path}/x/1.json", []

    def go(i):
        try:
            files.create(spark, where, str(i) * 1000)
            won.append(i)
        except FileExistsError:
            pass

    for i in (1, 2):
        go(i)
    assert won == [1] and spark.read.text(where).first()[0] == "1" * 1000
    assert [f.rsplit("/", 1)[1] for f in files.listed(spark, f"{tmp_path}/x/*")] == ["1.json"]


KEY = schemas.KEYS["labels"]


def label(spark, *data):
    return spark.createDataFrame(data, schemas.TABLES["labels"])


def upsert(spark, where, rows):
    versions.upsert(spark, where, rows, schemas.schema("labels"), KEY)


def stored(spark, where):
    return versions.read(spark, where, schemas.schema("labels"), KEY)


def test_labels_survive_a_writer_that_dies(spark, tmp_path, monkeypatch):
    where = str(tmp_path)
    upsert(spark, where, label(spark, ("US", "A", "X", "I", DAY), ("US", "B", "Y", "J", DAY)))
    before = sorted(map(tuple, stored(spark, where).collect()))
    with monkeypatch.context() as m:
        m.setattr(files, "create", lambda *_: 1 / 0)  # rows are written, the version isn't
        with pytest.raises(ZeroDivisionError):
            upsert(spark, where, label(spark, ("US", "A", "Z", None, DAY)))
        with pytest.raises(ZeroDivisionError):
            versions.compact(spark, where, schemas.schema("labels"), KEY)
    assert sorted(map(tuple, stored(spark, where).collect())) == before
    upsert(spark, where, label(spark, ("US", "A", "Z", None, None), ("US", "C", None, "K", DAY)))
    assert sorted(map(tuple, stored(spark, where).collect())) == [("US", "A", "Z", "I", DAY), ("US", "B", "Y", "J", DAY), ("US", "C", None, "K", DAY)]


def test_labels_equal_upserts_one_by_one_and_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "DELTAS", 3)
    where, want = str(tmp_path), label(spark, ("US", "S", "X", "I", DAY)).limit(0)
    for i in range(5):
        change = label(spark, *[("US", f"S{j}", None if (i + j) % 3 == 0 else f"sector{i}", f"industry{i}", DAY) for j in range(i, i + 4)])
        upsert(spark, where, change)
        want = tables.upsert(want, change)
    assert sorted(map(str, stored(spark, where).collect())) == sorted(map(str, want.collect()))
    assert len(versions.last(spark, where)[1]) <= 3


def test_no_change_of_two_label_writers_is_lost(spark, tmp_path):
    where = str(tmp_path)
    go = [threading.Thread(target=upsert, args=(spark, where, label(spark, ("US", f"S{i}", "X", "I", DAY)))) for i in range(4)]
    for t in go:
        t.start()
    for t in go:
        t.join()
    assert {r["symbol"] for r in stored(spark, where).collect()} == {"S0", "S1", "S2", "S3"}


def test_a_stored_column_of_another_type_is_refused(spark, tmp_path):
    base = str(tmp_path)
    tables.append_bars(spark, base, bars(spark, rows("A", [1.0, 2.0])))
    assert tables.read(spark, base, "bars").count() == 2
    old = tables.read(spark, base, "bars").withColumn("volume", F.col("volume").cast("double")).withColumn("month", F.lit("2026-02-01").cast("date"))
    old.write.mode("append").partitionBy("market", "month").parquet(tables.path(base, "bars"))
    with pytest.raises(TypeError, match="volume: double, declared bigint"):
        tables.read(spark, base, "bars")


def test_counts_by_symbol_and_order_of_delivery(spark, tmp_path):
    base = str(tmp_path)
    batch = lambda c, n: bars(spark, rows("A", c)).withColumn("delivery", F.lit(n))
    got = tables.append_counted(spark, base, batch([9.0, 9.0], 2).unionByName(batch([1.0], 1)).unionByName(bars(spark, rows("B", [5.0])).withColumn("delivery", F.lit(3))))
    assert sorted(map(tuple, got.collect())) == [("US", "A", 3, 2), ("US", "B", 1, 1)]
    assert sorted((r["symbol"], r["close"]) for r in tables.read(spark, base, "bars").collect()) == [("A", 1.0), ("A", 9.0), ("B", 5.0)]
    again = tables.append_counted(spark, base, bars(spark, rows("A", [7.0, 7.0, 7.0])))
    assert [tuple(r) for r in again.collect()] == [("US", "A", 3, 1)]


SMALL = Params(floors={"US": 1.0, "IDX": 1.0}, min_bars=2, density_min=2, window=4)


def two_markets(spark):
    days = weekdays(8)
    index = {"US": "^IXIC", "IDX": "^JKSE"}
    df = bars(spark, *[rows(s, [10.0 + i + j for i in range(8)], days=days, market=m) for m in index for j, s in enumerate(["A", "B", index[m]])])
    who = spark.createDataFrame([(m, s, "candidate", "Corp") for m in index for s in ("A", "B")], "market string, symbol string, role string, name string")
    return days, df, who


def run(spark, base, who, market, day, params=SMALL, symbols=("A", "B")):
    outcomes = spark.createDataFrame([(market, s, day, "resolved") for s in symbols], "market string, symbol string, session date, status string")
    target = spark.createDataFrame([(market, day)], "market string, target date")
    labels = spark.createDataFrame([(market, s, "Energy", "Oil", day) for s in symbols], schemas.TABLES["labels"])
    return nights.run_market(spark, base, who, outcomes, labels, target, F.lit("2026-12-01").cast("timestamp"), params)


@pytest.fixture
def one_task(spark):
    """Tiny tables: one task a shuffle."""
    wanted = {"spark.sql.shuffle.partitions": "1"}
    had = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def test_a_night_that_is_killed_at_its_writes(spark, tmp_path, monkeypatch, one_task):
    """Readers see whole sessions only, and the other market's night, which runs in between, stays whole. Killed at the first writes, in the middle, at the last ones and at the commit."""
    base = str(tmp_path)
    days, df, who = two_markets(spark)
    tables.append_bars(spark, base, df)
    run(spark, base, who, "IDX", days[5])
    before = all_rows(spark, base)
    assert before["IDX"]["universe"] and not any(before["US"].values())
    stage, create = tables.stage, files.create

    def killed(at):
        left = [at]

        def stop(f):
            def go(*args):
                left[0] -= 1
                if left[0] == 0:
                    if f is stage:
                        stage(*args)  # its files are there
                    raise KeyboardInterrupt
                return f(*args)

            return go

        with monkeypatch.context() as m:
            m.setattr(tables, "stage", stop(stage))
            m.setattr(files, "create", stop(create))
            try:
                run(spark, base, who, "US", days[5])
            except KeyboardInterrupt:
                return True
            return False

    n = 1
    while killed(n):
        assert all_rows(spark, base) == before, n
        if n == 2:
            run(spark, base, who, "IDX", days[6])
            nothing, before = before["US"], all_rows(spark, base)
            assert len(before["IDX"]["runs"]) == 2 and before["US"] == nothing
        n += 3 if 2 <= n < 8 else 1
    assert n > len(nights.STAGED)
    got = all_rows(spark, base)
    assert len(got["US"]["runs"]) == 1 and len(got["US"]["universe"]) == 2 and got["IDX"] == before["IDX"]
    assert run(spark, base, who, "US", days[5]).count() == 0  # nothing is left to do, and nothing changes
    assert all_rows(spark, base) == got


def test_nights_from_state_equal_the_whole_computation(spark, tmp_path, one_task):
    """Names with long gaps, young ones, and bars that come late; only months that the nights depend on are read."""
    base = str(tmp_path)
    params = Params(floors={"US": 1.0, "IDX": 1.0})
    days = weekdays(430, date(2024, 5, 6))
    flat = [(10.1 - i / 5000, 9.9 - i / 5000, 10.0 - i / 5000) for i in range(430)]
    lead = [(50.5, 49.5, 50.0)] * 350 + [(50 + 3.5 * i + 0.5, 50 + 3.5 * i - 0.5, 50 + 3.5 * i) for i in range(15)] + [(100.5, 99.5, 100.0)] * 35 + [(105.5, 104.5, 105.0)] * 30
    gap = [i for i in range(430) if i < 40 or i >= 365]
    pick = lambda s, series, at: rows(s, [series[i] for i in at], days=[days[i] for i in at])
    names = ("LEAD", "FLAT", "GAP", "YOUNG", "LATE", "DEAD")
    late = pick("LATE", lead, range(60, 100))
    df = bars(spark, rows("LEAD", lead, days=days), rows("FLAT", flat, days=days), pick("GAP", lead, gap), pick("YOUNG", lead, range(370, 430)), pick("LATE", flat, range(360, 430)), pick("DEAD", flat, range(60)), rows("^IXIC", [100.0 + i for i in range(430)], days=days))
    who = spark.createDataFrame([("US", s, "candidate", "Corp") for s in names] + [("US", "^IXIC", "reference", "")], "market string, symbol string, role string, name string")
    labels = spark.createDataFrame([("US", s, "Energy", "Oil", days[0]) for s in names], schemas.TABLES["labels"])
    upto = lambda i: df.filter(F.col("session") <= days[i])
    tables.append_bars(spark, base, upto(398))
    run(spark, base, who, "US", days[398], params, names)
    tables.append_bars(spark, base, upto(401).unionByName(bars(spark, late)))
    assert [r["symbol"] for r in spark.read.parquet(tables.path(base, "late")).collect()] == ["LATE"]
    run(spark, base, who, "US", days[401], params, names)
    assert not files.listed(spark, tables.path(base, "late") + "/market=*")

    seen = []
    needed = nights.needed_bars
    nights.needed_bars = lambda *a: seen.append(needed(*a)) or seen[-1]
    try:
        tables.append_bars(spark, base, df)
        run(spark, base, who, "US", days[405], params, names)
    finally:
        nights.needed_bars = needed
    assert {r["symbol"] for r in seen[0].filter("deep").collect()} == {"GAP", "LATE"}  # the names with earlier bars and few recent ones
    assert seen[0].filter("NOT deep").select(F.trunc("session", "month")).distinct().count() <= nights.MONTHS + 1
    assert "PartitionFilters: [isnotnull(market" in seen[0]._jdf.queryExecution().executedPlan().toString()

    whole = df.unionByName(bars(spark, late)).filter(F.col("session") <= days[405])
    outcomes = spark.createDataFrame([("US", s, d, "resolved") for s in names for d in days], "market string, symbol string, session date, status string")
    known = [days[398], *days[399:402], *days[402:406]]
    want = nights.compute(who, whole, outcomes, labels, spark.createDataFrame([("US", d) for d in known[1:]], "market string, session date"), None, params)
    for t, w in (("universe", want.universe), ("ranks", want.ranks), ("detections", want.detections), ("follow_through", want.follow_through), ("digest_breaks", want.digest.select("market", "session", "symbol"))):
        got = tables.read(spark, base, t).filter(F.col("session") > days[398])
        assert sorted(map(str, got.collect())) == sorted(map(str, w.select(*got.columns).collect())), t
    assert want.detections.count() and want.digest.count()
    state = {r["symbol"]: (r["bars"], r["member"]) for r in tables.read(spark, base, "symbol_state").filter(F.col("session") == days[405]).collect()}
    assert state == {"LEAD": (406, True), "FLAT": (406, True), "GAP": (81, True), "YOUNG": (36, True), "LATE": (86, True), "DEAD": (60, False), "^IXIC": (406, False)}
