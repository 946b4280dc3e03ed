from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.sources.bars import parse_bars
from tidemark.streaming import ingest

NOW = "2026-07-15 20:15:00"
START = date(2026, 6, 1)


def row(symbol, day, close, volume=5):
    return ("US", symbol, str(day), close, close, close, close, close, volume)


@pytest.fixture
def store(spark, tmp_path):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "base")

    def deliver(*rows):
        spark.createDataFrame(list(rows), ingest.RAW).coalesce(1).write.mode("append").parquet(raw)

    def go(files=1000):
        ingest.start(spark, raw, base, str(tmp_path / "check"), F.lit(NOW).cast("timestamp"), files_per_batch=files).awaitTermination()

    def closes():
        return {(r["symbol"], r["session"]): r["close"] for r in tables.read(spark, base, "bars").collect()}

    return base, deliver, go, closes


def test_first_delivery_of_a_batch_and_across_batches(spark, store):
    base, deliver, go, closes = store
    deliver(row("A", START, 9.0), row("A", START, 1.0), row("B", START, 3.0))  # not the least: the first
    deliver(row("A", START, 0.5), row("A", START + timedelta(days=1), 7.0))
    go()
    want = {("A", START): 9.0, ("A", START + timedelta(days=1)): 7.0, ("B", START): 3.0}
    assert closes() == want
    deliver(row("A", START, 2.0), row("B", START + timedelta(days=1), 4.0))  # after a restart
    go()
    assert closes() == want | {("B", START + timedelta(days=1)): 4.0}
    got = {(r["batch"], r["symbol"]): (r["delivered"], r["added"], r["total"], r["last_session"]) for r in ingest.feed(spark, base).collect()}
    one = START + timedelta(days=1)
    assert got == {(0, "A"): (4, 2, 2, one), (0, "B"): (1, 1, 1, START), (1, "A"): (1, 0, 2, one), (1, "B"): (1, 1, 2, one)}


def test_one_file_a_batch_equals_one_batch(spark, store):
    base, deliver, go, closes = store
    for i in range(4):
        deliver(*[row(s, START + timedelta(days=d), 10.0 * i + d) for s in "AB" for d in range(i, i + 3)])
    go(files=1)
    assert closes() == {(s, START + timedelta(days=d)): 10.0 * max(0, d - 2) + d for s in "AB" for d in range(6)}
    sums = ingest.feed(spark, base).groupBy("symbol").agg(F.sum("added").alias("a"), F.sum("delivered").alias("d"), F.max("total").alias("t"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in sums} == {(s, 6, 12, 6, 4) for s in "AB"}


def test_stored_bars_are_known_and_phantoms_come_later(spark, store):
    base, deliver, go, closes = store
    tables.append_bars(spark, base, parse_bars(spark.createDataFrame([row("A", START, 5.0)], ingest.RAW)))
    later = date(2026, 7, 15)  # not final yet
    deliver(row("A", START, 6.0), row("A", START + timedelta(days=1), 6.0, 0), row("A", later, 8.0), row("Q", START, 1.0, 0))
    go()
    assert closes() == {("A", START): 5.0}
    got = {r["symbol"]: (r["delivered"], r["added"], r["total"]) for r in ingest.feed(spark, base).collect()}
    assert got == {"A": (1, 0, 1), "Q": (0, 0, 0)}
    deliver(row("A", START + timedelta(days=1), 6.5))
    go()
    assert closes() == {("A", START): 5.0, ("A", START + timedelta(days=1)): 6.5}


def test_a_repeated_batch_changes_nothing(spark, store, monkeypatch):
    base, deliver, go, closes = store
    deliver(row("A", START, 1.0), row("B", START, 2.0))
    whole = tables.append_bars

    def breaks(*args):
        whole(*args)
        raise RuntimeError("lost after the bars were written")

    monkeypatch.setattr(tables, "append_bars", breaks)
    with pytest.raises(Exception, match="lost after"):
        go()
    monkeypatch.setattr(tables, "append_bars", whole)
    deliver(row("A", START, 3.0))
    go()
    assert closes() == {("A", START): 1.0, ("B", START): 2.0}
    assert tables.read(spark, base, "bars").count() == 2
    got = {(r["batch"], r["symbol"]): (r["delivered"], r["added"], r["total"]) for r in ingest.feed(spark, base).collect()}
    assert got == {(0, "A"): (1, 1, 1), (0, "B"): (1, 1, 1), (1, "A"): (1, 0, 1)}


def test_quiet_names(spark, store):
    base, deliver, go, _ = store
    deliver(*[row("A", START + timedelta(days=d), 1.0) for d in range(3)], row("B", START, 1.0), row("C", START + timedelta(days=2), 1.0, 0))
    go()
    got = {(r["symbol"], r["last_session"]) for r in ingest.quiet(spark, base).collect()}
    assert got == {("B", START), ("C", None)}


def test_a_symbol_costs_a_batch_one_write_of_state_and_a_month_one_file(spark, store):
    base, deliver, go, closes = store
    days = [START - timedelta(days=9 * i) for i in range(40)]  # a year, in eleven months and more
    for d in days:
        deliver(row("A", d, 1.0), row("B", d, 2.0))
    go()
    assert closes() == {(s, d): 1.0 + (s == "B") for s in "AB" for d in days}
    files = [r[0] for r in tables.read(spark, base, "bars").select(F.input_file_name()).distinct().collect()]
    assert len(files) == len({(d.year, d.month) for d in days})

    class Value:
        known, calls = None, 0

        def get(self):
            return self.known

        def update(self, value):
            self.known, self.calls = value, self.calls + 1

    class Handle:
        value = Value()

        def getValueState(self, *_):
            return self.value

    import pandas as pd

    one = ingest.FirstDelivered()
    one.init(Handle())
    new, _ = one._add(pd.to_datetime(pd.Series(days)), one._get())
    assert new.all() and Handle.value.calls == 1
    new, known = one._add(pd.to_datetime(pd.Series([days[0] + timedelta(days=1), *days[3:7], days[-1] - timedelta(days=40)])), one._get())
    assert new.tolist() == [True, *[False] * 4, True] and Handle.value.calls == 2
    assert known[2:] == (42, days[0] + timedelta(days=1))
