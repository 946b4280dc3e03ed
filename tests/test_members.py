import random
import statistics
from datetime import timedelta

import pandas as pd
import pytest
from helpers import bars, rows, weekdays
from pyspark.sql import functions as F

from tidemark.operators import universe
from tidemark.params import Params
from tidemark.streaming import members

DAYS = weekdays(60)
LEAST = Params().floors["US"]


def series(spark, seed=5):
    """Names of changing liquidity, with gaps, a young one, and one whose name isn't that of a common stock."""
    rng, found, missed = random.Random(seed), [], []
    for i in range(12):
        days = [d for d in DAYS[40 if i == 3 else 0 :] if i in (0, 1) or rng.random() < 0.9]
        level = [LEAST * (rng.choice([0.7, 0.9, 1.1]) if k % 15 == 0 else 1) for k in range(len(days))]
        for k in range(1, len(level)):
            level[k] = level[k] if k % 15 == 0 else level[k - 1]
        found.append(rows(f"N{i}", [1.0] * len(days), days=days, volumes=[int(x) for x in level]))
        missed += [("US", f"N{i}", d, rng.choice(["unresolved", "refused"])) for d in DAYS if rng.random() < 0.1]
    who = [("US", f"N{i}", "Acme Warrants" if i == 1 else None if i == 2 else "Acme Corp", "candidate") for i in range(12)] + [("US", "NEVER", "None", "candidate")]
    return (
        spark.createDataFrame(who, "market string, symbol string, name string, role string"), bars(spark, *found),
        spark.createDataFrame(missed, "market string, symbol string, session date, status string"),
    )


def as_set(df):
    return {(r["symbol"], r["session"]) for r in df.collect()}


@pytest.mark.parametrize("begun", [0, 25])
def test_members_of_a_stream_equal_the_universe(spark, tmp_path, begun):
    instruments, stored, outcomes = series(spark)
    want = as_set(universe.universe(instruments, stored, outcomes))
    assert 100 < len(want) < 12 * 60
    grid = members.grid(instruments, stored, outcomes).cache()
    first = grid.filter(F.col("session") < DAYS[begun]) if begun else None
    raw, where, check = (str(tmp_path / x) for x in ("raw", "members", "check"))
    for a, b in ((begun, 30), (30, 31), (20, 60)):  # sessions 20 to 30 come again, after a restart
        grid.filter((F.col("session") >= DAYS[a]) & (F.col("session") <= DAYS[b - 1])).write.mode("append").parquet(raw)
        members.start_members(spark, raw, where, check, first).awaitTermination()
    got = members.read(spark, where, members.MEMBERS)
    assert as_set(got) == {x for x in want if x[1] >= DAYS[begun]} and got.count() == len(as_set(got))


def test_repeats_of_a_stream(spark, tmp_path):
    reports = lambda *data: spark.createDataFrame([("US", s, DAYS[i]) for s, i in data], members.REPORTS)
    raw, where, check = (str(tmp_path / x) for x in ("raw", "marks", "check"))
    assert members.read(spark, where, members.REPEATS).count() == 0
    for batch in (reports(("A", 5), ("A", 3), ("B", 4)), reports(("A", 5), ("B", 9), ("C", 9))):
        batch.write.mode("append").parquet(raw)
        members.start_repeats(spark, raw, where, check, reports(("B", 1), ("B", 0), ("D", 1))).awaitTermination()
    got = {(r["symbol"], r["session"]): (r["repeat"], r["last_reported"]) for r in members.read(spark, where, members.REPEATS).collect()}
    assert got == {("A", DAYS[3]): (False, None), ("A", DAYS[5]): (True, DAYS[3]), ("B", DAYS[4]): (True, DAYS[1]), ("B", DAYS[9]): (True, DAYS[4]), ("C", DAYS[9]): (False, None)}


class Kept:
    """A value of state that counts its reads and writes."""

    def __init__(self):
        self.value, self.reads, self.writes = None, 0, 0

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


def begun(processor):
    kept = Kept()
    processor.init(type("Handle", (), {"getValueState": lambda self, *_: kept})())
    return processor, kept


def plain_members(rows, params):
    """Row by row: a block's members, of rows in order of days, the first of a day counting."""
    found, state = set(), {}
    for x in sorted(rows, key=lambda x: x["day"]):
        s = state.setdefault(x["symbol"], {"day": -1, "traded": [], "volumes": [], "age": 0, "liquidity": 0.0, "member": False})
        if x["day"] <= s["day"]:
            continue
        s["day"], s["traded"] = x["day"], [*s["traded"], x["traded"]]
        if x["traded"]:
            s["age"], s["volumes"] = s["age"] + 1, [*s["volumes"], x["dollar_volume"]][-params.window :]
            known = [v for v in s["volumes"] if v is not None]
            s["liquidity"] = statistics.median(known) if known else s["liquidity"]
        if x["settled"]:
            dense = sum(s["traded"][-params.window :]) >= params.density_min and any(s["traded"][-params.density_recent :])
            hard = x["common"] and s["age"] >= params.min_bars and dense
            if not hard or s["liquidity"] < params.exit_share * x["least"]:
                s["member"] = False
            elif s["liquidity"] >= x["least"]:
                s["member"] = True
        if s["member"]:
            found.add((x["symbol"], x["day"]))
    return found


def test_a_block_of_symbols_costs_a_batch_one_read_and_one_write_of_state():
    params, rng, rows = Params(window=6, min_bars=5, density_min=4, density_recent=2), random.Random(7), []
    for i in range(40):
        for day in range(90):
            if rng.random() < 0.95:
                traded = rng.random() < (0.85 if day % 30 < 22 else 0.3)
                volume = rng.choice([700.0, 900.0, 1000.0, 1200.0, None]) if i else None
                rows.append({"symbol": f"N{i}", "day": day, "traded": traded, "dollar_volume": volume if traded else None, "common": i % 9 != 5, "least": 950.0, "settled": rng.random() < 0.9})
    rows.append(rows[-1] | {"traded": False, "settled": True})  # a day that comes twice: the first counts
    want = plain_members(rows, params)
    assert 200 < len(want) < 3000
    one, kept = begun(members.Membership(params))
    got = set()
    for n, (a, b) in enumerate(((0, 30), (30, 31), (20, 60), (60, 90), (0, 90)), 1):
        batch = [x for x in rows if a <= x["day"] < b and not (n == 2 and x["symbol"] > "N3")] + ([x for x in rows if x["day"] == 30 and x["symbol"] > "N3"] if n == 3 else [])
        symbols, days = one._members(pd.DataFrame(batch).sample(frac=1, random_state=n) if n < 4 else pd.DataFrame(batch))
        new = set(zip(symbols, days.tolist()))
        assert not new & got and len(new) == len(days) and kept.reads == n
        got |= new
    assert got == want and kept.writes == 4  # the last batch brought nothing new
    assert {len(x) for x in kept.value} == {40, 40 * params.window}

    marks, kept = begun(members.Repeats())
    out = marks._marked(pd.DataFrame({"symbol": ["B", "A", "B", "A"], "day": [9, 5, 4, 5]}))
    assert out.astype(object).where(out.notna(), None).values.tolist() == [["B", 4, None], ["B", 9, 4], ["A", 5, None]]
    out = marks._marked(pd.DataFrame({"symbol": ["C", "A", "B"], "day": [1, 6, 9]}))
    assert sorted(out.astype(object).where(out.notna(), None).values.tolist()) == [["A", 6, 5], ["C", 1, None]] and (kept.reads, kept.writes) == (2, 2)


def test_stores_of_reports_are_bounded_whatever_the_session_has(spark, tmp_path):
    """A batch opens and commits each store, however little is in it: their number and that of blocks don't grow with a session's shuffles."""
    before = spark.conf.get(members.PARTITIONS)
    reports = spark.createDataFrame([("US", f"N{i}", DAYS[i % 3]) for i in range(900)], members.REPORTS)
    raw, where, check = (str(tmp_path / x) for x in ("raw", "marks", "check"))
    try:
        spark.conf.set(members.PARTITIONS, "97")
        reports.coalesce(1).write.parquet(raw)
        query = members.start_repeats(spark, raw, where, check, reports.filter(F.col("session") < DAYS[1]))
        query.awaitTermination()
        assert spark.conf.get(members.PARTITIONS) == "97"
        state = query.lastProgress["stateOperators"][0]
        assert state["numShufflePartitions"] <= members.REPORT_STORES and state["numRowsTotal"] <= members.REPORT_BLOCKS
    finally:
        spark.conf.set(members.PARTITIONS, before)
    got = {(r["symbol"], r["session"]) for r in members.read(spark, where, members.REPEATS).collect()}
    assert got == {(f"N{i}", DAYS[i % 3]) for i in range(900) if i % 3}
