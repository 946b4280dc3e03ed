import random
from collections import Counter

import pytest

from tidemark.llm import mixing


def plain_mix(sizes, parts):
    """The sources of all slots, period by period, by earliest deadline with releases."""
    left, out = dict(sizes), []
    while any(left.values()):
        m = {s: min(parts[s], left[s]) for s in sorted(left)}
        length, gone = sum(m.values()), Counter()
        for t in range(length):
            ready = [(-((gone[s] + 1) * length // -m[s]), s) for s in m if gone[s] < m[s] and gone[s] * length // m[s] <= t]
            due, s = min(ready)
            assert t < due
            out.append((s, gone[s] * length // m[s] + len(out) - t, due + len(out) - t))
            gone[s] += 1
        for s in m:
            left[s] -= m[s]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_scheduler(spark, seed):
    rng = random.Random(seed)
    parts = {f"s{i}": rng.randint(1, 9) for i in range(4)}
    sizes = {s: rng.randint(0, 60) for s in parts} | {"*": rng.randint(1, 60)}
    docs = [(i, "t", s if s != "*" else rng.choice(["x", None])) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = sorted(mixing.mix(df, parts, 3, 1).collect(), key=lambda r: r["slot"])
    want = plain_mix({k: v for k, v in sizes.items() if v}, parts | {"*": 3})
    assert [(r["src"], r["release"], r["deadline"]) for r in got] == want
    assert [r["slot"] for r in got] == list(range(len(docs))) and sorted(r["doc_id"] for r in got) == list(range(len(docs)))


def test_less_than_one_block_from_the_share(spark):
    parts = {"a": 90, "b": 7, "c": 2}
    df = spark.createDataFrame([(i, "t", "abcd"[i % 4]) for i in range(2000)], "doc_id long, text string, source string")
    got = sorted(mixing.mix(df, parts, 1, 1).filter("slot < 100").collect(), key=lambda r: r["slot"])
    seen = Counter()
    for t, r in enumerate(got, 1):
        seen[r["src"]] += 1
        for s, p in (parts | {"*": 1}).items():
            assert abs(seen[s] - t * p / 100) < 1


def test_blocks_and_order(spark):
    df = spark.createDataFrame([(i, f"t{i}", "src0" if i % 3 else "other") for i in range(101)], "doc_id long, text string, source string").selectExpr("*", "1 AS slot", "2 AS rank")
    rows = mixing.mix(df, block_rows=8).collect()
    assert len({(r["slot"], r["offset"]) for r in rows}) == 101
    assert all(r["offset"] == r["rank"] % 8 and r["release"] <= r["slot"] < r["deadline"] for r in rows)
    out = mixing.mixed(df).collect()
    want = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["offset"]))]
    assert [r["doc_id"] for r in out] == want and out[0].asDict().keys() == set(df.columns)


def test_schedules_that_are_too_long_to_send(spark, monkeypatch):
    df = spark.createDataFrame([(i, "t", "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    parts = {"a": 5, "b": 3, "c": 1}
    want = sorted(map(tuple, mixing.mix(df, parts, 1, 2).collect()))
    monkeypatch.setattr(mixing, "SLOTS_SENT", 0)
    assert sorted(map(tuple, mixing.mix(df, parts, 1, 2).collect())) == want


def test_places_go_by_the_numbers_of_files(spark, tmp_path):
    for name, n in {"part-100000-x": 4, "part-99999-x": 3, "part-00002-x": 2, "part-00002-a": 1}.items():
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(str(tmp_path / "one" / name))
        (made,) = (tmp_path / "one" / name).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"{name}.parquet")
    got = mixing.with_place(spark.read.parquet(str(tmp_path / "all")), "place").orderBy("place").collect()
    assert [r["n"] for r in got] == [1, 2, 3, 4]
    nowhere = mixing.with_place(spark.createDataFrame([(1,)], "n int"), "place").collect()
    assert [(r["n"], r["place"]) for r in nowhere] == [(1, None)]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "x", "src1"), (1, "x", "src1"), (2, None, "src0")], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 4 and mixing.mixed(df).count() == 4
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})
