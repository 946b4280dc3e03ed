import hashlib
import math
import zlib

import pytest

from tidemark.llm import sharding


def plain_shard(key, weights):
    best = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        best.append((-math.log(u) / w, s))
    return min(best)[1]


def test_against_plain_hashing_and_growth(spark):
    texts = {i: None if i % 7 == 0 else "é" * (i % 50) for i in range(3000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'z' AS shard", "0 AS slot")
    got = sharding.shard(df, 16).collect()
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == (len(t.encode()) if t is not None else 0) + 1
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert r["shard"] == plain_shard(r["doc_id"], [1.0] * 16)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    moved = sum(r["grown_shard"] == 16 for r in got) / len(got)
    assert abs(moved - 1 / 17) < 0.02
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text")
    got = [r["shard"] for r in sharding.shard(df, [1.0, 2.0, 3.0]).collect()]
    assert all(abs(got.count(s) / 6000 - (s + 1) / 6) < 0.03 for s in range(3))
    with pytest.raises(ValueError):
        sharding.shard(df, [1.0, 0.0])


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), (1, ""), (1, "")], "doc_id long, text string")
    got = sharding.shard(df, 4).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_one_key_with_most_rows_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)
    rows = [(None, f"t{i % 40}") for i in range(800)] + [(None, None)] * 400 + [(i, "x") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 1300
    for s in range(2):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    same = sorted((r["slot"], r["text_crc32"]) for r in got if r["doc_id"] is None)
    crcs = [-1 if c is None else c for _, c in same]
    assert crcs == sorted(crcs) and same[-1][0] - same[0][0] == 1199
