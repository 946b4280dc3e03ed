import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """{id: least id reachable}, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "a B c", "x y z w " * 400, "É é x y", "a b c d"])
def test_fingerprint_of_odd_texts(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def test_near_against_all_pairs():
    rng = np.random.default_rng(1)
    fps, runs = [], []
    for r, n in enumerate([1, 2, 64, 65, 200, 3]):
        base = rng.integers(0, 2**64, 4, dtype=np.uint64)
        x = base[rng.integers(0, 4, n)]
        for _ in range(3):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
        fps.append(x)
        runs += [r] * n
    f, runs = np.concatenate(fps), np.array(runs)
    got = set(zip(*(x.tolist() for x in simhash.near(f, runs)), strict=True))
    want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if runs[i] == runs[j] and (int(f[i]) ^ int(f[j])).bit_count() <= 2}
    assert got == want


def test_wide_fingerprints_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (5, 4), dtype=np.uint64)
    noise = np.packbits(rng.random((150, 256)) < rng.choice([0.1, 0.25, 0.32], (150, 1)), axis=1).view(np.uint64)
    fps, runs = base[rng.integers(0, 5, 150)] ^ noise, np.sort(rng.integers(0, 3, 150))
    got = set(zip(*(x.tolist() for x in simhash.near(fps, runs, 80)), strict=True))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if runs[i] == runs[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 80}
    assert got == want and len(want) > 100


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r[0]: (int(r[1], 16), r[2]) for r in simhash.op8_simhash(spark, DATA).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == fps
    assert {k: v[1] for k, v in got.items()} == plain_components(fps)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_in_small_and_oversize_buckets(spark, bucket):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 20)
    fps = {int(b) ^ (int(rng.integers(0, 2**10)) << int(rng.integers(0, 4)) * 10) for b in base for _ in range(40)}
    fps = {x - 2**64 if x >= 2**63 else x + 2**64 if x < -(2**63) else x for x in fps}
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(1)
    got = {r["a"]: r["root"] for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    want = plain_components({x: x & (2**64 - 1) for x in fps})
    assert {x: got.get(x, x) for x in fps} == want


def test_one_bucket_of_20_000_against_all_pairs(spark):
    """Fingerprints that agree in 36 bits, so that some buckets are split once and more."""
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**28, 20_000))
    left, right = [], []
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    want = simhash._stars(len(fps), np.concatenate(left), np.concatenate(right))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r["a"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert [got.get(int(x), int(x)) for x in fps] == fps[want].tolist()


def test_shingles_by_piece(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(40))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 6)
    assert max(map(len, simhash.shingles(text))) == 6 and sum(map(len, simhash.shingles(text))) == 38
    assert simhash.fingerprint(text) == want == plain_fingerprint(text)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 2), (None, "   ", 3), (9, "a b c d", 4), (9, "a b c d", 5), (None, "q r s", 6)], "doc_id long, text string, fp int")
    got = sorted(map(str, (tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect())))
    assert got == sorted(map(str, [(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (None, None)]))
    kept = [r["fp"] for r in simhash.keep_one(docs).collect()]
    assert len(kept) == 3 and {2, 6} < set(kept)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
