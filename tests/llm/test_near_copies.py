import corpus_pipeline
import numpy as np
import pytest
from test_line_operators import plain_dedup
from test_pipeline import DATA, plain_rules

from tidemark.llm import near_copies
from tidemark.llm.simhash import shingles


def plain_groups(texts):
    """{id: least id reachable} and the number of links, by comparing all pairs."""
    sets = {i: frozenset(x for p in shingles(t, 5) for x in p) for i, t in texts.items()}
    ids, n = sorted(texts), 0
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                n += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, n


def variants(seed, bases, each, most):
    """Texts of 60 to 200 words, each with copies in which up to so many words differ."""
    rng, out = np.random.default_rng(seed), {}
    for b in range(bases):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))]
        for _ in range(each):
            v = list(w)
            for at in rng.integers(0, len(v), rng.integers(0, most)):
                v[at] = f"x{rng.integers(0, 10**6)}"
            out[len(out)] = " ".join(v)
    return out


@pytest.mark.parametrize("block", [512, 4])
def test_groups_and_recall_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = variants(3, 40, 6, 7)
    want, n = plain_groups(texts)
    assert n > 80 and len(set(want.values())) > 45  # links, and pairs under the limit
    got = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_recall_of_the_buckets_at_the_limit():
    texts = variants(4, 300, 2, 7)
    sets = [near_copies.shingle_set(t) for t in texts.values()]
    pairs = [(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True) if 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.9]
    assert len(pairs) > 30
    assert all(set(near_copies.band_keys(a)) & set(near_copies.band_keys(b)) for a, b in pairs)


def test_no_pair_at_the_limit_is_beyond_the_radius():
    texts = variants(6, 800, 2, 7)
    sets = [near_copies.shingle_set(t) for t in texts.values()]
    short = [" ".join(f"v{i}w{j}" for j in range(n)) for i, n in enumerate(range(8, 40))]  # four shingles and more, one of them cut off
    sets += [near_copies.shingle_set(x) for t in short for x in (t, t.rsplit(" ", 1)[0])]
    marks = [near_copies.wide_fingerprint(x) for x in sets]
    linked, far = [], []
    for i in range(len(sets) - 1):
        a, b = sets[i], sets[i + 1]
        d = int(np.bitwise_count(marks[i] ^ marks[i + 1]).sum())
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * len(np.union1d(a, b)):
            linked.append(d)
        elif not common:
            far.append(d)
    assert len(linked) > 100 and max(linked) < near_copies.RADIUS - 5
    assert len(far) > 100 and min(far) > near_copies.RADIUS


def test_edge_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 2), (None, "   ", 3), (9, "a b c d", 4), (9, "a b c d", 5), (None, "q r s", 6)], "doc_id long, text string, n int")
    got = sorted(map(str, (tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect())))
    assert got == sorted(map(str, [(5, 3), (3, 3), (None, 3), (9, 9), (9, 9), (None, None)]))
    assert near_copies.keep_one(docs).columns == docs.columns and near_copies.keep_one(docs).count() == 3
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    rows = plain_rules([(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    text = plain_dedup(rows, 10)
    want, _ = plain_groups({i: text[i] for i, _, _ in rows})
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == set(want.values())
