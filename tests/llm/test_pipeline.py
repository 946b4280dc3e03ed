import hashlib
from collections import Counter

import corpus_pipeline
from test_byte_bpe import ENC
from test_line_operators import plain_dedup, plain_stats
from test_mixing import plain_mix

from tidemark.llm import mixing
from tidemark.llm.simhash import shingles

DATA = "/root/testdata/sf0.001"


def plain_rules(rows):
    """The rows that the base rules and line limits keep; at this size no line is above the limits."""
    out = []
    for i, t, s in rows:
        n, _, _, _, rep = plain_stats(t)
        if n >= 10 and 100 * rep <= 20 * n:
            out.append((i, t, s))
    return out


def plain_first_of_each(texts):
    """The least id of each group that links at a similarity of 0.8 or more connect; sets of five-word shingles, all pairs."""
    sets, root = {i: frozenset(x for p in shingles(t, 5) for x in p) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if b < a and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}


def test_run_against_plain_python(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = plain_rules(docs)
    text = plain_dedup(rows, 10)
    rows = [(i, text[i], s) for i, _, s in rows]
    first = plain_first_of_each({i: t for i, t, _ in rows})
    want = {}
    for i, t, _ in rows:
        if i in first:
            ids = ENC.encode_ordinary(t)
            want[i] = (len(ids), hashlib.sha256(t.encode()).hexdigest())
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in out} == want
    # The mix is in the last output: every source is near its share in each prefix, as the plain scheduler has it.
    source = {i: s for i, _, s in rows}
    order = [source[r["doc_id"]] for r in sorted(out, key=lambda r: r["mix_place"])]
    assert sorted(r["mix_place"] for r in out) == list(range(len(out)))
    left, blocks = Counter(order), []
    for s, _, _ in plain_mix({s: -(-n // mixing.BLOCK_ROWS) for s, n in left.items()}, mixing.PARTS):
        blocks += [s] * min(mixing.BLOCK_ROWS, left[s])
        left[s] -= min(mixing.BLOCK_ROWS, left[s])
    assert order == blocks


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
