import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import regex

from tidemark.llm import byte_bpe

ENC = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)


def test_cuts_never_change_the_matches():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "1", "²", "'", "s", "'ll", " ", "  ", "\n", "\t", "\x1c", " ", "　", "!", "?!", "漢", "😀", "́"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 120)))
        parts = list(byte_bpe.pieces(text, rng.randint(1, 20)))
        assert "".join(parts) == text
        assert [m for p in parts for m in regex.findall(public_tokenizers.PATTERN, p)] == regex.findall(public_tokenizers.PATTERN, text)
        assert [i for p in parts if p for i in byte_bpe._encode_piece(p, ENC)] == ENC.encode_ordinary(text)


@pytest.mark.parametrize("n", [999, 1000, 1001, 5000])
@pytest.mark.parametrize("tail", ["", "x", "!", "\n", "1 y"])
def test_long_blanks(n, tail):
    text = "word" + " " * n + tail + "\n" * n + "z"
    assert byte_bpe._encode_piece(text, ENC) == ENC.encode_ordinary(text)


def test_very_long_runs():
    for text in (" " * 1_000_000 + "x", "q" * 300_000, "漢" * 200_000, "a b " * 100_000):
        ids = [i for p in byte_bpe.encode(text, ENC) for i in p]
        assert ENC.decode(ids) == text


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world's"), (2, None), (3, ""), (None, "x"), (1, "Hello world's")], "doc_id long, text string").selectExpr("*", "'e' AS decoded", "1 AS n_tokens")
    got = sorted(map(tuple, byte_bpe.round_trip(docs).collect()), key=str)
    want = []
    for k, t in [(1, "Hello world's"), (2, ""), (3, ""), (None, "x"), (1, "Hello world's")]:
        ids = ENC.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    ids = byte_bpe.round_trip(docs, with_ids=True).filter("doc_id = 1").first()
    assert ENC.decode(ids["ids"]) == "Hello world's" and bytes(ids["decoded"]) == b"Hello world's"


def test_whole_table(spark):
    got = {r["doc_id"]: r for r in byte_bpe.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = ENC.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_ok"]
