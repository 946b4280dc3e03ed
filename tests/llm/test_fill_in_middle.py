import hashlib
import random
import re

from tidemark.llm import fill_in_middle as fim


def plain(doc_id, text):
    """The contract, by a list of all units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def texts(seed, many):
    rng = random.Random(seed)
    alphabet = ["a", "Z", "word", "é", "ſ", "K", "1", " ", "\n", "\r\n", "\0", "<", "<P", "S>", "<M", ">", "😀", "漢", "́"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 200))) for _ in range(many)]


def test_every_rank_of_a_skip_list(monkeypatch):
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(fim, "PIECE", piece)
        for text in texts(piece, 40):
            units, found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), fim.SkipList(text)
            assert found.size == len(units)
            assert [found.end_of(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]


def test_links_carry_both_widths_and_thin_out():
    found = fim.SkipList("ab, é1 " * 20_000)
    assert len(found.lanes) > 3
    for k, (units, chars, below) in enumerate(found.lanes):
        assert units.sum() == found.size == 120_000 and chars.sum() == 140_000
        assert k == 0 or len(units) < len(found.lanes[k - 1][0]) / 4 or len(units) < 30
        if k:
            assert [found.lanes[k - 1][0][i:j].sum() for i, j in zip(below, [*below[1:], None])] == list(units)


def test_very_long_texts():
    for text in ("x" * 3_000_000, "é" * 1_500_000, "a b" * 1_000_000, "word😀" * 300_000):
        h = [123_456_789, 3_987_654_321, 5, 50]
        out, n, form, a, m = fim.transform(text, h)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        assert n == len(units) and form == "psm" and fim.restore(out, form) == text
        assert a == sum(map(len, units[:x])) and m == sum(map(len, units[x:y]))


def test_marks_that_a_cut_could_fake():
    for text in ("<", "<<", "<P", "P>", "<S<S", "S><", "<M<P<S", "><M"):
        for i in range(200):
            out, _, form, _, _ = fim.transform(text, [i, i * 7, 0, i % 40], fim.Rates(plain=0))
            assert form != "plain" and fim.restore(out, form) == text


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts(5, 300))] + [(None, "a null id"), (7, None), (8, ""), (9, "a <P> b"), (5, "twice"), (5, "twice"), (-3, "negative"), (2**62, "large")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS form", "1 AS n", "2 AS output")
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    out = fim.fill_in_middle(docs, with_output=True).filter("doc_id < 50 AND prefix_chars IS NOT NULL").select("output", "form", "output_sha256").collect()
    assert out and all(hashlib.sha256(r["output"].encode()).hexdigest() == r["output_sha256"] for r in out)


def test_whole_table(spark):
    got = sorted(map(tuple, fim.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == sorted(plain(r["doc_id"], r["text"]) for r in docs)
