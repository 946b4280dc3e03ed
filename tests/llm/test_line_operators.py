import re
from collections import defaultdict

import pytest

from tidemark.llm import line_dedup, quality_rules
from tidemark.llm.line_dedup import Spread
from tidemark.llm.quality_rules import LineLimits

SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_dedup(rows, least):
    where, first = defaultdict(set), {}
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"[^\x20\x09-\x0D]", x):
                k = x.strip(" \t\n\v\f\r").lower()
                where[k].add(s)
                first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, t, s in rows:
        keep = [x for p, x in enumerate(t.split("\n")) if len(where[x.strip(" \t\n\v\f\r").lower()]) < least or first[x.strip(" \t\n\v\f\r").lower()] == (i, p)]
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("lg_k", [4, 12])
def test_line_dedup_is_exact_whatever_the_sketch(spark, lg_k):
    rows = [(i, "\n".join([f"own {i}", *[f"Line {k} " for k in range(12) if i % (k + 1) == 0]]), f"site{i % 9}") for i in range(1, 80)]
    rule = Spread(min_sites=4, lg_k=lg_k)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), rule).collect()}
    assert got == plain_dedup(rows, 4)


def test_line_dedup_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x\n\n x ", "c"), (4, "X", "d"), (4, "X", "d"), (None, "x", None), (5, "y\r", "a")]
    df = docs(spark, rows).selectExpr("*", "'k' AS n_removed", "7 AS line")
    out = line_dedup.dedup_lines(df, Spread(min_sites=2))
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"], r["n_removed_"]) for r in out.collect())
    assert got == sorted([("1", None, "k", 0), ("2", "", "k", 0), ("3", "", "k", 2), ("4", "", "k", 1), ("4", "", "k", 1), ("None", "x", "k", 0), ("5", "y\r", "k", 0)])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_white_space_around_lines_is_no_difference(spark):
    rows = [(1, "The same line", "a"), (2, "\tthe same line\r\nrest", "b"), (3, "x\n \vThe Same line \f", "c")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), Spread(min_sites=3)).collect()}
    assert got == {1: "The same line", 2: "rest", 3: "x"}
    body = "\n".join(" ".join(f"w{k}x{j}n{{}}" for j in range(6)) for k in range(3))
    rows = [(i, body.replace("{}", str(i)) + f"\n{'\t' * (i % 2)}Menu line{chr(13) * (i % 3)}", "s") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean_good(docs(spark, rows), LineLimits(5, 0.1)).collect()}
    assert got == {i: body.replace("{}", str(i)) for i in range(30)}


def test_very_long_texts_are_cut_whole(spark):
    long = "\n".join(f"shared line {k}" if k % 2 else f"own line {k}" for k in range(60_000))
    shared = "\n".join(f"shared line {k}" for k in range(1, 60_000, 2))
    rows = [(1, shared, "a"), (2, shared + "\nx", "b"), (3, long, "c")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), Spread(min_sites=3)).collect()}
    assert got == {1: shared, 2: "x", 3: "\n".join(f"own line {k}" for k in range(0, 60_000, 2))}


def plain_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", "a b c d e f a b c d e g a b c d e", "x\nx\ny\n \nx", "##$ <b>|&% é😀 漢字", "w " * 3000, "1 2 3 4 5 6 7 8 9 10 11"]


def test_text_measures(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.text_stats(df).collect()}
    assert got == {i: plain_stats(t) for i, t in enumerate(TEXTS)}


def test_frequent_lines_and_depleted_documents(spark):
    body = "these are ten words of a text of its own %d"
    rows = [(i, f"{body % i}\nA menu line", "s") for i in range(30)] + [(100, "a menu line \nfew words here and there one two three four five", "s"), (101, "A MENU LINE\nA menu line\nA menu line\nx y z q", "s")]
    rows += [(200 + i, body % 999 + "\nthe same article in many copies", "s") for i in range(40)]  # one text
    got = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, rows), LineLimits(min_docs=5, share=0.1)).collect()}
    assert all(got[i]["kept"] for i in [*range(30), 100, *range(200, 240)])
    assert not got[101]["kept"] and not got[101]["base_failed"] and got[101]["lost_chars"] == 33
    assert got[0]["lost_chars"] == 11 and got[200]["lost_chars"] == 0
    assert [r["doc_id"] for r in quality_rules.keep_good(docs(spark, rows), LineLimits(5, 0.1)).filter("doc_id >= 100").orderBy("doc_id").collect()] == [100, *range(200, 240)]


def test_quality_edges(spark):
    rows = [(None, None, None), (None, "w " * 20, None), (1, "a b c d e f g h i j k", "s"), (1, "a b c d e f g h i j k", "s")]
    df = docs(spark, rows).selectExpr("*", "1 AS th", "2 AS host", "3 AS line", "4 AS kept")
    got = sorted((r["n_words"], r["kept"]) for r in quality_rules.judge(df).collect())
    assert got == [(0, False), (11, True), (11, True), (20, False)]
    kept = quality_rules.keep_good(df)
    assert kept.count() == 2 and kept.columns == df.columns
    assert quality_rules.judge(df.limit(0)).count() == 0 and quality_rules.keep_good(df.limit(0)).count() == 0
