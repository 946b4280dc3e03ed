import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import source_audit as audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top=50):
    """Every pair and every term one by one."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = lambda c, of: 1 + 10**9 * (c + 5) // (of + 5 * len(kept))
        for s in sources:
            pairs = [(-sum(abs(p(n[lang, s][t], total[s]) - p(n[lang, o][t], total[o])) for t in kept), o.encode(), o) for o in sources - {s}]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            over = [(n[lang, s][t], p(n[lang, s][t], total[s]) - p(sum(n[lang, o][t] for o in sources), sum(total.values())), t) for t in kept]
            over = sorted((-d, t.encode(), t) for c, d, t in over if c and d > 0)[:top]
            out += [(lang, s, "term", t, -d, i) for i, (d, _, t) in enumerate(over, 1)]
    return sorted(out)


def corpus(seed, many=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "漢字", "a1b", "it's", "x\0y", "ſ", "K", "😀", "straße"] + [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(many):
        lang = rng.choice(["en", "en", "de", None, "zz"])
        source = rng.choice([None, "", "s1", "s2", "ß", "Z", *(f"h{i}" for i in range(8))]) if lang != "zz" else "only"
        rows.append((None if rng.random() < 0.05 else rng.choice([" ", "\n", "-"]).join(rng.choices(words, weights, k=rng.randint(0, 40))), lang, source))
    return rows + [rows[0], rows[0], ("rare words that nobody keeps", "one", "x"), ("others", "one", "y"), (None, "one", "z"), ("", "en", "no terms at all")]


@pytest.mark.parametrize("block, sources", [(16, 3), (4096, 64)])
def test_against_plain_python(spark, monkeypatch, block, sources):
    monkeypatch.setattr(audit, "BLOCK", block)
    monkeypatch.setattr(audit, "SOURCES", sources)
    rows = corpus(block)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'x' AS part", "3 AS item", "4 AS value")
    got = sorted(map(tuple, audit.audit(docs, min_docs=5, top=7).collect()))
    want = plain(rows, 5, 7)
    assert got == want and len([r for r in got if r[2] == "term"]) > 100
    assert {r[:4]: r[4] for r in got}["one", "x", "pair", "y"] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert audit.audit(docs).collect() == []


def test_joint_cells_of_any_bitmaps(monkeypatch):
    """A block's distances from its bitmaps equal those from the counts, for one set of sources and for two."""
    monkeypatch.setattr(audit, "ROWS", 3)
    rng = np.random.default_rng(1)
    for trial in range(30):
        sources, size = int(rng.integers(2, 7)), int(rng.integers(1, 200))
        counts = rng.integers(0, 4, (sources, size)) * (rng.random((sources, 1)) < 0.9)
        p = lambda s, c: (s + 3) * (c * 7 + 5)
        side = np.zeros(sources, int) if trial % 2 else np.arange(sources) % 2
        rows = []
        for s in range(sources):
            rows.append(("l", f"s{s}", -1, size, p(s, 0), side[s]))
            for word in range(0, size, 64):
                part = counts[s, word : word + 64]
                rows += [("l", f"s{s}", word // 64, np.array([sum(1 << int(i) for i in np.flatnonzero(part == c))], np.uint64).view(np.int64)[0], p(s, c), side[s]) for c in set(part) - {0}]
        got = audit.compare(pd.DataFrame(rows, columns=["lang", "source", "word", "bits", "p", "side"]).assign(a=0, b=int(side.any())).sample(frac=1, random_state=trial))
        want = {}
        for a in range(sources):
            for b in range(sources):
                if (side[a] < side[b]) if side.any() else a < b:
                    want[f"s{a}", f"s{b}"] = int(abs(np.array([p(a, c) for c in counts[a]]) - np.array([p(b, c) for c in counts[b]])).sum())
        assert {(r.one, r.two): r.value for r in got.itertuples()} == want


def test_terms_by_pieces(monkeypatch):
    rng = random.Random(3)
    for size in (1, 2, 5, 64, 1 << 20):
        monkeypatch.setattr(audit, "PIECE", size)
        for _ in range(100):
            text = "".join(rng.choices(["a", "B", "é", "漢", " ", "\0", "'", "longer", "\n"], k=rng.randint(0, 60)))
            parts = [w.decode() for part in audit.terms(text.encode()) for w in part]
            assert parts == TERM.findall(text.translate(LOWER))


def test_tasks_hand_on_what_they_have_counted(spark):
    """More terms than a task keeps, a term in most documents, and a very long text."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    rows = [(" ".join(["common", *(word() for _ in range(9000))]), "en", f"s{i % 2}") for i in range(60)] + [("common " * 500_000, "en", "s0")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    got = [tuple(r) for r in audit.audit(docs, min_docs=61).collect()]
    assert got == [tuple(r) for r in plain(rows, 61)]
    n = {r["source"]: r["n"] for r in audit.tallied(docs, ("lang", "source"), False).filter("term = 'common'").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert n == {"s0": 500_030, "s1": 30}
    assert audit.tallied(docs, ("lang",), True).filter("term = 'common'").count() > 1
