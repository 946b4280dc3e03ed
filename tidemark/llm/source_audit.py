"""Source divergence audit: how far the term frequencies of a language's sources lie apart, by count-level bitmaps.

A language keeps the terms that are in ``min_docs`` of its documents or more. A term's weight in a group depends on
its count there alone, so a group is a bitmap of term numbers for each count that occurs in it. The AND of two
bitmaps has the terms with one count in the first group and another in the second; its popcount times the
distance of the two weights is what this joint cell adds to the distance of the groups. Cells with a count of
zero come by complement, from the bitmaps' own sizes and the number of terms.

A language's terms are dealt into blocks of about ``BLOCK`` by a hash. Within a block they are numbered from
frequent to rare, so that the terms of a 64-bit word have similar counts and a group has few bitmaps in it. Each
task compares the bitmaps of one block for two sets of ``SOURCES`` sources at most, so that no task grows with
the number of sources or terms; the distances are summed over blocks.

Terms are counted within tasks before they are shuffled, a bounded number at a time, and once without their
source to find those that are kept. All arithmetic is whole numbers.

Edge cases: null text, lang and source are empty strings. A group without terms, and a language that keeps
none, are compared like others (distance 0 if none is kept). Repeated rows count each. Very long texts are
counted piece by piece. Ties go by the bytes of the item. An empty table gives an empty result. Further
columns of the input are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import HOT, checkpointed, small, table

MIN_DOCS = 30  #: of its language's documents that a kept term is in
TOP = 50  #: terms of each group that are reported
UNIT = 1_000_000_000  #: weights are in parts of this
SMOOTHING = 5
BLOCK = 512  #: terms that are compared together, about
SOURCES = 64  #: sources that are compared with as many others together
PIECE = 1 << 20  #: bytes of text that are cut into terms at a time
ROWS = 256  #: bitmaps that are compared with all others of their word at once
COUNTED = 300_000  #: terms that a task counts before it hands them on, about
#: Letters in lower case and all bytes of other characters stay, the rest parts terms.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    at = 0
    while at < len(text):
        part = text[at : at + PIECE].translate(FOLD)
        end = len(part) if at + PIECE >= len(text) else part.rfind(b" ") + 1
        if not end:  # one term goes on beyond the piece
            size = PIECE
            while not end and size < len(text) - at:
                size *= 2
                part = text[at : at + size].translate(FOLD)
                end = part.rfind(b" ") + 1
            end = end or len(part)
        yield part[:end].split()
        at += end


def tallied(docs: DataFrame, by: tuple[str, ...], documents: bool) -> DataFrame:
    """The columns by, term and n: occurrences or, if so, documents, counted within tasks; a term may come again in a later row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for key, n in counts.items():
                columns = [*(pa.array([k] * len(n), pa.string()) for k in key), pa.array([k.decode() for k in n], pa.string()), pa.array(n.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*by, "term", "n"])
            counts.clear()

        size = 0
        for x in batches:
            keys = [x.column(c) for c in by]
            for i, text in enumerate(x.column("text").cast(pa.binary())):
                n = counts.setdefault(tuple(k[i].as_py() for k in keys), Counter())
                before = len(n)
                parts = terms(text.as_py())
                for part in [set().union(*parts)] if documents else parts:
                    n.update(part)
                size += len(n) - before
                if size > COUNTED:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.select(*by, "text").mapInArrow(run, ", ".join(f"{c} string" for c in (*by, "term")) + ", n long")


def weight(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * kept)), exactly; null without a kept term."""
    over = f"CAST({UNIT} AS DECIMAL(11, 0)) * CAST({n} + {SMOOTHING} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + ({over}) DIV CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(20, 0)) END")


def compare(x: pd.DataFrame) -> pd.DataFrame:
    """What the terms of one block add to the distances of its groups: lang, one, two, value.

    A row is a bitmap (word, bits and the weight p of its count) or, where word is -1, a group (its weight p of a
    count of zero, and as bits the number of the block's terms). The sources of set a (side 0) are compared with
    those of set b (side 1), or with each other if a is b.
    """
    head = x[x["word"] < 0].sort_values(["side", "source"])
    names, zero, size, n = head["source"].to_numpy(), head["p"].to_numpy(), int(head["bits"].iloc[0]), len(head)
    left, apart = int((head["side"] == 0).sum()), x["a"].iloc[0] != x["b"].iloc[0]
    maps = x[x["word"] >= 0]
    owner = maps["source"].map({k: i for i, k in enumerate(names)}).to_numpy(np.int64)
    order = np.lexsort((owner, maps["word"].to_numpy()))
    owner, word, bits, p = owner[order], maps["word"].to_numpy()[order], maps["bits"].to_numpy()[order].view(np.uint64), maps["p"].to_numpy()[order]
    own = np.bitwise_count(bits).astype(np.int64)
    filled = np.zeros(n, np.int64)
    np.add.at(filled, owner, own)
    # By complement: a bitmap's terms have a count of zero in the other group, until joint cells say otherwise.
    base = np.abs(zero[:, None] - zero[None, :])
    value = base * (size - filled[:, None] - filled[None, :])
    for i in range(n):
        mine = owner == i
        alone = (np.abs(p[mine][:, None] - zero[None, :]) * own[mine][:, None]).sum(axis=0)
        value[i, :] += alone
        value[:, i] += alone
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    for a, b in pairwise([*starts, len(word)]):
        # All bitmaps of one word; those of side 1 are the last ones.
        cut = a + int(np.searchsorted(owner[a:b], left))
        first, last = (cut, cut) if apart else (a, b)  # where the second ones start, and where the first ones end
        for r in range(a, last, ROWS):
            both = bits[r : min(r + ROWS, last), None] & bits[None, first:b]
            i, j = np.nonzero(both)
            cells = np.bitwise_count(both[i, j]).astype(np.int64)
            i, j = i + r, j + first
            if not apart:
                once = owner[i] < owner[j]
                i, j, cells = i[once], j[once], cells[once]
            one, two = owner[i], owner[j]
            f = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[two]) - np.abs(zero[one] - p[j]) + base[one, two]
            np.add.at(value, (one, two), cells * f)
    one, two = (g.ravel() for g in np.mgrid[:left, left:n]) if apart else np.triu_indices(n, 1)
    return pd.DataFrame({"lang": x["lang"].iloc[0], "one": names[one], "two": names[two], "value": value[one, two]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: a row for each other source of the language, and for the terms that the source has most in excess."""
    plain = lambda c, a: F.coalesce(docs[c].cast("string"), F.lit("")).alias(a)
    rows = docs.select(plain(lang, "lang"), plain(source, "source"), plain(text, "text"))
    known = tallied(rows, ("lang",), True).groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    known = small(checkpointed(known.select("lang", "term")), HOT)
    counts = tallied(rows, ("lang", "source"), False).join(known, ["lang", "term"], "left_semi")
    counts = checkpointed(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    kept = checkpointed(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))

    groups = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = small(checkpointed(langs.na.fill(0, ["v", "lang_total"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK))).withColumn("sets", F.ceil(F.col("sources") / SOURCES))), HOT)
    groups = small(checkpointed(groups.na.fill(0, ["total"]).join(langs, "lang").withColumn("set", F.pmod(F.xxhash64("source"), "sets"))), HOT)

    # Terms in their blocks, numbered from frequent to rare.
    dealt = kept.join(langs.select("lang", "v", "lang_total", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    number = F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("lang_n"), "term")) - 1
    dealt = checkpointed(dealt.withColumn("number", number).withColumn("q", weight("lang_n", "lang_total", "v")).select("lang", "term", "block", "number", "q"))
    found = counts.join(small(dealt, HOT), ["lang", "term"]).join(groups.select("lang", "source", "total", "v", "set", "sets"), ["lang", "source"]).withColumn("p", weight("n", "total", "v"))

    bit = F.expr("shiftleft(1L, number % 64)")
    maps = found.groupBy("lang", "block", "source", "set", "sets", F.floor(F.col("number") / 64).alias("word"), "n").agg(F.bit_or(bit).alias("bits"), F.max("p").alias("p")).drop("n")
    sizes = dealt.groupBy("lang", "block").agg(F.count("*").alias("bits"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("p", F.coalesce(weight("0", "total", "v"), F.lit(0)))
    heads = heads.join(sizes, ["lang", "block"], "left").na.fill(0, ["bits"]).withColumn("word", F.lit(-1).cast("long"))
    columns = ("lang", "block", "source", "set", "sets", "word", "bits", "p")
    tiles = maps.select(*columns).unionByName(heads.select(*columns)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sets") - 1)))
    tiles = tiles.select("lang", "block", "source", "word", "bits", "p", F.least("set", "with").alias("a"), F.greatest("set", "with").alias("b"), (F.col("set") > F.col("with")).cast("int").alias("side"))
    parts = tiles.groupBy("lang", "block", "a", "b").applyInPandas(compare, "lang string, one string, two string, value long")
    pairs = parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("one", "two"), ("two", "one"))])
    pairs = pairs.select("lang", "value", F.inline(both)).withColumn("part", F.lit("pair"))
    terms_ = found.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    out = ("lang", "source", "part", "item", "value")
    return pairs.select(*out, rank).unionByName(terms_.select(*out, rank).filter(F.col("rank") <= top))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
occ AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
w AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (t.total + {SMOOTHING} * v.v)::HUGEINT AS p,
         1 + ({UNIT}::HUGEINT * (k.n + {SMOOTHING})) // (v.total + {SMOOTHING} * v.v)::HUGEINT AS q
  FROM totals t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM w x JOIN w y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM w WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP}
"""
