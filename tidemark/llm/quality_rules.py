"""Quality rules with cross-document line frequency.

Every text is measured by itself (word count, symbols, repeated lines, repeated five-word windows), and
every line is hashed after its white space is trimmed and it is lower-cased. A line is boilerplate of a host if the number of
the host's distinct texts that hold it is above both an absolute limit and a share of the host's distinct
texts. Boilerplate lines are taken out; a document that loses more than ``max_lost`` of its characters is
depleted and rejected. :func:`judge` gives measures and verdicts, :func:`keep_good` the rows that are kept,
as they are, and :func:`clean_good` the rows that are kept, without their boilerplate lines.

Copies of one text count once, so that a much copied article isn't mistaken for boilerplate.

Very long texts are measured whole, each in one row; the work grows with the length, but for a sort of its windows
where some of them repeat.

Edge cases: a null text has no words and fails the base rules; an empty text likewise. Null hosts are one
host of their own. Rows that agree in id and text are one document and get the same verdict, a row each.
An empty table gives an empty result. Further columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, has_word, lines_of, normal, table, without_lines


@dataclass(frozen=True)
class LineLimits:
    min_docs: int = 20  #: a line in this many distinct texts of a host, or fewer, is never boilerplate
    share: float = 0.10  #: nor one in this share of the host's distinct texts, or less
    max_lost: float = 0.5  #: a document that loses more of its characters to boilerplate is rejected


def _repeated_words(windows: str, size: int) -> Column:
    """How many words lie in a window of which windows, the hashes by place, has another."""
    # Hashes sorted with their places: a neighbour with the same hash makes both places repeated.
    ordered = f"array_sort(transform({windows}, (x, i) -> struct(x AS h, i AS i)))"
    starts = f"""
        transform(filter(transform({ordered}, (x, j) -> struct(x.i AS i, x.h AS h, j AS j)),
                         x -> x.h = get(_s, x.j - 1).h OR x.h = get(_s, x.j + 1).h), x -> x.i)"""
    # The words that windows at sorted starts cover: each start adds what lies before the next one.
    covered = f"aggregate(_p, struct(0L AS n, CAST(-{size} AS INT) AS last), (a, x) -> struct(a.n + least({size}, x - a.last) AS n, x AS last), a -> a.n)"
    inner = f"element_at(transform(array({ordered}), _s -> {starts}), 1)"
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L
        ELSE element_at(transform(array(array_sort({inner})), _p -> {covered}), 1) END""")


def text_stats(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Columns doc_id, th (hash of the text), host and the measures of each text alone, a row for each row."""
    base = docs.select(docs[doc].alias("doc_id"), docs[host].alias("host"), F.coalesce(docs[text], F.lit("")).alias("t"), F.xxhash64(docs[text]).alias("th"))
    words = base.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    hashed = words.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    windows = hashed.withColumn(
        "win",
        F.expr("CASE WHEN size(wh) < 5 THEN array() ELSE transform(sequence(0, size(wh) - 5), i -> xxhash64(wh[i], wh[i + 1], wh[i + 2], wh[i + 3], wh[i + 4])) END"),
    )
    lined = F.col("_lines")
    return windows.withColumn("_lines", F.filter(lines_of(F.col("t")), has_word)).select(
        "doc_id",
        "th",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lined) - F.size(F.array_distinct(lined))).cast("long").alias("n_dup_lines"),
        _repeated_words("win", 5).cast("long").alias("n_repeat_words"),
        F.aggregate(F.transform(lined, lambda x: F.length(normal(x))), F.lit(0).cast("long"), lambda a, x: a + x).alias("line_chars"),
    )


def host_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Columns doc_id, th, host, pos (place among all lines of the text), line (hash), chars: a row for each line with a word."""
    lines = docs.select(docs[doc].alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[host].alias("host"), F.posexplode(lines_of(docs[text])).alias("pos", "l"))
    lines = lines.filter(has_word(F.col("l"))).withColumn("l", normal(F.col("l")))
    return lines.select("doc_id", "th", "host", "pos", F.xxhash64("l").alias("line"), F.length("l").cast("long").alias("chars"))


def frequent_lines(lines: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Columns host, line, n_docs: the lines of each host that are above the limits.

    A host's size is the number of its distinct texts that have a line. Every count is of distinct
    texts, and is summed before it is shuffled.
    """
    hosts = lines.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = lines.select("host", "line", "th").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    counts = counts.filter(F.col("n_docs") > limits.min_docs)
    found = counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).filter(F.col("n_docs") > limits.share * F.col("host_docs"))
    return found.select(counts["host"].alias("host"), "line", "n_docs")


def judge(docs: DataFrame, limits: LineLimits = LineLimits(), doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, th, host, the measures, line_chars, lost_chars, base_failed, kept and gone (places of the boilerplate lines, null if none), a row for each row."""
    lines = host_lines(docs, doc, text, host)
    bad = frequent_lines(lines, limits)
    hit = lines.join(bad, lines["host"].eqNullSafe(bad["host"]) & (lines["line"] == bad["line"]), "left_semi")
    # Rows that are one document bring the same lines again.
    lost = hit.select("doc_id", "th", "host", "pos", "line", "chars").distinct().groupBy("doc_id", "th", "host").agg(F.sum("chars").alias("lost"), F.collect_set("pos").alias("gone"))
    lost = lost.select(F.col("doc_id").alias("l_doc"), F.col("th").alias("l_th"), F.col("host").alias("l_host"), "lost", "gone")
    stats = text_stats(docs, doc, text, host)
    out = stats.join(lost, stats["doc_id"].eqNullSafe(lost["l_doc"]) & (stats["th"] == lost["l_th"]) & stats["host"].eqNullSafe(lost["l_host"]), "left")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("lost_chars", F.coalesce("lost", F.lit(0)).cast("long")).withColumn("base_failed", base_failed)
    depleted = F.col("lost_chars") > limits.max_lost * F.col("line_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("l_doc", "l_th", "l_host", "lost")


def keep_good(docs: DataFrame, limits: LineLimits = LineLimits(), doc: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    rejected = judge(docs, limits, doc, text, host).filter(~F.col("kept")).select(F.col("doc_id").alias("_r_doc"), F.col("th").alias("_r_th"), F.col("host").alias("_r_host")).distinct()
    (th,) = fresh(docs, "_text_hash")
    rows = docs.withColumn(th, F.xxhash64(docs[text]))
    cond = rows[doc].eqNullSafe(rejected["_r_doc"]) & (rows[th] == rejected["_r_th"]) & rows[host].eqNullSafe(rejected["_r_host"])
    return rows.join(rejected, cond, "left_anti").drop(th)


def clean_good(docs: DataFrame, limits: LineLimits = LineLimits(), doc: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, with the boilerplate lines of their host cut from the text and the count of characters in n_chars renewed."""
    judged = judge(docs, limits, doc, text, host).filter(~F.col("kept") | F.col("gone").isNotNull())
    judged = judged.groupBy("doc_id", "th", "host").agg(F.min("kept").alias("_j_kept"), F.first("gone").alias("_j_gone"))
    judged = judged.select(F.col("doc_id").alias("_j_doc"), F.col("th").alias("_j_th"), F.col("host").alias("_j_host"), "_j_kept", "_j_gone")
    (th,) = fresh(docs, "_text_hash")
    rows = docs.withColumn(th, F.xxhash64(docs[text]))
    rows = rows.join(judged, rows[doc].eqNullSafe(judged["_j_doc"]) & (rows[th] == judged["_j_th"]) & rows[host].eqNullSafe(judged["_j_host"]), "left")
    rows = rows.filter(F.coalesce("_j_kept", F.lit(True)))
    rows = rows.withColumn(text, without_lines(F.col(text), F.col("_j_gone")))
    if n_chars:
        rows = rows.withColumn(n_chars, F.when(F.col("_j_gone").isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return rows.select(*docs.columns)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "lost_chars")
    return judge(table(spark, sf_dir, "documents")).select(*columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) r(j) GROUP BY doc_id),
raw AS (SELECT doc_id, host, md5(t) AS th, unnest(string_split(t, chr(10))) AS raw FROM d),
lines AS (SELECT doc_id, host, th, raw, lower(trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line FROM raw WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
per_doc AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT th) AS host_docs FROM lines GROUP BY host),
bad AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT th) AS n_docs FROM lines GROUP BY host, line)
  JOIN hosts USING (host) WHERE n_docs > 20 AND n_docs > 0.10 * host_docs),
lost AS (
  SELECT doc_id, sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (WHERE b.line IS NOT NULL), 0) AS lost_chars
  FROM (SELECT l.doc_id, l.line AS line, l.host FROM lines l) l LEFT JOIN bad b USING (host, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN per_doc USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT lost_chars > 0.5 * line_chars AS kept FROM judged
"""
