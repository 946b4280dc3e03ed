"""Removal of lines that are spread over many sites.

Each line (white space around it trimmed, lower-cased, of a word or more) is hashed, and a HyperLogLog sketch of the sites that
have it is merged for each hash by aggregation. Lines estimated well above the threshold are boilerplate,
lines well below aren't; the sites of those within ``band`` standard errors are counted exactly. A
boilerplate line stays at its first place (least document id, then least position) and goes everywhere
else, so that no line is lost to the corpus: neither a boilerplate line nor a copied article.

Edge cases: a null text stays null, a text keeps its lines without words, and a text whose lines all go
becomes empty; documents are never dropped. A very long text is cut in time that grows with its length alone,
and its lines are grouped with all others', so no task holds more than the one text. A null site counts for nothing. Rows that agree in id and text
are one document. Null ids come first in order. An empty table gives an empty result. Further columns of
the input pass through :func:`dedup_lines` unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, has_word, lines_of, normal, small, table, without_lines

SMALL = 500_000  #: lines up to this many (16 MB) are sent to all tasks; more are joined by a shuffle


@dataclass(frozen=True)
class Spread:
    min_sites: int = 10  #: a line on this many sites is boilerplate
    lg_k: int = 12  #: log2 of the sketch's registers; a relative standard error of 1.04 / sqrt(2 ** lg_k)
    band: float = 5.0  #: standard errors around min_sites within which sites are counted exactly

    @property
    def slack(self) -> float:
        return self.band * 1.04 / 2 ** (self.lg_k / 2)


def site_lines(docs: DataFrame, doc: str, text: str, site: str) -> DataFrame:
    """Columns doc_id, th, site, pos, line (hash), for each line with a word."""
    lines = docs.select(docs[doc].alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[site].cast("string").alias("site"), F.posexplode(lines_of(docs[text])).alias("pos", "l"))
    return lines.filter(has_word(F.col("l"))).select("doc_id", "th", "site", "pos", F.xxhash64(normal(F.col("l"))).alias("line"))


def spread_lines(lines: DataFrame, rule: Spread = Spread()) -> DataFrame:
    """Columns line, first: the lines on min_sites sites or more, with the (doc_id, pos) that stays."""
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", rule.lg_k).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"))
    judged = checkpointed(sketches.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= rule.min_sites * (1 - rule.slack)))
    near = judged.filter(F.col("sites") <= rule.min_sites * (1 + rule.slack)).select("line")
    exact = lines.join(small(near, SMALL), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("exact"))
    return judged.join(exact, "line", "left").filter(F.coalesce("exact", F.col("sites")) >= rule.min_sites).select("line", "first")


def removed_lines(docs: DataFrame, rule: Spread = Spread(), doc: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Columns doc_id, th, gone: the positions of the lines that each document loses, where it loses any."""
    lines = site_lines(docs, doc, text, site)
    found = checkpointed(spread_lines(lines, rule))
    here = F.struct("doc_id", "pos")
    hits = lines.join(small(found, SMALL), "line").filter(~here.eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, rule: Spread = Spread(), doc: str = "doc_id", text: str = "text", site: str = "source", n_chars: str | None = None) -> DataFrame:
    """docs with the boilerplate lines cut from the text, and the count of characters in n_chars renewed.

    Two columns follow: n_lines (of the old text) and n_removed, under names that docs doesn't have.
    """
    th, n_lines, n_removed = fresh(docs, "_text_hash", "n_lines", "n_removed")
    gone = removed_lines(docs, rule, doc, text, site).select(F.col("doc_id").alias("_g_doc"), F.col("th").alias("_g_th"), F.col("gone").alias("_g_gone"))
    rows = docs.withColumn(th, F.xxhash64(docs[text]))
    rows = rows.join(gone, rows[doc].eqNullSafe(gone["_g_doc"]) & (rows[th] == gone["_g_th"]), "left")
    cut = without_lines(F.col(text), F.col("_g_gone"))
    rows = rows.withColumn(n_lines, F.coalesce(F.size(lines_of(F.col(text))), F.lit(0)).cast("long")).withColumn(n_removed, F.coalesce(F.size("_g_gone"), F.lit(0)).cast("long"))
    rows = rows.withColumn(n_lines, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col(n_lines)).cast("long"))
    rows = rows.withColumn(n_removed, F.when(F.col("_g_gone").isNull(), F.lit(0)).otherwise(F.col(n_removed)).cast("long")).withColumn(text, cut)
    if n_chars:
        rows = rows.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return rows.drop("_g_doc", "_g_th", "_g_gone", th)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, source, i - 1 AS pos, l[i] AS raw
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))),
lines AS (SELECT *, lower(trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS line FROM raw WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
bad AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM lines SEMI JOIN bad USING (line)) WHERE n > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(raw, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL) AS t
         FROM raw r LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(CASE WHEN text IS NOT NULL THEN length(coalesce(t, '')) END AS BIGINT) AS kept_chars,
       CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS kept_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""
