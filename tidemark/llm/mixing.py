"""Mixing sources to target weights by Pfair scheduling.

Each source has a weight in whole parts. Its rows, in the order of a hash of their ids, form blocks of
``block_rows``. Time is counted in slots of one block, and goes in periods: a period holds as many blocks
of a source as the source has parts (or has left). Within a period of L slots, block j of a source with m
blocks is released at floor(j L / m) and due at ceil((j + 1) L / m). In each slot the earliest deadline
among the released blocks goes first (ties to the first source by name), so that at every slot each source
is less than one block from its share.

Whole result: no row is dropped or repeated. A source that runs out leaves its share to the others in
proportion to their parts. A period's schedule depends only on what each source still has to give, so that
a corpus of any size has at most two schedules for each source and one more; these are computed by a fold
over slots, and all rows find their slots by a join.

Edge cases: sources that aren't named, null included, form the one source ``*`` (``rest`` parts); its rows
are mixed among themselves by the hash. Null ids and texts are allowed. Repeated rows each have a place;
which of equal rows comes first isn't defined. An empty table gives an empty result. Further columns of
the input pass through :func:`mixed` unchanged.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import checkpointed, fresh, ranked_by_hash, small, table

#: Parts of 100 for the twenty sources of the test tables, falling slowly; any other source is in the rest.
PARTS = {"src0": 16, "src1": 12, "src2": 10, "src3": 8, "src4": 6, "src5": 5} | {f"src{i}": 3 for i in range(6, 20)}
REST = 1
BLOCK_ROWS = 8
SLOTS_SENT = 200_000  #: slots of all schedules that are sent to all tasks (about 10 MB); more are joined by a shuffle
BUCKET_ROWS = 2_000  #: rows that are ranked in one task, about


def ranked(docs: DataFrame, parts: dict[str, int], doc: str, text: str, source: str) -> DataFrame:
    """Columns doc_id, source, src, th, rank: the place of each row in its source, from 0."""
    names = F.array(*[F.lit(x) for x in parts]) if parts else F.array().cast("array<string>")
    src = F.when(F.array_contains(names, docs[source].cast("string")), docs[source].cast("string")).otherwise(F.lit("*"))
    rows = docs.select(
        docs[doc].alias("doc_id"), docs[source].alias("source"), F.coalesce(src, F.lit("*")).alias("src"), F.xxhash64(docs[text]).alias("th"),
        F.md5(F.coalesce(docs[doc].cast("string"), F.lit("")).cast("binary")).alias("h"), F.crc32(docs[text]).alias("crc"),
    )
    placed = ranked_by_hash(rows, "src", "h", "crc", BUCKET_ROWS, docs.count())
    return placed.select("doc_id", "source", "src", "th", F.col("place").alias("rank"))


def schedule(blocks: DataFrame, parts: dict[str, int], rest: int) -> tuple[DataFrame, DataFrame]:
    """The schedules for sources of n blocks; blocks: src, n.

    Gives (1) src, p (its parts), first (the periods, from 0, at which a new schedule begins) and all (every
    source with its parts and blocks), and (2) from_period, src, idx (block of the source within the period),
    release, deadline, slot (all three within the period). Both are bounded by the weights, not by the rows.
    """
    weight = F.coalesce(*[F.when(F.col("src") == k, F.lit(v)) for k, v in parts.items()], F.lit(rest))
    one = blocks.withColumn("p", weight.cast("long")).agg(F.array_sort(F.collect_list(F.struct("src", "p", "n"))).alias("all"))
    one = one.withColumn("first", F.expr("array_sort(array_distinct(concat(array(0L), flatten(transform(all, s -> array(s.n div s.p, s.n div s.p + 1))))))"))
    by_source = one.select(F.explode("all").alias("s"), "first", "all").select("s.src", "s.p", "first", "all")
    period = one.select(F.explode("first").alias("k"), "all").withColumn("m", F.expr("transform(all, s -> greatest(0L, least(s.p, s.n - k * s.p)))"))
    period = period.withColumn("len", F.expr("aggregate(m, 0L, (a, x) -> a + x)")).filter("len > 0")
    # The state is how many blocks of each source have gone; each slot appends the source that it takes.
    due = "transform(m, (x, i) -> CASE WHEN acc.c[i] < x AND (acc.c[i] * len) div x <= t THEN struct(((acc.c[i] + 1) * len + x - 1) div x AS d, i AS i) END)"
    fold = f"""
        aggregate(sequence(0L, len - 1), struct(transform(m, x -> 0L) AS c, CAST(array() AS array<int>) AS took),
                  (acc, t) -> element_at(transform(array(array_min({due}).i),
                      b -> struct(transform(acc.c, (x, i) -> x + CASE WHEN i = b THEN 1L ELSE 0L END) AS c, array_append(acc.took, b) AS took)), 1),
                  acc -> acc.took)"""
    took = period.select("k", "m", "len", "all", F.posexplode(F.expr(fold)).alias("slot", "i"))
    idx = F.row_number().over(Window.partitionBy("k", "i").orderBy("slot")) - 1
    took = took.withColumn("idx", idx.cast("long")).withColumn("of", F.expr("m[i]"))
    slots = took.select(
        F.col("k").alias("from_period"), F.expr("all[i].src").alias("src"), "idx",
        F.expr("(idx * len) div of").alias("release"), F.expr("((idx + 1) * len + of - 1) div of").alias("deadline"), F.col("slot").cast("long").alias("slot"),
    )
    return by_source, small(checkpointed(slots), SLOTS_SENT)


def mix(docs: DataFrame, parts: dict[str, int] | None = None, rest: int = REST, block_rows: int = BLOCK_ROWS, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, th, src, rank, release, deadline, slot and offset (place in the block), for each row."""
    parts = PARTS if parts is None else parts
    if min([rest, *parts.values()]) < 1 or sum(parts.values()) + rest > 10_000:
        raise ValueError("parts must be whole and positive, and at most 10,000 in all")
    rows = ranked(docs, parts, doc, text, source)
    blocks = rows.groupBy("src").agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("n"))
    by_source, slots = schedule(blocks, parts, rest)
    placed = rows.withColumn("block", F.expr(f"rank div {block_rows}")).join(F.broadcast(by_source), "src")
    placed = placed.withColumn("period", F.expr("block div p")).withColumn("idx", F.expr("block % p"))
    placed = placed.withColumn("from_period", F.expr("array_max(filter(first, k -> k <= period))")).withColumn("start", F.expr("aggregate(all, 0L, (a, s) -> a + least(s.n, period * s.p))"))
    placed = placed.drop("first", "all").join(slots, ["src", "from_period", "idx"])
    at = [(F.col("start") + F.col(c)).alias(c) for c in ("release", "deadline", "slot")]
    return placed.select("doc_id", "source", "th", "src", "rank", *at, F.expr(f"rank % {block_rows}").alias("offset"))


def mixed(docs: DataFrame, parts: dict[str, int] | None = None, rest: int = REST, block_rows: int = BLOCK_ROWS, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of docs, sorted in the order of the mix."""
    (th,) = fresh(docs, "_text_hash")
    order = mix(docs, parts, rest, block_rows, doc, text, source)
    # Rows that agree in id, source and text stand together, at the first of their places.
    order = order.groupBy(F.col("doc_id").alias("_m_doc"), F.col("source").alias("_m_source"), F.col("th").alias("_m_th")).agg(F.min(F.struct("slot", "offset")).alias("_m_at"))
    rows = docs.withColumn(th, F.xxhash64(docs[text]))
    rows = rows.join(order, rows[doc].eqNullSafe(order["_m_doc"]) & rows[source].eqNullSafe(order["_m_source"]) & (rows[th] == order["_m_th"]))
    return rows.orderBy("_m_at").drop("_m_doc", "_m_source", "_m_th", "_m_at", th)


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """docs, as :func:`mixed` was written and is read again, with each row's place in the order of the files' names and rows, from 0.

    Written tables go by the numbers in the names of their files (``part-<number>``), then by the names. The
    places are null if docs isn't read from files directly.
    """
    file, row, n, first = fresh(docs, "_file", "_row", "_n", "_first")
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))
    sizes = rows.groupBy(file).agg(F.count("*").alias(n))  # a row for each file
    number = F.regexp_extract(file, r"^part-(\d+)", 1).try_cast("long")  # has five digits or more, so names sort by it only up to 99,999
    sizes = sizes.select(F.col(file), (F.sum(n).over(Window.orderBy(number.asc_nulls_last(), file)) - F.col(n)).alias(first))
    return rows.join(sizes, file).withColumn(name, F.col(first) + F.col(row)).drop(file, row, first)


def op4_pfair_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "src", "rank", "release", "deadline", "slot", "offset")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IN ({", ".join(f"'{k}'" for k in PARTS)}) THEN source ELSE '*' END AS src FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM d),
tot AS (
  SELECT src, CAST(CASE src {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PARTS.items())} ELSE {REST} END AS BIGINT) AS p,
         CAST((count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS BIGINT) AS n, row_number() OVER (ORDER BY src) AS i FROM r GROUP BY src),
ks AS (SELECT DISTINCT k FROM (SELECT 0 AS k UNION ALL SELECT n // p FROM tot UNION ALL SELECT n // p + 1 FROM tot)),
comp AS (SELECT k, list(greatest(0, least(p, n - k * p)) ORDER BY i) AS m FROM ks, tot GROUP BY k),
lens AS (SELECT k, m, list_sum(m) AS len FROM comp WHERE list_sum(m) > 0),
edf AS (
  SELECT k, m, len, CAST(-1 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS took, list_transform(m, lambda x: CAST(0 AS BIGINT)) AS c FROM lens
  UNION ALL
  SELECT k, m, len, t + 1, b, list_transform(c, lambda x, j: CASE WHEN j = b THEN x + 1 ELSE x END) FROM (
    SELECT *, list_min(list_filter(list_transform(m, lambda x, j:
        CASE WHEN c[j] < x AND (c[j] * len) // x <= t + 1 THEN (((c[j] + 1) * len + x - 1) // x) * 1000 + j END), lambda y: y IS NOT NULL)) % 1000 AS b
    FROM edf WHERE t + 1 < len)),
slots AS (
  SELECT e.k AS from_period, tot.src, e.t AS slot, e.m[took] AS m, e.len,
         row_number() OVER (PARTITION BY e.k, took ORDER BY e.t) - 1 AS idx
  FROM edf e JOIN tot ON tot.i = e.took WHERE e.t >= 0),
placed AS (
  SELECT r.*, r.rank // {BLOCK_ROWS} AS block, (r.rank // {BLOCK_ROWS}) // p AS period, (r.rank // {BLOCK_ROWS}) % p AS idx FROM r JOIN tot USING (src)),
starts AS (SELECT period, sum(least(n, period * p)) AS start FROM (SELECT DISTINCT period FROM placed), tot GROUP BY period),
froms AS (SELECT period, max(k) AS from_period FROM (SELECT DISTINCT period FROM placed), ks WHERE k <= period GROUP BY period)
SELECT doc_id, source, src, CAST(rank AS BIGINT) AS rank, CAST(start + (idx * len) // m AS BIGINT) AS release,
       CAST(start + ((idx + 1) * len + m - 1) // m AS BIGINT) AS deadline, CAST(start + slot AS BIGINT) AS slot, CAST(rank % {BLOCK_ROWS} AS BIGINT) AS offset
FROM placed JOIN starts USING (period) JOIN froms USING (period) JOIN slots USING (src, from_period, idx)
"""
