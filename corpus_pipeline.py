"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

Each stage works on all that the one before it kept. All but the last return the columns of documents.

Edge cases, beside those of the operators: null, empty and blank texts fail the quality rules. Very long texts
pass every stage whole. Rows that agree in id and text are one document and share its fate; the near-duplicate
stage keeps one of them, as it does of texts with the same words under different ids: the least id. An empty
table gives an empty result. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, line_dedup, mixing, near_copies, quality_rules
from tidemark.llm.common import fresh, shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without the boilerplate lines of their host."""
    return quality_rules.clean_good(docs, n_chars="n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that are spread over many sites."""
    return line_dedup.dedup_lines(docs, n_chars="n_chars").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: bit-sliced fingerprints of five-word shingles, a similarity of 0.8."""
    return near_copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order that gives each source its share at every point."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, digests of its ids and of what they decode to, and mix_place, its place in the mix from 0."""
    (place,) = fresh(docs, "mix_place")
    return byte_bpe.round_trip(mixing.with_place(docs, place), carry=(place,)).withColumnRenamed(place, "mix_place")


STAGES = [("quality rules", rules), ("line dedup", lines), ("simhash near-dedup", copies), ("source mix", mix), ("byte-level BPE", tokens)]

#: SimHash components and BPE are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; between stages the rows are written to the folder that the cluster shares."""
    out = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
