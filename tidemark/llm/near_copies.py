"""SimHash near-dedup by five-word shingles at a similarity of 0.8.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more, and
the groups are what links connect. Each set has a fingerprint of ``BITS`` bits, by majority over its
shingles' hashes. Which fingerprints are compared is settled by MinHash: a set is dealt to ``BANDS`` buckets,
each by the least values of ``ROWS`` hash functions, so that a pair at 0.8 misses all of them in 7 of 100,000
cases, and a pair at 0.85 in one of a million. Within a bucket the fingerprints are compared bit-sliced, by
:func:`simhash.near`, and blocks are abandoned once all distances are above ``RADIUS``; pairs within it are
verified by the exact similarity of the whole sets. Only a star for each group is handed on, never all pairs.

At 0.8, 39 of 256 bits differ on average with a deviation of 6, so the radius of 80 lies seven deviations
away, and sets with nothing in common differ in 128. (For the same reason fingerprints can't be dealt by
their own blocks, as operator 8 deals them at a radius of two: blocks that are sure to agree would be of
three bits.)

Texts with the same set are one before they are dealt. Buckets with the same members are compared once. A
bucket of more than ``BLOCK`` sets is cut into blocks and each two blocks are compared in a task of their own,
so that nothing of it is left out and no task holds more than two blocks of it, beside ``TOGETHER`` sets of
small buckets.

Edge cases: texts of fewer words are one shingle; null, empty and blank texts have the empty set and are one
group. Repeated rows give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import checkpointed, small

WORDS = 5
PERCENT = 80  #: of the shingles of both texts that they have in common, to be linked
BANDS = 24
ROWS = 5
BITS = 256
RADIUS = 80  #: sets whose fingerprints differ in more bits aren't verified
TOGETHER = 1024  #: sets of small buckets that are compared together, about
BLOCK = 512  #: sets of a bucket that are compared in one task; of a larger bucket, each two blocks
SMALL = 500_000  #: keys or texts up to this many (16 MB) are sent to all tasks; more are joined by a shuffle
PIECE = 2048  #: shingles that meet all hash functions together
_RNG = np.random.default_rng(simhash.SEED)
_FACTOR = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the text's different shingles, in order."""
    parts = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, simhash.SEED) for x in p]), np.uint64)) for p in simhash.shingles(text, words)]
    return np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def band_keys(s: np.ndarray) -> np.ndarray:
    """The keys of the buckets of a set; none if it is empty."""
    if not len(s):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(s), PIECE):
        np.minimum(low, (s[i : i + PIECE] * _FACTOR + _PLUS).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def marks(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Columns doc_id, th (hash of the text), fp (hash of its set) and keys (its buckets), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps, keys = np.zeros(x.num_rows, np.uint64), []
            for i, t in enumerate(x.column("text")):
                s = shingle_set(t.as_py(), words)
                fps[i] = xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED)
                keys.append(band_keys(s))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("th"), pa.array(fps.view(np.int64)), lists], ["doc_id", "th", "fp", "keys"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(docs[doc].alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long, keys array<long>")


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """BITS bits as integers of 64; a bit is set if it is set in over half of the hashes, each mixed anew for every integer."""
    out = np.zeros(BITS // 64, np.uint64)
    for k in range(len(out)):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(s), PIECE):
            x = s[i : i + PIECE] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]
    return out


def stars(sets: list[np.ndarray], marks: np.ndarray, runs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set, the first one of its run that it reaches over links; marks are the fingerprints, a row each."""
    a, b = simhash.near(marks, runs, RADIUS)
    src, dst = np.r_[a, b], np.r_[b, a]
    order = np.lexsort((dst, src))
    dst, start = dst[order], np.searchsorted(src[order], np.arange(len(sets) + 1))
    n = np.array([len(x) for x in sets])
    label = np.full(len(sets), -1)
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root], todo = root, [root]
        while todo:
            p = todo.pop()
            c = dst[start[p] : start[p + 1]]
            c = c[label[c] < 0]
            if len(c):
                theirs = np.concatenate([sets[i] for i in c])
                at = np.minimum(np.searchsorted(sets[p], theirs), n[p] - 1)
                common = np.add.reduceat(sets[p][at] == theirs, np.cumsum(n[c]) - n[c], dtype=np.int64)
                new = c[100 * common >= percent * (n[c] + n[p] - common)]
                label[new] = root
                todo += new.tolist()
    return label


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stars within the groups of a partition that is sorted by group; small groups are compared together."""
    last, fps, marks, sets, runs = None, [], [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        f = np.array(fps, np.int64)
        label = stars(sets, np.array(marks), np.array(runs), percent)
        i = np.flatnonzero(label != np.arange(len(f)))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[label[i]])], ["a", "b"])
        for x in (fps, marks, sets, runs):
            x.clear()

    for x in batches:
        for g, fp, m, s in zip(x.column("g").to_pylist(), x.column("fp").to_pylist(), x.column("mark"), x.column("s"), strict=True):
            if g != last and len(sets) >= TOGETHER:
                yield from flush()
            runs.append(runs[-1] + (g != last) if runs else 0)
            last = g
            fps.append(fp)
            marks.append(np.frombuffer(m.as_py(), np.uint64))
            sets.append(np.frombuffer(s.as_py(), np.uint64))
    if sets:
        yield from flush()


def links(docs: DataFrame, marked: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Columns a, b: verified links between sets (by fp) that span the groups among all candidates."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("th").alias("th"), F.first("keys").alias("keys")))
    dealt = distinct.select("fp", "th", F.explode("keys").alias("key"))
    often = checkpointed(dealt.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    met = checkpointed(dealt.join(small(often, SMALL), "key"))
    few = met.filter(F.col("m") <= BLOCK).groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("fps")).select("fps").distinct()
    few = few.select(F.xxhash64("fps").alias("g"), F.explode("fps").alias("fp"))
    many = met.filter(F.col("m") > BLOCK).withColumn("n", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")).withColumn("i", F.expr("pmod(xxhash64(key, fp), n)"))
    many = many.select(F.expr("explode(transform(filter(sequence(0L, n - 1), j -> j <> i), j -> xxhash64(key, least(i, j), greatest(i, j))))").alias("g"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingle_set(t.as_py(), words) for t in x.column("text")]
            marks = [wide_fingerprint(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([x.column("fp"), pa.array(marks, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "mark", "s"])

    need = checkpointed(met.select("fp", "th").distinct())
    texts = docs.select(F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).join(small(need, SMALL), "th").groupBy("fp").agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(run, "fp long, mark binary, s binary")
    grouped = few.union(many).join(sets, "fp").select("g", "fp", "mark", "s").repartition("g").sortWithinPartitions("g")
    return checkpointed(grouped.mapInArrow(partial(_verified, percent=percent), "a long, b long"))


def near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Columns doc_id, th, fp, root (a set that names the group) and component_id (its least id), a row for each row."""
    marked = checkpointed(marks(docs, doc, text, words))
    return simhash.named(marked, simhash.components(links(docs, marked, text, words, percent)))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row of docs, all columns, for each group: one with its least id (and of these, the least hash of its text)."""
    return simhash.first_of_each(docs, near_copies(docs, doc, text, words, percent), doc, text)
