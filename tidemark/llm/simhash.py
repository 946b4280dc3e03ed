"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles.
Fingerprints that differ in at most two bits agree in two of four 16-bit blocks at least, so the distinct
fingerprints are dealt to six buckets each, by pair of blocks. Within a bucket they are compared bit-sliced:
bit planes are stored vertically, 64 fingerprints to a machine word; a fingerprint updates its distances to
64 others at once with carry-save bitwise counters, plane by plane, and a block of comparisons is abandoned
when every distance in it is above the radius. Each bucket hands on a star for each group it finds, never
all pairs, and the groups are joined across buckets by alternating large and small stars.

A bucket of more than ``BUCKET`` fingerprints is split before it is shuffled, by the same rule: of the 32
bits that its fingerprints don't share yet, two of four bytes agree, and of the 16 bits that are left after
that, two of four half bytes. So all links come from the bit-sliced comparison, no link is lost, and no
bucket of the last step can hold more than 256 fingerprints.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other. Very long texts
are counted piece by piece. Repeated rows give a row each. A null id is never a component's id unless the component has no other. An empty table
gives an empty result. Further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, small, table

RADIUS = 2
BUCKET = 4096  #: a bucket of more distinct fingerprints than this is split by further bits before it is compared
SMALL = 500_000  #: oversize buckets up to this many (8 MB) are sent to all tasks; more are joined by a shuffle
SEED = 42
PIECE = 65536  #: shingles of a text that are counted together
ROWS = 8192  #: comparisons of one fingerprint with 64 that are carried on together


def shingles(text: str | None, words: int = 3) -> Iterator[list[bytes]]:
    """The word shingles of a text piece by piece, repeats included; the whole of it if it has fewer words, nothing if it has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, both are ASCII only
    if 0 < len(w) <= words:
        yield [b" ".join(w)]
        return
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])) if w else ends
    del w
    for i in range(0, len(starts), PIECE):
        yield [line[a:b] for a, b in zip(starts[i : i + PIECE].tolist(), (ends[words - 1 :][i : i + PIECE] - 1).tolist(), strict=True)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes. Long texts are counted piece by piece."""
    ones, n = np.zeros(64, np.int64), 0
    for part in shingles(text, words):
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in part]), np.uint8)
        bits = np.unpackbits(h.reshape(-1, 8), axis=1)
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Columns doc_id, th (hash of the text), fp (the fingerprint as a signed long), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in x.column("text")), np.uint64, x.num_rows)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("th"), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(docs[doc].alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


def near(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within radius among fps of the same run; runs are the sorted run numbers.

    Bit planes stand vertically: word w of plane b holds bit b of 64 neighbouring fingerprints of a run.
    Wide fingerprints are rows of several integers.
    """
    n = len(fps)
    fps = fps.reshape(n, -1)
    n_bits = 64 * fps.shape[1]
    bit = lambda b, rows=slice(None): (fps[rows, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    length = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, length)
    word_start = np.flatnonzero(place % 64 == 0)  # where each word of 64 lanes begins
    word_of = np.cumsum(place % 64 == 0) - 1
    lane = (place % 64).astype(np.uint64)
    planes = np.empty((n_bits, len(word_start)), np.uint64)
    for b in range(n_bits):
        planes[b] = np.bitwise_or.reduceat(bit(b) << lane, word_start)
    held = np.bitwise_or.reduceat(np.uint64(1) << lane, word_start)
    # Each fingerprint meets its own word and the later words of its run.
    last_word = np.repeat(word_of[first + length - 1], length)
    meets = np.where(length.repeat(length) > 1, last_word - word_of + 1, 0)
    row = np.repeat(np.arange(n), meets)
    word = word_of[row] + (np.arange(len(row)) - np.repeat(np.cumsum(meets) - meets, meets))
    left, right = [], []
    for at in range(0, len(row), ROWS):
        i, w = row[at : at + ROWS], word[at : at + ROWS]
        own = word_of[i] == w
        later = np.where(own, ~((np.uint64(2) << lane[i]) - np.uint64(1)), ~np.uint64(0))  # each pair once
        over = ~(held[w] & later)  # lanes out of the race
        sums = [np.zeros(len(i), np.uint64) for _ in range(int(radius).bit_length())]
        for b in range(n_bits):
            carry = planes[b][w] ^ (np.uint64(0) - bit(b, i))
            for k, s in enumerate(sums):
                sums[k], carry = s ^ carry, s & carry
            over |= carry
            if b % (n_bits // 16) == n_bits // 16 - 1:
                over |= _above(sums, radius)
                if (alive := over != ~np.uint64(0)).sum() < 0.5 * len(i):
                    i, w, over, sums = i[alive], w[alive], over[alive], [s[alive] for s in sums]
                    if not len(i):
                        break
        if len(i):
            hits = ~(over | _above(sums, radius))
            r, c = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(i[r])
            right.append(word_start[w[r]] + c)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _above(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, in binary across sums, is over radius."""
    out, equal = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for k in reversed(range(len(sums))):
        bit = ~np.uint64(0) if radius >> k & 1 else np.uint64(0)
        out |= equal & sums[k] & ~bit
        equal &= ~(sums[k] ^ bit)
    return out


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n, the least index that it reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A star for each group within each bucket of a sorted partition. The last bucket of a batch waits for the next batch."""
    held = np.empty((3, 0), np.int64)

    def linked(x: np.ndarray) -> Iterator[pd.DataFrame]:
        if x.shape[1]:
            change = np.r_[True, (x[:2, 1:] != x[:2, :-1]).any(axis=0)]
            run = np.cumsum(change) - 1
            alone = np.bincount(run)[run] == 1
            fps, runs = x[2][~alone].view(np.uint64), run[~alone]
            if len(fps):
                label = _stars(len(fps), *near(fps, runs))
                i = np.flatnonzero(label != np.arange(len(fps)))
                yield pd.DataFrame({"a": fps[i].view(np.int64), "b": fps[label[i]].view(np.int64)})

    for batch in batches:
        x = np.hstack([held, batch[["way", "key", "fp"]].to_numpy(np.int64).T])
        same = (x[:2] == x[:2, -1:]).all(axis=0)  # of the last bucket
        yield from linked(x[:, ~same])
        held = x[:, same]
    yield from linked(held)


def _ways() -> list[list[int]]:
    """For each step, the masks of the bits by which its ways deal: six for each way of the step before.

    A step cuts the bits that its way has left open into four equal parts, and takes two of them.
    """
    steps, open_bits = [], [list(range(64))]
    for _ in range(3):
        masks, left = [], []
        for bits in open_bits:
            n = len(bits) // 4
            for i in range(4):
                for j in range(i):
                    rest = [b for k in range(4) if k not in (i, j) for b in bits[k * n : (k + 1) * n]]
                    mask = (1 << 64) - 1 - sum(1 << b for b in rest)
                    masks.append(mask - (1 << 64) if mask >> 63 else mask)
                    left.append(rest)
        steps.append(masks)
        open_bits = left
    return steps


def links(distinct: DataFrame, fp: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """Columns a, b: links between distinct fingerprints that span every group within the radius (of two)."""
    rows = checkpointed(distinct.select(F.col(fp).alias("fp"), F.lit(0).alias("way")))
    kept, steps = [], _ways()
    for masks in steps:
        dealt = rows.select("fp", F.explode(F.sequence(6 * F.col("way"), 6 * F.col("way") + 5)).alias("way"))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("way") + 1)))
        hot = None
        if masks is not steps[-1]:
            hot = checkpointed(dealt.groupBy("way", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("way", "key"))
            hot = None if hot.isEmpty() else small(hot, SMALL)
        here = dealt if hot is None else dealt.join(hot, ["way", "key"], "left_anti")
        kept.append(here.select(F.col("way").cast("long").alias("way"), "key", "fp").repartition("way", "key").sortWithinPartitions("way", "key"))
        if hot is None:
            break
        rows = checkpointed(dealt.join(hot, ["way", "key"], "left_semi").select("fp", "way"))
    found = [x.mapInPandas(_compare, "a long, b long") for x in kept]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns a, root: each end of an edge that isn't its component's least, with that least one.

    Alternating large and small stars: in each round, every node hands its least neighbour to its greater
    ones, then to its lesser ones, until all that is left is a star around each least node.
    """
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = checkpointed(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select("a", F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, th, fp, root (a fingerprint that names the component) and component_id (its least id), a row for each row."""
    marked = checkpointed(fingerprints(docs, doc, text))
    return named(marked, components(links(marked.select("fp").distinct())))


def named(marked: DataFrame, roots: DataFrame) -> DataFrame:
    """marked (doc_id, th, fp) with root and component_id, by the roots of components."""
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = least.join(roots, least["fp"] == roots["a"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = known.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_fp = known.join(best, known["root"] == best["r"]).select(F.col("fp").alias("f"), "root", "component_id")
    return marked.join(by_fp, marked["fp"] == by_fp["f"]).select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of docs, all columns, for each component: one with its least id (and of these, the least hash of its text)."""
    return first_of_each(docs, near_duplicates(docs, doc, text), doc, text)


def first_of_each(docs: DataFrame, groups: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of docs, all columns, for each root of groups (as near_duplicates gives them)."""
    best = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    best = best.select(F.col("x.doc_id").alias("_b_doc"), F.col("x.th").alias("_b_th"))
    th, key = fresh(docs, "_text_hash", "_key")
    rows = docs.withColumn(th, F.xxhash64(docs[text])).withColumn(key, F.coalesce(docs[doc].cast("string"), F.lit("null")))
    rows = rows.join(best, rows[doc].eqNullSafe(best["_b_doc"]) & (rows[th] == best["_b_th"]), "left_semi")
    return rows.dropDuplicates([key, th]).drop(key, th)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
