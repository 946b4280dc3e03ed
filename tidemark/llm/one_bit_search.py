"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on the mean of all, scaled to unit length, padded to ``BITS`` coordinates or more,
rotated by one random orthogonal matrix, and kept as the signs of their coordinates, packed in 64-bit words,
with two correction scalars: the distance from the centre, and the inner product of the rotated vector with
its own code. This index is written once. A query is rotated alike and quantised to eight bits a coordinate,
so that its inner product with a code is a sum of population counts over bit planes. Divided by the
correction scalar that estimates the true inner product, with an error bound that holds with high
probability; a vector whose lower bound on the distance is within the query's tenth best so far is reranked
with its original coordinates in double precision.

Every vector is indexed and compared; no bucket leaves any out. Queries are taken in blocks of about
``QUERY_BLOCK``, each of which is sent to all tasks and released when its neighbours are written. A first
pass over one of ``FIRST`` vectors, by a hash of their ids, gives each query a distance within which k
vectors lie; the pass over all starts from it, and a task hands on at most k neighbours within it.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
without an id, nor vectors of another length than the most common one (the least of these, if several).
Rows with a query's id are its own, so none of them is its neighbour; if rows with one id differ, the
least vector is the query. Repeated rows are candidates each. Equal distances go to the lesser id. Distances
beyond the range of doubles are infinite, and equal. Vectors are scaled by the greatest component before
anything but a distance is computed, so that finite ones don't overflow; beside an enormous vector codes
can't tell others apart, and these are reranked. An empty table gives an empty result. Further columns of
the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import checkpointed, shared_folder, table

K = 10
EVERY = 100
QUERY_BLOCK = 4096  #: queries that are sent to the tasks at a time, at most
FIRST = 64  #: one of so many vectors is in the first pass
BITS = 256  #: bits of a code, at least
CELLS = 1 << 21  #: comparisons that are carried on together (16 MB a matrix)
COMPONENTS = 1 << 21  #: components that are reranked together
EPSILON = 3.5  #: width of the error bound: about this many standard deviations of the estimate
SEED = 7


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Columns id, v (array of double) of the rows that can take part, of any length."""
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vec].cast("array<double>").alias("v"))
    return rows.filter("id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def rotation(wide: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))[0]


class Space:
    """The scale, the centre (after scaling) and the rotation that codes and queries share."""

    def __init__(self, centre: np.ndarray, scale: float):
        self.centre, self.scale, self.d = centre, scale, len(centre)
        self.wide = max(BITS, -(-self.d // 64) * 64)

    def turned(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rotated unit vectors, and their distances from the centre."""
        if not hasattr(self, "turn"):
            self.turn = rotation(self.wide)[: self.d]
        o = v / self.scale - self.centre
        norm = np.sqrt((o * o).sum(axis=1))
        return (o / np.where(norm > 0, norm, 1)[:, None]) @ self.turn, norm

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs (n, words), distance from the centre, inner product of each unit vector with its code."""
        o, norm = self.turned(v)
        own = np.abs(o).sum(axis=1) / math.sqrt(self.wide)
        return np.packbits(o > 0, axis=1, bitorder="little").view(np.uint64), norm, np.where(own > 0, own, 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "turn"}


class Queries:
    """A block of queries, rotated and quantised, with the best neighbours so far; none is wanted beyond limit."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, space: Space, k: int, limit: np.ndarray):
        self.ids, self.v, self.space, self.k, self.limit = ids, v, space, k, limit
        q, self.norm = space.turned(v)
        self.low = q.min(axis=1)
        self.step = np.maximum((q.max(axis=1) - self.low) / 255, 1e-12)
        level = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(level >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(8)]
        self.total = level.sum(axis=1, dtype=np.int64)
        self.best = np.full((len(v), k), np.inf)
        self.best_id = np.full((len(v), k), np.iinfo(np.int64).max)
        self.filled = np.zeros(len(v), np.int64)
        self.reranked = 0

    def bounds(self, code: np.ndarray, norm: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of unit vectors (queries by candidates), and lower bounds on the squared distances."""
        wide = self.space.wide
        dots = np.zeros((len(self.v), len(code)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                dots += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int32) << b
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        # The code's coordinates are +-1 / sqrt(wide): twice the sum over its ones, less the sum over all.
        estimate = dots * self.step[:, None]
        estimate += self.low[:, None] * ones
        estimate *= 2
        estimate -= (self.total * self.step + self.low * wide)[:, None]
        estimate /= math.sqrt(wide) * own
        error = EPSILON * np.sqrt(np.maximum(0, 1 - own**2) / own**2 / (wide - 1)) + 1e-9
        # Rounding the query to eight bits moves the estimate by sqrt(wide) / 2 steps at most.
        inner = np.minimum(1, estimate + error + (self.step * math.sqrt(wide) / 2)[:, None] / own)
        return estimate, norm**2 + self.norm[:, None] ** 2 - 2 * norm * self.norm[:, None] * inner

    def take(self, ids: np.ndarray, v: np.ndarray, code: np.ndarray, norm: np.ndarray, own: np.ndarray) -> None:
        """Compares the candidates with all queries, and keeps the best."""
        estimate, bound = self.bounds(code, norm, own)
        other = ids != self.ids[:, None]
        if (few := np.flatnonzero(self.filled < self.k)).size:
            # Queries without k neighbours yet begin with those that seem nearest.
            seems = np.where(other[few], norm**2 - 2 * norm * self.norm[few, None] * estimate[few], np.inf)
            m = min(4 * self.k, len(ids))
            near = np.argpartition(seems, m - 1, axis=1)[:, :m]
            q, c = np.repeat(few, m), near.ravel()
            fine = other[q, c]
            self._rerank(q[fine], c[fine], ids, v)
            other[q, c] = False
        with np.errstate(over="ignore"):
            at = np.where(self.filled < self.k, self.limit, np.minimum(self.limit, self.best[:, -1])) / self.space.scale
            at = at * at * (1 + 1e-9) + 1e-12
        q, c = np.nonzero((bound <= at[:, None]) & other)
        self._rerank(q, c, ids, v)

    def _rerank(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.reranked += len(q)
        some = max(1, COMPONENTS // self.space.d)
        for i in range(0, len(q), some):
            self._merge(q[i : i + some], c[i : i + some], ids, v)

    def _merge(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            gap = self.v[q] - v[c]
            gap *= gap
            d = np.sqrt(np.cumsum(gap, axis=1, out=gap)[:, -1])  # added from left to right, as SQL adds
        n, k = self.best.shape
        # Empty places come after all that are taken, infinite distances too.
        empty = np.concatenate(((np.arange(k) >= self.filled[:, None]).ravel(), np.zeros(len(q), bool)))
        q = np.concatenate((np.repeat(np.arange(n), k), q))
        d = np.concatenate((self.best.ravel(), d))
        i = np.concatenate((self.best_id.ravel(), ids[c]))
        order = np.lexsort((i, d, empty, q))
        q, d, i, empty = q[order], d[order], i[order], empty[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        keep = place < k
        self.best, self.best_id = d[keep].reshape(n, k), i[keep].reshape(n, k)
        self.filled = (~empty[keep]).reshape(n, k).sum(axis=1)

    def found(self) -> pa.RecordBatch:
        q, r = np.nonzero((np.arange(self.k) < self.filled[:, None]) & (self.best <= self.limit[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.best_id[q, r]), pa.array(self.best[q, r])], ["query_id", "vec_id", "score"])


def _array(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _index(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for x in batches:
        code, norm, own = space.codes(_array(x.column("v"), space.d))
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(list(code.view(np.int64)), pa.list_(pa.int64())), pa.array(norm), pa.array(own)], ["id", "v", "code", "norm", "own"])


def _compare(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    q = None
    for x in batches:
        q = q or Queries(*block.value)
        v, code = _array(x.column("v"), q.space.d), _array(x.column("code"), q.space.wide // 64).view(np.uint64)
        rest = [x.column(c).to_numpy() for c in ("id", "norm", "own")]
        step = max(1, CELLS // len(q.ids))
        for i in range(0, len(v), step):
            ids, norm, own = (y[i : i + step] for y in rest)
            q.take(ids, v[i : i + step], code[i : i + step], norm, own)
    if q:
        yield q.found()


def search(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors for each row of queries (same columns)."""
    fine, spark = usable(vectors, key, vec), vectors.sparkSession
    most = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not most:
        return empty
    d = most["d"]
    fine = fine.filter(F.size("v") == d)
    scale = fine.agg(F.max(F.expr("array_max(transform(v, x -> abs(x)))"))).first()[0]
    centre = np.array(fine.agg(*[F.avg(F.col("v")[i] / scale).alias(f"c{i}") for i in range(d)]).first(), dtype=float)
    space = Space(centre, scale)
    index = checkpointed(fine.mapInArrow(partial(_index, space=space), "id long, v array<double>, code array<long>, norm double, own double"))
    asked = checkpointed(usable(queries, key, vec).filter(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() // (QUERY_BLOCK * 3 // 4))  # dealt by a hash: three quarters full on average
    out = shared_folder(spark, "neighbours")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        order = np.argsort(ids := rows.column("id").to_numpy())
        ids, v = ids[order], _array(rows.column("v").combine_chunks(), d)[order]
        limit = np.full(len(ids), np.inf)
        for part in (index.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FIRST)) == 0), index):
            block = spark.sparkContext.broadcast((ids, v, space, k, limit))
            found = part.mapInArrow(partial(_compare, block=block), "query_id long, vec_id long, score double")
            found = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if part is index:
                found.write.mode("append").parquet(out)
            else:
                kth = found.filter(F.col("rank") == k).select("query_id", "score").toArrow()
                limit[np.searchsorted(ids, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
            block.destroy()
    return spark.read.schema(empty.schema).parquet(out) if blocks else empty


def op3_one_bit_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
