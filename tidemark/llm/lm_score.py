"""Cross-entropy difference between matched target and background n-gram models.

Both models share one vocabulary, every word of the corpus, and are bigram models over all of it: a word's
probability after the word before it is (pairs + PRIOR * unigram) / (times of that word + PRIOR), and its
unigram probability has additive smoothing over the vocabulary. The end of a text is an outcome too, counted
but not scored. The background model counts every document, the target model every document of the target
set. A document is scored by models that haven't seen it: its own counts are taken out of both. Its score is
the mean over its tokens of target loss less background loss, in nats: the lower, the more it is like the
target.

All counts take in the whole corpus and grow with it. What is sent to the tasks is bounded: the counts of at
most ``WORDS_SENT`` frequent words, and of at most ``PAIRS_SENT`` frequent pairs among the ``HEAD`` most
frequent words; sending them merely saves their lookup. Every other pair or word of a document meets the
others of its key in a shuffle, where all are added up and each takes its own share out, and what others add
goes back to the document's piece of the corpus. Tasks hand these on in bundles, one for each piece and bucket
of keys; there are as many buckets as ``BUCKET`` needs. No such key
is in over 1 / HEAD of the tokens, as one of its words is outside the head, or it was too rare to send. Keys
are 64-bit hashes.

Edge cases: null and texts without a word have no tokens and null losses. Repeated rows are counted and
scored each, so that each is known from the other. A word of over ``LONG`` characters stands as its digest.
Very long texts are read whole. Without a target document the target model is uniform. An empty table gives
an empty result. Further columns of the input are not looked at.

The documents should come from files or a checkpoint, so that a task that is run again meets its rows in the
same order; what this module shuffles itself it brings into order (:func:`in_order`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table

HEAD = 8192  #: words whose pairs may be sent
WORDS_SENT = 1 << 18  #: words, at most, whose counts are sent to all tasks (about 10 MB)
PAIRS_SENT = 1 << 20  #: pairs, at most, whose counts are sent to all tasks (24 MB)
LONG = 64  #: characters of a word that stands for itself
PRIOR = 50.0  #: tokens that the unigrams count for after each word
ADD = 0.5  #: what each word's unigram count has in advance
SMALL_SET = 4_000_000  #: target documents up to this many are sent to all tasks (their ids: 32 MB); more are joined by a shuffle
FLUSH = 400_000  #: distinct words that a task counts before it hands its counts on
TOKENS = 1 << 19  #: tokens, about, that are worked on together
BUCKET = 1 << 20  #: tokens of the corpus to a bucket of keys, whose rows meet in one task
LEAST_BUCKETS = 16
WORDS = re.compile(r"\w+")
START = 1 << 62  #: stands before the first word
_LATIN = bytes(ord(chr(i).lower()) if WORDS.match(chr(i).lower()) else 32 for i in range(256))


def words(text: str | None) -> list[str]:
    """The runs of word characters of the lower-cased text."""
    if not text:
        return []
    try:
        w = text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        w = WORDS.findall(text.lower())
    if max(map(len, w), default=0) > LONG:
        w = [x if len(x) <= LONG else " " + xxhash.xxh3_128_hexdigest(x.encode("utf-8", "surrogatepass")) for x in w]
    return w


def _marked(docs: DataFrame, text: str, target: str, *more: Column) -> DataFrame:
    return docs.select(*more, docs[text].alias("text"), F.coalesce(docs[target].cast("int"), F.lit(0)).alias("target"))


def word_counts(docs: DataFrame, text: str = "text", target: str = "target") -> DataFrame:
    """Columns word, n, n_target: how often each word comes in all documents, and in those of the target; '' comes once in each text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())  # outside the target, in it

        def flush() -> Iterator[pa.RecordBatch]:
            for flag, c in enumerate(seen):
                n = pa.array(c.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), n, n if flag else pa.array(np.zeros(len(c), np.int64))], ["word", "n", "n_target"])
                c.clear()

        for x in batches:
            for t, flag in zip(x.column("text"), x.column("target").to_pylist(), strict=True):
                if w := words(t.as_py()):
                    seen[flag].update(w)
                    seen[flag][""] += 1
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    return _marked(docs, text, target).mapInArrow(run, "word string, n long, n_target long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """The rows of counts with the greatest n: so many at most, by steps of an eighth of a power of two, the greatest first."""
    level = F.floor(F.log2("n") * 8).cast("int")
    kept, cut = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), reverse=True):  # 512 levels at most
        kept += r["c"]
        if kept > most:
            break
        cut = r["level"]
    got = counts.filter(level >= cut).toArrow()
    return got.take(np.argsort(-got.column("n").to_numpy(), kind="stable"))


class Vocabulary:
    """The words that are sent, numbered by frequency; every other word has a negative number from its hash."""

    def __init__(self, sent: pa.Table, head: int):
        self.ids = {w: i for i, w in enumerate(sent.column("word").to_pylist())}
        self.head = min(head, len(self.ids))

    def numbers(self, w: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.ids.get, w, [-1] * len(w)), np.int64, len(w))
        for i in np.flatnonzero(got < 0):
            got[i] = -1 - (xxhash.xxh64_intdigest(w[i].encode("utf-8", "surrogatepass")) >> 1)
        return got


def pieces(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of about TOKENS tokens: their rows, each one's target flag and length, and each token's number and the one before."""
    rows, w, n, size = [], [], [], 0

    def piece():
        n_tokens = np.array(n, np.int64)
        number = np.concatenate([np.empty(0, np.int64), *w])
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[(np.cumsum(n_tokens) - n_tokens)[n_tokens > 0]] = START
        return rows, np.concatenate([x.column("target").to_numpy() for x in rows]), n_tokens, number, before

    for x in batches:
        at = 0
        for i, t in enumerate(x.column("text")):
            w.append(vocabulary.numbers(words(t.as_py())))
            n.append(len(w[-1]))
            size += n[-1]
            if size >= TOKENS:
                rows.append(x.slice(at, i + 1 - at))
                yield piece()
                rows, w, n, size, at = [], [], [], 0, i + 1
        if at < x.num_rows:
            rows.append(x.slice(at))
    if rows:
        yield piece()


def pair_counts(docs: DataFrame, vocabulary, text: str = "text", target: str = "target") -> DataFrame:
    """Columns pair, n, n_target: how often each pair of words of the head comes in all documents, and in the target's.

    A pair is the number of the first word (or of the start, the last) times head + 1, and the number of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flag, n_tokens, number, before in pieces(batches, vocabulary.value):
            pair = head_pair(before, number, vocabulary.value.head)
            pair, n = np.unique(pair * 2 + np.repeat(flag, n_tokens), return_counts=True)
            pair, n = pair[pair >= 0], n[pair >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 1), pa.array(n), pa.array(n * (pair & 1))], ["pair", "n", "n_target"])

    return _marked(docs, text, target).mapInArrow(run, "pair long, n long, n_target long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def head_pair(before: np.ndarray, number: np.ndarray, head: int) -> np.ndarray:
    """The pair as one number, or -1 if a word is outside the head."""
    first = np.where(before == START, head, before)
    inside = (number >= 0) & (number < head) & (before >= 0) & ((before < head) | (before == START))
    return np.where(inside, first * (head + 1) + number, -1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that keys spread."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    return _mix(_mix(before.view(np.uint64)) + number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Models:
    """What is sent of both models. Arrays of two stand for target and background."""

    def __init__(self, sent: pa.Table, pairs: pa.Table, tokens: np.ndarray, texts: np.ndarray, size: int, vocabulary: Vocabulary):
        two = lambda t: np.array([t.column("n_target").to_numpy(), t.column("n").to_numpy()], np.float64)
        order = np.argsort(pairs.column("pair").to_numpy())
        self.pair, self.pair_n = pairs.column("pair").to_numpy()[order], two(pairs)[:, order]
        self.word_n, self.vocabulary = two(sent), vocabulary
        self.tokens, self.texts, self.size = tokens, texts, size

    def tally(self, n_tokens, number, before):
        """By token: its document and its document's count of it; by different pair of a document: one of its tokens, its count, its place in pair (or -1)."""
        d = np.repeat(np.arange(len(n_tokens)), n_tokens)
        mark = _mix(d + (1 << 40))
        order, _, count = groups(_mix(number.view(np.uint64)) ^ mark)
        own = np.empty(len(number), np.int64)
        own[order] = np.repeat(count, count)
        _, one, n = groups(pair_key(before, number) ^ mark)
        p = head_pair(before[one], number[one], self.vocabulary.head)
        at = np.full(len(p), -1)
        if len(self.pair):
            inside = np.flatnonzero(p >= 0)
            found = np.minimum(np.searchsorted(self.pair, p[inside]), len(self.pair) - 1)
            at[inside] = np.where(self.pair[found] == p[inside], found, -1)
        return d, own, one, n, at

    def unigram(self, k: int, count, own, mine, n_tokens):
        """PRIOR times the probability of words that come so often, without a document's own."""
        return PRIOR * (count - mine * own + ADD) / (self.tokens[k] - mine * n_tokens + ADD * self.size)

    def base(self, flag, n_tokens, number, before, tally) -> tuple[np.ndarray, np.ndarray]:
        """Target and background loss of each document, but for what its other words and pairs add."""
        d, own, one, n, at = tally
        starts = before == START
        before_own = np.concatenate((own[:1], own[:-1]))
        sent, after = np.flatnonzero(number >= 0), np.flatnonzero((before >= 0) & ~starts)
        i = np.flatnonzero(at >= 0)
        f, p = one[i], at[i]
        losses = []
        for k in (0, 1):
            mine = flag if k == 0 else np.ones_like(flag)
            q, context = np.ones(len(number)), np.ones(len(number))
            q[sent] = self.unigram(k, self.word_n[k][number[sent]], own[sent], mine[d[sent]], n_tokens[d[sent]])
            context[after] = self.word_n[k][before[after]] - mine[d[after]] * before_own[after] + PRIOR
            context[starts] = (self.texts[k] - mine + PRIOR)[d[starts]]
            loss = np.log(context / q)
            loss[f] -= n[i] * np.log1p(np.maximum(0, self.pair_n[k][p] - mine[d[f]] * n[i]) / q[f])
            losses.append(np.bincount(d, loss, len(n_tokens)))
        return losses[0], losses[1]

    def others(self, n_tokens, number, before, tally) -> dict[str, np.ndarray]:
        """The pairs and words of each document that weren't sent, as columns of equal length.

        key: of the pair (the second word's number, if that was sent, and 46 bits of the pair's hash; else its
        hash), 0 for a word itself; word: of the second word if that wasn't sent, else 0; d: the document; n: how
        often the pair comes in the document (the word stands before another); own: how often the (second) word does.
        """
        d, own, one, n, at = tally
        f, n = one[at < 0], n[at < 0]
        rare = np.flatnonzero(number < 0)
        order, u, count = groups(_mix(number[rare].view(np.uint64)) ^ _mix(d[rare]))
        last = np.zeros(len(number), bool)
        last[np.cumsum(n_tokens)[n_tokens > 0] - 1] = True
        leads = np.add.reduceat(~last[rare][order], np.cumsum(count) - count, dtype=np.int64) if len(u) else count
        u = rare[u]
        key, w = pair_key(before[f], number[f]), number[f]
        key = np.where(w < 0, key | np.uint64(1), (w.view(np.uint64) << np.uint64(46)) | (key >> np.uint64(18)) | np.uint64(1)).view(np.int64)
        join, word = np.concatenate, _mix(number.view(np.uint64) + np.uint64(1)).view(np.int64)
        return {"key": join((key, np.zeros(len(u), np.int64))), "word": join((np.where(w < 0, word[f], 0), word[u])), "d": join((d[f], d[u])), "n": join((n, leads)), "own": join((own[f], own[u]))}

    def add(self, x: dict[str, np.ndarray], losses: tuple[np.ndarray, np.ndarray], flag: np.ndarray, n_tokens: np.ndarray) -> None:
        """Adds to documents' losses what counts() says of their pairs and words."""
        d, n, own, alone = x["d"], x["n"], x["own"], x["w"] == -2
        for k in (0, 1):
            mine = flag[d] if k == 0 else 1
            count = x["words_b" if k else "words_a"]
            if self.word_n.size:
                count = np.where(x["w"] >= 0, self.word_n[k][x["w"]], count)
            q = self.unigram(k, count, own, mine, n_tokens[d])
            more = np.where(alone, n * np.log(count - mine * own + PRIOR) - own * np.log(q), -n * np.log1p(x["pairs_b" if k else "pairs_a"] / q))
            losses[k][:] += np.bincount(d, more, len(flag))


def groups(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts k, the index of one of each group of equals, the groups' sizes."""
    order = np.argsort(k)
    s = k[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    return order, order[first], np.diff(np.append(first, len(s)))


def _sums(of: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """For each x, the sum over its group."""
    order, _, count = of
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(np.add.reduceat(x[order], np.cumsum(count) - count), count) if len(x) else x
    return out


def counts_of(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For all that others() gave under some keys (and t, the documents' flags): the counts that other documents add.

    w: the second word's number, -1 if it wasn't sent, -2 in the row of a word itself; pairs_a and pairs_b: how
    often the pair comes in other documents, of the target and of all; words_a and words_b: how often the word
    does, its own document included, if it wasn't sent. Pairs that no other document has are left out.
    """
    t, n, own, alone = x["t"], x["n"], x["own"], x["key"] == 0
    by_word = groups(x["word"].view(np.uint64))
    by_pair = groups(_mix(x["word"].view(np.uint64)) + x["key"].view(np.uint64))
    out = {
        "d": x["d"], "w": np.where(alone, -2, np.where(x["word"] != 0, -1, (x["key"].view(np.uint64) >> np.uint64(46)).view(np.int64))), "n": n, "own": own,
        "pairs_a": _sums(by_pair, n * t) - n * t, "pairs_b": _sums(by_pair, n) - n,
        "words_a": np.where(x["word"] != 0, _sums(by_word, np.where(alone, own * t, 0)), 0), "words_b": np.where(x["word"] != 0, _sums(by_word, np.where(alone, own, 0)), 0),
    }
    keep = alone | (out["pairs_b"] > 0)
    return {k: v[keep] for k, v in out.items()} | {"keep": keep}


#: What tasks hand on, under the number of a piece of the corpus and a bucket of keys: a document (d, its place in
#: the piece, and what is known of it), or a bundle of what the piece's documents ask.
DOCUMENT = "piece long, bucket int, doc {}, d0 int, target int, n_tokens long, a double, b double, "
ASKED = DOCUMENT + "key array<long>, word array<long>, d array<int>, t array<int>, n array<int>, own array<int>"
#: The same with the answers in the place of the keys.
ANSWERED = DOCUMENT + "d array<int>, w array<int>, n array<int>, own array<int>, pairs_a array<long>, pairs_b array<long>, words_a array<long>, words_b array<long>"


def _types(spark, schema: str) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def _batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of these columns, with nulls in the others."""
    size = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _flat(batches: list[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([y.column(c).flatten().to_numpy() for y in batches]).astype(np.int64) for c in names}


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of a sorted partition, a list of slices for each value of by."""
    value, kept = None, []
    for x in batches:
        at = x.column(by).to_numpy()
        ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1 if len(at) else []
        for i, j in zip([0, *ends[:-1]], ends, strict=False):
            if kept and at[i] != value:
                yield value, kept
                kept = []
            value = at[i]
            kept.append(x.slice(i, j - i))
    if kept:
        yield value, kept


def in_order(rows: DataFrame) -> DataFrame:
    """rows (doc, text, ...), with those of a task in an order that depends on the rows alone.

    Tasks number documents as they come. Behind a scan a task that is run again, after its executor was lost,
    meets them in the same order; behind a shuffle it need not, while others have gone on with its first numbers.
    """
    return rows.sortWithinPartitions("doc", "text")


def asked(rows: DataFrame, models, buckets: int) -> DataFrame:
    """For documents (doc, text, target): what is known of each, and what must be looked up, in bundles by bucket; see ASKED."""
    form = ASKED.format(rows.schema["doc"].dataType.simpleString())
    schema = _types(rows.sparkSession, form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for piece, (got, *tokens) in enumerate(pieces(batches, models.value.vocabulary), first):
            flag, n_tokens = tokens[:2]
            doc = pa.concat_arrays([x.column("doc") for x in got])
            del got  # the texts
            tally = models.value.tally(*tokens[1:])
            a, b = models.value.base(*tokens, tally)
            same = lambda x: np.full(len(doc), x)
            spread = (_mix(np.uint64(piece) + (np.arange(len(doc), dtype=np.uint64) << np.uint64(48))) % np.uint64(buckets)).astype(np.int64)
            yield _batch(schema, {"piece": same(piece), "bucket": spread, "doc": doc, "d0": np.arange(len(doc)), "target": flag, "n_tokens": n_tokens, "a": a, "b": b})
            x = models.value.others(*tokens[1:], tally)
            x["t"] = flag[x["d"]]
            del tally, tokens
            bucket = (_mix(np.where(x["word"] != 0, x["word"], x["key"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket * len(doc) + x["d"])
            x, bucket = {k: v[order] for k, v in x.items()}, bucket[order]
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
            for i, j in zip([0, *ends[:-1]], ends if len(order) else [], strict=False):
                yield _batch(schema, {"piece": [piece], "bucket": bucket[i : i + 1]} | {k: [v[i:j]] for k, v in x.items()})

    return rows.mapInArrow(run, form)


def answered(rows: DataFrame, buckets: int) -> DataFrame:
    """The documents of asked(), and what the bundles ask; see ANSWERED."""
    form = ANSWERED.format(rows.schema["doc"].dataType.simpleString())
    schema = _types(rows.sparkSession, form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _runs(batches, "bucket"):
            bundles = []
            for x in got:
                known = x.filter(x.column("key").is_null())
                yield _batch(schema, {f.name: known.column(f.name) for f in schema if f.name in known.schema.names and not pa.types.is_list(f.type)})
                bundles.append(x.filter(x.column("key").is_valid()))
            size = np.concatenate([x.column("key").value_lengths().to_numpy() for x in bundles])
            x = counts_of(_flat(bundles, ["key", "word", "d", "t", "n", "own"]))
            kept = np.add.reduceat(x.pop("keep"), np.cumsum(size) - size, dtype=np.int64) if len(size) else size
            piece = np.concatenate([x.column("piece").to_numpy() for x in bundles])
            ends = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32())
            yield _batch(schema, {"piece": piece} | {f.name: pa.ListArray.from_arrays(ends, pa.array(x[f.name], f.type.value_type)) for f in schema if f.name in x})

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, form)


def summed(rows: DataFrame, models, buckets: int) -> DataFrame:
    """doc, n_tokens, a, b: each document with its losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_tokens", "a", "b"]
        for _, got in _runs(batches, "piece"):
            docs = pa.Table.from_batches([x.filter(x.column("d").is_null()) for x in got]).sort_by("d0")
            bundles = [x.filter(x.column("d").is_valid()) for x in got]
            losses = docs.column("a").to_numpy().copy(), docs.column("b").to_numpy().copy()
            x = _flat(bundles, ["d", "w", "n", "own", "pairs_a", "pairs_b", "words_a", "words_b"])
            models.value.add(x, losses, docs.column("target").to_numpy().astype(np.int64), docs.column("n_tokens").to_numpy())
            yield from pa.table([docs.column("doc"), docs.column("n_tokens"), *losses], names).to_batches()

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.repartition(buckets, "piece").sortWithinPartitions("piece").mapInArrow(run, f"doc {kind}, n_tokens long, a double, b double")


def score(docs: DataFrame, target_ids: DataFrame, doc: str = "doc_id", text: str = "text", head: int = HEAD, words_sent: int = WORDS_SENT, pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference; target_ids: one column, the target documents' ids."""
    spark = docs.sparkSession
    (flag,) = fresh(docs, "target")
    wanted = target_ids.toDF("_id").filter("_id IS NOT NULL").distinct()
    few = wanted.count() <= SMALL_SET
    marked = wanted.withColumn(flag, F.lit(1))
    rows = docs.select(docs[doc], docs[text]).join(F.broadcast(marked) if few else marked, docs[doc] == marked["_id"], "left")
    stored = word_counts(rows, text, flag).persist(StorageLevel.DISK_ONLY)
    texts = stored.filter("word = ''").first()  # counted once for each text that has a word
    counts = stored.filter("word <> ''")
    total = counts.agg(F.sum("n_target").alias("a"), F.sum("n").alias("b"), F.count("*").alias("v")).first()
    tokens = np.array([total["a"] or 0, total["b"] or 0], np.float64)
    sent = frequent(counts, words_sent)
    stored.unpersist()
    vocabulary = Vocabulary(sent, head)
    # A pair that comes once is never another document's.
    stored = pair_counts(rows, spark.sparkContext.broadcast(vocabulary), text, flag).filter("n > 1").persist(StorageLevel.DISK_ONLY)
    pairs = frequent(stored, pairs_sent)
    stored.unpersist()
    texts = np.array([texts["n_target"], texts["n"]] if texts else [0, 0], np.float64)
    models = spark.sparkContext.broadcast(Models(sent, pairs, tokens, texts, total["v"], vocabulary))
    buckets = max(LEAST_BUCKETS, int(tokens[1]) // BUCKET)
    rows = _marked(rows, text, flag, docs[doc].alias("doc"))
    known = answered(asked(rows if few else in_order(rows), models, buckets), buckets)
    loss = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    out = summed(known, models, buckets).select(F.col("doc").alias("doc_id"), "n_tokens", loss("a").alias("target_loss"), loss("b").alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: the documents that labels calls of good quality and not toxic."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    out = score(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])


def _loss(pair: str, word: str, context: str, tokens: str, mine: str) -> str:
    q = f"{PRIOR} * ({word} - {mine} * own + {ADD}) / ({tokens} - {mine} * len + {ADD} * v)"
    return f"sum(n * (ln({context} + {PRIOR}) - ln({pair} - {mine} * n + {q}))) / any_value(len)"


ORACLE = rf"""
WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS l FROM documents),
tokens AS (SELECT doc_id, l[i] AS w, CASE WHEN i > 1 THEN l[i - 1] ELSE '' END AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
sizes AS (SELECT t.doc_id, count(*) AS len, CASE WHEN any_value(g.doc_id) IS NULL THEN 0 ELSE 1 END AS f FROM tokens t LEFT JOIN good g USING (doc_id) GROUP BY t.doc_id),
-- What stands before a word: another word, or the start of a text.
own AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY ALL UNION ALL SELECT doc_id, '', 1 FROM sizes),
freq AS (SELECT w, sum(n) AS b, sum(n * f) AS a FROM own JOIN sizes USING (doc_id) GROUP BY w),
total AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS v FROM freq WHERE w <> ''),
pairs AS (SELECT doc_id, h, w, count(*) AS n FROM tokens GROUP BY ALL),
cells AS (SELECT h, w, sum(n) AS b, sum(n * f) AS a FROM pairs JOIN sizes USING (doc_id) GROUP BY h, w),
all_of AS (
  SELECT p.doc_id, p.n, f, len, o.n AS own, c.a AS ca, c.b AS cb, x.a AS xa, x.b AS xb, y.a - f * q.n AS ya, y.b - q.n AS yb, ta, tb, v
  FROM pairs p JOIN sizes s USING (doc_id) JOIN cells c USING (h, w) JOIN own o ON o.doc_id = p.doc_id AND o.w = p.w JOIN own q ON q.doc_id = p.doc_id AND q.w = p.h
  JOIN freq x ON x.w = p.w JOIN freq y ON y.w = p.h, total),
scores AS (SELECT doc_id, any_value(len) AS n_tokens, {_loss("ca", "xa", "ya", "ta", "f")} AS a, {_loss("cb", "xb", "yb", "tb", "1")} AS b FROM all_of GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, round(a, 6) AS target_loss, round(b, 6) AS background_loss, round(a - b, 6) AS difference
FROM documents LEFT JOIN scores USING (doc_id)
"""
