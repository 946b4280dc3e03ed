"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with frozen counts. A byte is coded in the
longest context that the language has seen: with n symbols counted in a context, d of them different, a
symbol counted c times costs -log2(c / (n + d)) bits, and one not seen there costs an escape of
-log2(d / (n + d)) bits and goes to the next shorter context; after the shortest, every byte costs 8 bits.
The language with the shortest code for the whole text is predicted (ties: the first by name), and the score
is its posterior probability, 1 / sum of 2 ** (its length - length) over languages.

The counts come from at most ``TRAIN_BYTES`` of text for each language: whole documents in the order of a
hash of their id and text, as long as they fit. Scoring takes in every byte of every text. All bytes of a
batch are coded at once: the distinct (ORDER + 1)-grams are costed for all languages, and each document adds
up what its places cost. Long texts are coded piece by piece, with their context.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if there is
no labelled text to learn from. Rows with a null id are not held out and not learned from. Repeated rows are
learned from each and give a row each. An empty table gives an empty result. Further columns of the input
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import table

ORDER = 3  #: of the longest contexts; 7 at most
TRAIN_BYTES = 1_500_000  #: of text that each language is learned from, at most
MAX_LANGUAGES = 500
PIECE = 1 << 21  #: bytes that are coded together
KNOWN = 1 << 21  #: grams whose costs a task keeps
LETTER = regex.compile(r"\p{L}")


def held_out(doc: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, doc: str, text: str, lang: str, limit: int = TRAIN_BYTES) -> DataFrame:
    """Columns lang, text: the documents that are learned from, about limit bytes for each language and never more.

    Each language's share of rows is cut by the hash first, so that only about twice the limit is sorted.
    """
    rows = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull() & docs[doc].isNotNull() & ~held_out(docs[doc]))
    rows = rows.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"), F.octet_length(docs[text]).cast("long").alias("bytes"), F.xxhash64(docs[doc], docs[text]).alias("h"))
    sizes = rows.filter(F.col("bytes").between(1, limit)).groupBy("lang").agg(F.sum("bytes").alias("all"), F.max("bytes").alias("longest")).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages; at most {MAX_LANGUAGES}")
    share = {r["lang"]: min(1.0, (2 * limit + 4 * r["longest"]) / r["all"]) for r in sizes}
    if not share:
        return rows.select("lang", "text").limit(0)
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])[F.col("lang")]
    rows = rows.filter(F.col("bytes").between(1, limit) & ((F.col("h").cast("double") / 2.0**64 + 0.5) <= cut))
    rows = rows.withColumn("upto", F.sum("bytes").over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("upto") <= limit).select("lang", "text")


def packed(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The (order + 1)-grams that end at each byte from place order on, first byte highest."""
    kind = np.uint32 if order <= 3 else np.uint64
    out = np.zeros(len(data) - order, kind)
    for j in range(order + 1):
        out = (out << kind(8)) | data[j : len(data) - order + j]
    return out


def learn(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Columns lang, k, gram, n: how often each symbol follows each context of k bytes (packed with it)."""

    def count(x: pd.DataFrame) -> pd.DataFrame:
        pad = b"\0" * order
        grams = np.concatenate([packed(np.frombuffer(pad + t.encode(), np.uint8), order) for t in x["text"]])
        parts = []
        for k in range(order + 1):
            g, n = np.unique(grams & grams.dtype.type((1 << 8 * (k + 1)) - 1), return_counts=True)
            parts.append(pd.DataFrame({"lang": x["lang"].iloc[0], "k": k, "gram": g.astype(np.uint64).view(np.int64), "n": n}))
        return pd.concat(parts)

    return docs.groupBy("lang").applyInPandas(count, "lang string, k int, gram long, n long")


class Model:
    """Frozen counts of all languages, and the costs of grams."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.order, self.langs = order, sorted(counts["lang"].unique())
        col = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy()
        self.tables = []
        for k in range(order + 1):
            at = (counts["k"] == k).to_numpy()
            gram, n, lang = counts["gram"].to_numpy()[at].view(np.uint64), counts["n"].to_numpy()[at], col[at]
            table = []
            for keys, what in ((gram, ((n, "n"),)), (gram >> np.uint64(8), ((n, "n"), (np.ones_like(n), "d")))):
                u, i = np.unique(keys, return_inverse=True)
                rows = []
                for w, _ in what:
                    m = np.zeros((len(u) + 1, len(self.langs)), np.float64)  # the last row is for what isn't there
                    np.add.at(m, (i, lang), w)
                    rows.append(m)
                table.append((u, rows))
            self.tables.append(table)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The exact code length of each (order + 1)-gram's last byte after the others, for each language."""
        out = np.zeros((len(grams), len(self.langs)))
        open_ = np.ones(out.shape, bool)
        for k in range(self.order, -1, -1):
            (u, (count,)), (v, (total, kinds)) = self.tables[k]
            g = grams.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)
            c = count[_find(u, g)]
            at = _find(v, g >> np.uint64(8))
            n, d = total[at], kinds[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                hit, miss = open_ & (c > 0), open_ & (c == 0) & (n > 0)
                out -= np.where(hit, np.log2(c / (n + d)), 0)
                out -= np.where(miss, np.log2(d / (n + d)), 0)
            open_ &= ~hit
        return out + 8.0 * open_


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of x in sorted keys; len(keys) where it isn't there."""
    at = np.searchsorted(keys, x)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == x, at, len(keys))


class Coder:
    """Code lengths of texts. The costs of grams met so far are kept."""

    def __init__(self, model: Model):
        self.model = model
        kind = np.uint32 if model.order <= 3 else np.uint64
        self.known, self.cost = np.empty(0, kind), np.empty((0, len(model.langs)))

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        out, order = np.zeros((len(texts), len(self.model.langs))), self.model.order
        parts, owner, size = [], [], 0
        for i, t in enumerate(texts):
            raw = b"\0" * order + (t or "").encode()
            for at in range(0, len(raw) - order, PIECE):
                parts.append(packed(np.frombuffer(raw, np.uint8, min(PIECE + order, len(raw) - at), at), order))
                owner.append(i)
                size += len(parts[-1])
                if size >= PIECE:
                    self._code(parts, owner, out)
                    parts, owner, size = [], [], 0
        self._code(parts, owner, out)
        return out

    def _code(self, parts: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        if not parts:
            return
        grams = np.concatenate(parts)
        new = np.setdiff1d(grams, self.known)
        if len(new):
            if len(self.known) > KNOWN:
                self.known, self.cost, new = self.known[:0], self.cost[:0], np.unique(grams)
            keys = np.concatenate((self.known, new))
            order = np.argsort(keys)
            self.known, self.cost = keys[order], np.concatenate((self.cost, self.model.bits(new)))[order]
        at = np.searchsorted(self.known, grams)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        for j in range(out.shape[1]):
            np.add.at(out[:, j], owner, np.add.reduceat(self.cost[:, j][at], starts))


def predict(docs: DataFrame, model_counts: pd.DataFrame, doc: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte (of the prediction), for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, order)
        coder = Coder(model)
        for x in batches:
            texts = x.column("text").to_pylist()
            langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if model.langs:
                length = coder.lengths(texts)
                best = length.argmin(axis=1)
                sure = 1 / np.exp2(np.maximum(length.min(axis=1, keepdims=True) - length, -1000)).sum(axis=1)
                for i, t in enumerate(texts):
                    if t and LETTER.search(t):
                        langs[i], scores[i], rates[i] = model.langs[best[i]], float(sure[i]), float(length[i, best[i]] / len(t.encode()))
            columns = {"doc_id": x.column("doc_id"), "held_out": x.column("held_out"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "bits_per_byte": pa.array(rates, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(docs[doc].alias("doc_id"), held_out(docs[doc]).alias("held_out"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, learn(sample(docs, doc, text, lang)).toPandas(), doc, text)


def op9_ppm_lang(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
