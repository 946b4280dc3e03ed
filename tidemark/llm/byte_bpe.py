"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut into pieces before it is encoded, so that very long texts need bounded work and memory at a
time. A cut is made only where the pattern that splits texts must end a match, whatever stands around:
before white space that follows something else, between letters and digits, before punctuation that
follows a letter or digit, and before a digit that follows punctuation. A run of one kind of character
that is longer than ``PIECE`` has no such place; it is one match, or two for white space before text, and
is merged as a whole. The cuts hold for ``public_tokenizers.PATTERN``.

Edge cases: a null text is encoded as the empty text. Repeated rows give a row each, null ids are kept, an
empty table gives an empty result, and further columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
PIECE = 1 << 16  #: characters that are encoded at a time, about
#: Where a match must end: between what stands left and right of an empty match.
SAFE = regex.compile(r"(?<=\P{White_Space})(?=[ \n\t])|(?<=\p{L})(?=[^\p{White_Space}\p{L}])|(?<=\p{N})(?=[^\p{White_Space}\p{N}])|(?<=[^\p{White_Space}\p{L}\p{N}])(?=\p{N})")
#: White space that the library's pattern matching has no room for.
LONG_BLANK = regex.compile(r"\p{White_Space}{1000,}")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of about size characters, cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def encode(text: str | None, enc: tiktoken.Encoding) -> Iterator[list[int]]:
    """The ids, piece by piece."""
    for part in pieces(text or ""):
        if part:
            yield _encode_piece(part, enc)


def _encode_piece(part: str, enc: tiktoken.Encoding) -> list[int]:
    """The ids of a piece. Of a long run of white space, all but the last character is one match if text follows, else all is."""
    ids, at = [], 0
    for blank in LONG_BLANK.finditer(part):
        end = blank.end() - (blank.end() < len(part))
        ids += enc.encode_ordinary(part[at : blank.start()])
        ids += enc._encode_single_piece(part[blank.start() : end])
        at = end
    return ids + enc.encode_ordinary(part[at:])


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, doc: str = "doc_id", text: str = "text", with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok, ids and decoded bytes if they are asked for, and the columns to carry."""
    ranks, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("texts are cut where a match of public_tokenizers.PATTERN must end; another pattern needs other cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for x in batches:
            rows = []
            for t in x.column("text"):
                t = t.as_py() or ""
                ids_sha, out_sha, n, ids, out = hashlib.sha256(), hashlib.sha256(), 0, [], []
                for part in encode(t, enc):
                    raw = np.array(part, "<u4").tobytes()
                    back = enc.decode_bytes(part)
                    ids_sha.update(raw)
                    out_sha.update(back)
                    n += len(part)
                    if with_ids:
                        ids += part
                        out.append(back)
                rows.append((n, ids_sha.hexdigest(), out_sha.hexdigest(), out_sha.digest() == hashlib.sha256(t.encode()).digest(), ids, b"".join(out)))
            n, a, b, ok, ids, out = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])
            columns = {"doc_id": x.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()), "decoded_ok": pa.array(ok, pa.bool_())}
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(out, pa.binary())}
            columns |= {c: x.column(c) for c in carry}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean"
    schema += ", ids array<int>, decoded binary" * with_ids + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(docs[doc].alias("doc_id"), docs[text].alias("text"), *carry).mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
