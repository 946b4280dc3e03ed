"""Fill-in-middle transformation: texts cut at two ranks of their units, by an indexable skip list.

A unit is a run of ASCII letters or one other character. The units of a text are the nodes of a skip list.
Each link of an express lane carries how many units and how many code points it passes over, so that going
right while the units passed don't exceed a rank, and then down, gives the code point at which the rank's
unit ends. Towers are drawn from a hash of the unit's number. The lowest lane is the text itself and isn't
stored: a walk ends with the few units between two nodes of the lane above it.

The lanes are built piece by piece of ``PIECE`` characters, so that a very long text needs little more memory
than its own and that of its sixteenth unit's links.

Edge cases: a null text is an empty one, and plain. A null id counts as no digits in the hash's input. Repeated
rows give equal rows, an empty table an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PIECE = 1 << 20  #: characters that are cut into units at a time
GAP_BITS = 4  #: a node in 2 ** 4 has a link in the next lane


@dataclass(frozen=True)
class Rates:
    plain: int = 10  #: per cent of the texts that are left as they are
    spm: int = 20  #: per cent of the others that have the suffix first


def _starts(text: str, at: int) -> np.ndarray:
    """The places in text[at : at + PIECE], from at, where a unit starts."""
    codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4") | 0x20
    letter = (codes >= ord("a")) & (codes <= ord("z"))
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[0] = at > 0 and bool(re.match("[A-Za-z]", text[at - 1]))
    return np.flatnonzero(~(letter & before))


def _heights(units: np.ndarray) -> np.ndarray:
    """In how many express lanes each unit's node has a link: geometric, from a hash of its number."""
    x = (units.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    zeros = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))  # trailing zero bits
    return zeros // GAP_BITS


class SkipList:
    """The units of a text. lanes[k] is (units, chars, below): what each link passes over, and the number of its first node in the lane below."""

    def __init__(self, text: str):
        self.text, self.size = text, 0
        units, chars, heights = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        for at in range(0, len(text), PIECE):
            starts = _starts(text, at)
            numbers = np.arange(self.size, self.size + len(starts))
            high = _heights(numbers)
            up = (high > 0) & (numbers > 0)
            units.append(numbers[up])
            chars.append(starts[up] + at)
            heights.append(high[up])
            self.size += len(starts)
        unit, char = np.concatenate(units), np.concatenate(chars)  # the first node is the head, in all lanes
        height = np.concatenate([[np.iinfo(np.int64).max], *heights])
        self.lanes, below = [], np.zeros(len(unit), np.int64)
        while True:
            self.lanes.append((np.diff(unit, append=self.size), np.diff(char, append=len(text)), below))
            if len(unit) <= 1:
                break
            below = np.flatnonzero(height > len(self.lanes))
            unit, char, height = unit[below], char[below], height[below]

    def end_of(self, rank: int) -> int:
        """The code point at which the first rank units end."""
        node = units = chars = 0
        for width, length, below in reversed(self.lanes):
            while node < len(width) and units + width[node] <= rank:
                units += int(width[node])
                chars += int(length[node])
                node += 1
            if node == len(width):
                return chars
            node = int(below[node])
        while units < rank:
            chars = UNIT.match(self.text, chars).end()
            units += 1
        return chars


def draws(doc_id: int | str | None) -> list[int]:
    """h1 to h4: the first four groups of eight digits of the hash of the id."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, h: list[int], rates: Rates = Rates()) -> tuple[str, int, str, int | None, int | None]:
    """The output, the number of units, the form, and the code points of prefix and middle."""
    units = SkipList(text)
    n = units.size
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - rates.plain:
        return text, n, "plain", None, None
    a, b = (units.end_of(x) for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < rates.spm:
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}", n, "spm", a, b - a
    return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}", n, "psm", a, b - a


def restore(output: str, form: str) -> str:
    """The text that an output was made from. No part holds a mark, and no mark can begin within another, so the first of each kind is the one that was set."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), doc: str = "doc_id", text: str = "text", with_output: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if it is asked for, output: a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for k, t in zip(x.column("doc_id"), x.column("text"), strict=True):
                out, n, form, a, m = transform(t.as_py() or "", draws(k.as_py()), rates)
                rows.append((n, form, a, m, _sha(out), _sha(restore(out, form)), *([out] * with_output)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.string()] * with_output))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *columns], ["doc_id", *names])

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] * with_output)]
    schema = f"doc_id {docs.schema[doc].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return docs.select(docs[doc].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema + ", output string" * with_output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
found AS (SELECT *, strpos(o, '<P>') AS op, strpos(o, '<S>') AS os, strpos(o, '<M>') AS om FROM made),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN o[4:os - 1] || o[om + 3:] || o[os + 3:om - 1]
    ELSE o[op + 3:om - 1] || o[om + 3:] || o[4:op - 1] END AS r FROM found)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(o) AS output_sha256, sha256(r) AS restored_sha256 FROM back
"""
