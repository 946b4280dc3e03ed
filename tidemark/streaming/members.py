"""Membership and repeat markers as keyed state of a stream of sessions.

A symbol's state is of bounded size: what the gates look back on, the last signal, the last report. It can begin
with what is stored. Sessions come in order; one that isn't after the last that its symbol had is a repeat
and changes nothing. A batch's rows take the place of what an earlier try of it wrote.

Where candidates share a symbol, its session is still one row, with what shared_membership counts it by.

Symbols are kept in BLOCKS a market (REPORT_BLOCKS for reports), one value of state each: a batch calls Python and
reads and writes state once a block, and all symbols of a block are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.dates import floor
from tidemark.operators.hygiene import dollar_volume, is_common_stock
from tidemark.operators import universe
from tidemark.params import Params
from tidemark.sources.files import exists
from tidemark.streaming.ingest import KEY, ROCKS

#: A candidate's session: whether it traded, its dollar volume, its fetch's outcome, and what its name and market ask.
GRID = "market string, symbol string, session date, traded boolean, dollar_volume double, status string, common boolean, least double"
#: More of a session where candidates share symbols: the volumes of all its bars, the rows that it stands for, and whether no candidate of the symbol is other than common stock.
SHARED = "volumes array<double>, copies bigint, all_common boolean"
MEMBERS = "market string, symbol string, session date"
SHARED_MEMBERS = f"{MEMBERS}, copies bigint"
REPORTS = "market string, symbol string, session date"
#: A checkpoint is bound to them. Reports are few and their state is a date a symbol, so theirs has fewer blocks.
BLOCKS, REPORT_BLOCKS = 2048, 256
#: The most stores that the state of reports is dealt over. A store costs a batch the same however little it holds.
REPORT_STORES = 24
PARTITIONS = "spark.sql.shuffle.partitions"
GROUP = ["market", "block"]
REPEATS = "market string, symbol string, session date, repeat boolean, last_reported date"


def grid(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, params: Params = Params(), days: DataFrame | None = None) -> DataFrame:
    """The rows of GRID of every candidate on every session of its market; with SHARED, and one for each symbol, where candidates share symbols."""
    on = [*KEY, "session"]
    if universe.symbols_shared(instruments):
        out = universe.shared_sessions(instruments, bars, resolutions, days, F.array_sort(F.collect_list(F.struct(dollar_volume().isNull(), dollar_volume().alias("v")))).alias("_volumes"))
        status = F.when(~F.coalesce("_settled", F.lit(True)), "unresolved").alias("status")
        own = [F.col("_bars").isNotNull().alias("traded"), F.lit(None).cast("double").alias("dollar_volume"), status, F.col("_common").alias("common"), floor(F.col("market"), params).cast("double").alias("least")]
        return out.select(*on, *own, F.coalesce("_volumes.v", F.array().cast("array<double>")).alias("volumes"), "copies", F.col("_all_common").alias("all_common"))
    own = bars.select(*on, F.lit(True).alias("traded"), dollar_volume().alias("dollar_volume"))
    out = universe.candidate_sessions(instruments, bars if days is None else days).join(own, on, "left").join(resolutions.select(*on, "status"), on, "left")
    return out.select(*on, F.coalesce("traded", F.lit(False)).alias("traded"), "dollar_volume", "status", is_common_stock(F.col("name")).alias("common"), floor(F.col("market"), params).cast("double").alias("least"))


def _blocked(rows: DataFrame, blocks: int, *columns: Column | str) -> DataFrame:
    """market, block, symbol, day (a whole number) and the columns."""
    return rows.select("market", F.pmod(F.hash("symbol"), F.lit(blocks)).alias("block"), "symbol", F.unix_date("session").alias("day"), *columns)


def _whole(rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A block's rows of one batch; None if there are none (a block of the initial state alone)."""
    parts = [x for x in rows if len(x)]
    return pd.concat(parts) if parts else None


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each element of the arrays of symbols' rows."""
    packed = [c for c in rows.columns if c not in ("market", "block", "symbol")]
    flat = lambda c: [x for own in rows[c] for x in own] if c == "volumes" else np.concatenate(list(rows[c]))
    return pd.DataFrame({"symbol": np.repeat(rows["symbol"].to_numpy(), [len(x) for x in rows["day"]])} | {c: flat(c) for c in packed})


class News:
    """The rows of a batch that come after the last session of their symbol, in order: place among the given rows, code of the symbol, and day.

    Known symbols have the first codes, in their order. upto is each symbol's last day with these rows.
    """

    def __init__(self, symbols: list, last: list, rows: pd.DataFrame):
        k = len(symbols)
        code, self.symbols = pd.factorize(np.concatenate([np.array(symbols, object), rows["symbol"].to_numpy(object)]))
        code, day = code[k:], rows["day"].to_numpy(np.int64)
        self.upto = self.padded(last, np.iinfo(np.int32).min)
        order = np.lexsort((day, code))
        same = np.append(False, (np.diff(code[order]) == 0) & (np.diff(day[order]) == 0))
        self.place = order[~same & (day[order] > self.upto[code[order]])]
        self.code, self.day = code[self.place], day[self.place]
        self.counts = np.bincount(self.code, minlength=len(self.symbols))
        self.first = (np.cumsum(self.counts) - self.counts)[self.code]  # of each row, its symbol's first one
        self.ends = np.append(np.flatnonzero(np.diff(self.code)), len(self.code) - 1) if len(self.code) else np.array([], int)
        self.upto[self.code[self.ends]] = self.day[self.ends]

    def padded(self, known, empty) -> np.ndarray:
        """A value for each symbol: the known one, or empty."""
        known = np.asarray(known)
        return np.concatenate([known, np.full((len(self.symbols) - len(known), *known.shape[1:]), empty)]) if len(known) else np.full((len(self.symbols), *known.shape[1:]), empty)

    def carried(self, value: np.ndarray, known: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of each row, the value of the last known one up to it; before that its symbol's start."""
        at = np.maximum.accumulate(np.where(known, np.arange(len(value)), -1))
        return np.where(at >= self.first, value[at], start[self.code])


def _after(history: np.ndarray, code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's history (a row of the matrix) and, after it, its values, as one array; and where in it the values are."""
    at = np.arange(len(code)) + history.shape[1] * (code + 1)
    out = np.empty(len(code) + history.size, history.dtype)
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = value, history.ravel()
    return out, at


class Membership(StatefulProcessor):
    """Of each symbol of a block: the last session, a bit for each recent one that traded, recent dollar volumes, the number of bars, the last liquidity, and whether it is a member."""

    def __init__(self, params: Params = Params(), shared: bool = False):
        self.params, self.shared = params, shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "symbols array<string>, last array<int>, traded array<bigint>, volumes array<double>, age array<bigint>, liquidity array<double>, member array<boolean>"
        self.state = handle.getValueState("state", kept + ", copies array<int>" * self.shared)

    def _members(self, rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Symbol and day (if symbols are shared, copies too) of the members on the sessions that are new.

        Of the last sessions' copies at most as many as the window has are kept: density looks at no more rows.
        """
        p, w = self.params, self.params.window
        symbols, last, traded, volumes, age, liquidity, member, *copies = self.state.get() or ([], [], [], [], [], [], [], [])
        new = News(symbols, last, rows)
        if not len(new.code):
            return (new.symbols[:0], new.day, new.day) if self.shared else (new.symbols[:0], new.day)
        bits = 1 << np.arange(w - 1, -1, -1, dtype=np.int64)  # a symbol's last session has the lowest one
        recent = (new.padded(np.asarray(traded, np.int64), 0)[:, None] & bits > 0).astype(np.int64)
        recent_volumes = new.padded(np.asarray(volumes, float).reshape(-1, w), np.nan)
        age, liquidity, member = new.padded(np.asarray(age, np.int64), 0), new.padded(np.asarray(liquidity, float), 0.0), new.padded(np.asarray(member, bool), False)
        own = lambda c, kind: rows[c].to_numpy(kind)[new.place]
        trades, least = own("traded", bool), own("least", float)
        if self.shared:
            by_row = [np.asarray(x, float) for x in own("volumes", object)]
            n_bars, own_volumes, size = np.fromiter(map(len, by_row), int, len(by_row)), np.concatenate(by_row), own("copies", np.int64)
        else:
            n_bars, own_volumes = trades.astype(int), own("dollar_volume", float)[trades]

        sessions, at = _after(recent, new.code, trades)
        throughout = True
        if self.shared:
            recent_copies = new.padded(np.asarray(copies[0], np.int64).reshape(-1, w), 1)
            sizes, _ = _after(recent_copies, new.code, np.minimum(size, w))
            place, total = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(sessions * sizes))

            def upto(row: np.ndarray) -> np.ndarray:
                """How many rows up to that place traded."""
                i = np.searchsorted(place, row, side="right") - 1
                return total[i] + np.append(sessions, 0)[i] * (row - place[i])

            dense_at = lambda row: (upto(row) - upto(row - w) >= p.density_min) & (upto(row) > upto(row - p.density_recent))
            dense, throughout = dense_at(place[at + 1]), dense_at(place[at] + 1) & own("all_common", bool)
        else:
            total = np.append(0, np.cumsum(sessions))
            dense = (total[at + 1] - total[at + 1 - w] >= p.density_min) & (total[at + 1] > total[at + 1 - p.density_recent])
        bars_upto = np.append(0, np.cumsum(n_bars))
        ages = age[new.code] + bars_upto[1:] - bars_upto[new.first]

        bars, bar_at = _after(recent_volumes, np.repeat(new.code, n_bars), own_volumes)
        last_bars = np.lib.stride_tricks.sliding_window_view(bars, w)
        known = np.sort(last_bars[bar_at[bars_upto[1:][trades] - 1] - w + 1], axis=1)  # at a session's last bar; what isn't known is at the end
        n, each = (~np.isnan(known)).sum(axis=1), np.arange(len(known))
        middle = np.full(len(new.code), np.nan)
        middle[trades] = 0.5 * known[each, (n - 1) // 2] + 0.5 * known[each, n // 2]
        liquid = new.carried(middle, ~np.isnan(middle), liquidity)

        hard = own("common", bool) & (ages >= p.min_bars) & dense
        signal = np.select([~own("settled", bool), ~hard, liquid >= least, (liquid < p.exit_share * least) | ~np.asarray(throughout)], [-1, 0, 1, 0], -1)
        members = new.carried(signal == 1, signal >= 0, member)

        ends, who = new.ends, new.code[new.ends]
        recent[who] = np.lib.stride_tricks.sliding_window_view(sessions, w)[at[ends] - w + 1]
        recent_volumes = last_bars[w * np.arange(len(new.symbols)) + np.cumsum(np.bincount(np.repeat(new.code, n_bars), minlength=len(new.symbols)))]
        age[who], liquidity[who], member[who] = ages[ends], liquid[ends], members[ends]
        kept = [new.symbols, new.upto, recent @ bits, recent_volumes.ravel(), age, liquidity, member]
        if self.shared:
            recent_copies[who] = np.lib.stride_tricks.sliding_window_view(sizes, w)[at[ends] - w + 1]
            kept.append(recent_copies.ravel())
        self.state.update(tuple(x.tolist() for x in kept))
        found = new.symbols[new.code[members]], new.day[members]
        return (*found, size[members]) if self.shared else found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = _whole(rows)
        symbols, days, *copies = ([], []) if got is None else self._members(got)
        if len(days):
            yield pd.DataFrame({"market": key[0], "symbol": symbols, "day": days} | {"copies": x for x in copies})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._members(_unpacked(initialState))


class Repeats(StatefulProcessor):
    """Of each symbol of a block: the session of its last report."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "symbols array<string>, last array<int>")

    def _marked(self, rows: pd.DataFrame) -> pd.DataFrame:
        """symbol, day, before of the reports that are new; before: the day of the symbol's last report, or null."""
        symbols, last = self.state.get() or ([], [])
        new = News(symbols, last, rows)
        if len(new.code):
            self.state.update((new.symbols.tolist(), new.upto.tolist()))
        had = new.padded(np.asarray(last, float), np.nan)
        before = np.where(np.arange(len(new.code)) > new.first, np.append(0, new.day[:-1]), had[new.code]) if len(new.code) else new.day
        return pd.DataFrame({"symbol": new.symbols[new.code], "day": new.day, "before": pd.array(before, "Int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = _whole(rows)
        out = None if got is None else self._marked(got)
        if out is not None and len(out):
            out.insert(0, "market", key[0])
            yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._marked(_unpacked(initialState))


def _start(spark: SparkSession, source: str, schema: str, columns: list, keep: StatefulProcessor, out: str, result: list, where: str, checkpoint: str, stored: DataFrame | None, files_per_batch: int, blocks: int, stores: int | None) -> StreamingQuery:
    """stores: the most partitions of the state; None: as many as the session's shuffles have."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    begun = None
    if stored is not None:
        first = f"{checkpoint.rstrip('/')}-begun"  # written once, so that a first batch that is repeated begins with the same state
        old = _blocked(stored, blocks, *columns)
        if not exists(spark, f"{first}/_SUCCESS"):
            # A symbol's rows are one: they come to the state together, in whatever order.
            names = old.columns[3:]
            packed = old.groupBy(*GROUP, "symbol").agg(F.collect_list(F.struct(*names)).alias("_x")).select(*GROUP, "symbol", *[F.col(f"_x.{c}").alias(c) for c in names])
            packed.write.mode("overwrite").parquet(first)
        kinds = ", ".join(f"{x.name} {x.dataType.simpleString() if i < 3 else 'array<' + x.dataType.simpleString() + '>'}" for i, x in enumerate(old.schema))
        begun = spark.read.schema(kinds).parquet(first).groupBy(*GROUP)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    found = _blocked(rows, blocks, *columns).groupBy(*GROUP).transformWithStateInPandas(keep, out, "Append", "None", initialState=begun)
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/batch={n}")
    out = found.select("market", "symbol", F.date_from_unix_date("day").alias("session"), *result).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    partitions = spark.conf.get(PARTITIONS)
    try:
        if stores is not None:  # a stream takes the session's settings as they are when it starts, and its checkpoint keeps this one
            spark.conf.set(PARTITIONS, str(min(stores, int(partitions))))
        return out.start()
    finally:
        spark.conf.set(PARTITIONS, partitions)


def start_members(spark: SparkSession, source: str, where: str, checkpoint: str, stored: DataFrame | None = None, params: Params = Params(), files_per_batch: int = 1000, shared: bool = False) -> StreamingQuery:
    """Takes all rows of GRID that are available under source (Parquet) and stops; the members of their sessions are written under where.

    stored: the rows of GRID of earlier sessions, which the state begins with. shared: rows have SHARED too, and members copies (SHARED_MEMBERS).
    """
    settled = F.coalesce(F.col("status") == "resolved", F.lit(True)).alias("settled")
    columns = [*[F.coalesce(c, F.lit(False)).alias(c) for c in ("traded", "common")], "dollar_volume", "least", settled]
    more = ["volumes", "copies", "all_common"] if shared else []
    return _start(spark, source, f"{GRID}, {SHARED}" if shared else GRID, [*columns, *more], Membership(params, shared), "market string, symbol string, day int" + ", copies bigint" * shared, ["copies"] * shared, where, checkpoint, stored, files_per_batch, BLOCKS, None)


def start_repeats(spark: SparkSession, source: str, where: str, checkpoint: str, stored: DataFrame | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Marks all reports (REPORTS) that are available under source by the last report of their symbol; stored: earlier reports."""
    result = [F.col("before").isNotNull().alias("repeat"), F.date_from_unix_date("before").alias("last_reported")]
    return _start(spark, source, REPORTS, [], Repeats(), "market string, symbol string, day int, before int", result, where, checkpoint, stored, files_per_batch, REPORT_BLOCKS, REPORT_STORES)


def read(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """What all batches of a stream have written under where."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(where) if exists(spark, where) else spark.createDataFrame([], schema)
    return rows.select(*[x.split()[0] for x in schema.split(", ")])
