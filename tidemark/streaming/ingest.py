"""Bars as a stream: raw files arrive, and of every bar the first delivery that counts is stored and stays.

What has been delivered is kept as keyed state, for each symbol a whole number a month whose bits are days, so a
batch costs what it brings and 12 bytes for each month of the symbols that it brings, not the stored bars. Deliveries are in the order of their files' times, names
and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark import schemas
from tidemark.operators import hygiene, tables
from tidemark.params import Params
from tidemark.sources.bars import parse_bars

RAW = "market string, symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["market", "symbol"]
FEED = "market string, symbol string, delivered bigint, added bigint, total bigint, last_session date"
#: A bar that is new, or (without session) the symbol's counts in this batch and since the beginning.
OUT = f"{schemas.TABLES['bars']}, delivered bigint, added bigint, total bigint, last_session date"
BAR = [x.split()[0] for x in schemas.TABLES["bars"].split(", ")]
ORDER = ["_time", "_file", "_row"]


class FirstDelivered(StatefulProcessor):
    """Of one symbol: the months that have a bar already, in order, with the days of each, and how many bars there are and up to when.

    All of it is one value, so that a symbol costs a batch one read and one write of state however many months it brings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "months array<int>, days array<bigint>, total bigint, last_session date")

    def _get(self) -> tuple:
        return self.state.get() or ([], [], 0, None)

    def _add(self, sessions: pd.Series, known: tuple) -> tuple[np.ndarray, tuple]:
        """Notes sessions (no repeats); gives which of them are new, and what is known then."""
        at = pd.DatetimeIndex(sessions)
        month, bit = (at.year * 12 + at.month - 1).to_numpy(), np.left_shift(np.int64(1), at.day.to_numpy().astype(np.int64))
        months, had, total, last = known
        months, had = np.asarray(months, np.int64), np.asarray(had, np.int64)
        every = np.union1d(months, month)
        days = np.zeros(len(every), np.int64)
        days[np.searchsorted(every, months)] = had
        place = np.searchsorted(every, month)
        new = days[place] & bit == 0
        if new.any():
            np.bitwise_or.at(days, place[new], bit[new])
            latest = at[new].max().date()
            known = (every.tolist(), days.tolist(), int(total) + int(new.sum()), latest if last is None else max(last, latest))
            self.state.update(known)
        return new, known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, delivered = None, 0
        for part in rows:  # holds the symbol's distinct bars of this batch
            if not len(part):
                continue  # a symbol of the initial state alone
            part.columns = [*BAR, *ORDER, "usable"]  # by place: Spark renames columns made of file metadata from the second batch on
            part["session"] = pd.to_datetime(part["session"])
            usable = part[part["usable"].astype(bool)]
            delivered += len(usable)
            both = usable if first is None else pd.concat([first, usable])
            first = both.sort_values(ORDER).drop_duplicates("session")
        if first is None:
            return
        known = self._get()
        new = first
        if len(first):
            fresh, known = self._add(first["session"], known)
            new = first[fresh]
        if len(new):
            out = new[BAR].assign(delivered=None, added=None, total=None, last_session=None)
            yield out.assign(session=out["session"].dt.date)
        counts = dict.fromkeys(BAR) | {"market": key[0], "symbol": key[1], "delivered": delivered, "added": len(new), "total": known[2], "last_session": known[3]}
        yield pd.DataFrame([counts])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._add(pd.to_datetime(initialState["session"]), self._get())


def first_delivered(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """OUT of a stream of bars with usable and ORDER; stored: the bars (market, symbol, session) that the state begins with."""
    begun = None if stored is None else stored.select(*KEY, "session").distinct().groupBy(*KEY)
    return rows.groupBy(*KEY).transformWithStateInPandas(FirstDelivered(), OUT, "Append", "None", initialState=begun)


def start(spark: SparkSession, source: str, base: str, checkpoint: str, now: Column | None = None, params: Params = Params(), files_per_batch: int = 1000) -> StreamingQuery:
    """Appends all that is available under source (Parquet files of raw rows) and stops.

    Of a bar that is delivered again, in the same batch, a later one or after a restart, the first delivery
    stays. Bars that aren't final or weren't traded are no deliveries, and may come later. The bars that are
    stored when the stream begins are part of its state. A batch that is repeated after a failure changes
    nothing: it is appended keep-first, and its counts (:func:`feed`) take the place of its earlier ones.
    One stream fills a base. What others store in the meantime stays too, but its bars count as the stream's if they come again.
    """
    now = F.current_timestamp() if now is None else now

    def append(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        session = batch.sparkSession
        tables.append_bars(session, base, batch.filter("session IS NOT NULL").select(*BAR))
        counts = batch.filter("session IS NULL").select("market", "symbol", "delivered", "added", "total", "last_session")
        counts.write.mode("overwrite").parquet(f"{tables.path(base, 'feed')}/batch={n}")
        batch.unpersist()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state of all symbols needs a store that isn't a whole map in memory
    m = F.col("_metadata")
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    raw = raw.select("*", m["file_modification_time"].alias("_time"), m["file_path"].alias("_file"), m["row_index"].alias("_row"))
    usable = F.coalesce(hygiene.is_usable(now, params), F.lit(False))
    rows = parse_bars(raw, *ORDER).withColumn("usable", usable).select(*BAR, *ORDER, "usable")
    begun = f"{checkpoint.rstrip('/')}-begun"  # written once, so that a first batch that is repeated begins with the same state
    if not tables.exists(spark, f"{begun}/_SUCCESS"):
        tables.read(spark, base, "bars").select(*KEY, "session").write.mode("overwrite").parquet(begun)
    known = spark.read.schema("market string, symbol string, session date").parquet(begun)
    return first_delivered(rows, known).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed(spark: SparkSession, base: str) -> DataFrame:
    """batch, market, symbol, delivered, added, total, last_session: what each batch had of each symbol, and all so far."""
    where = tables.path(base, "feed")
    kind = f"{FEED}, batch bigint"
    rows = spark.read.schema(kind).parquet(where) if tables.exists(spark, where) else spark.createDataFrame([], kind)
    return rows.select("batch", *[x.split()[0] for x in FEED.split(", ")])


def quiet(spark: SparkSession, base: str, sessions: int = 1) -> DataFrame:
    """market, symbol, last_session, market_session of symbols whose last bar lies so many sessions of their market or more behind its last one."""
    last = feed(spark, base).groupBy("market", "symbol").agg(F.max("last_session").alias("last_session"))
    days = last.groupBy("market").agg(F.sort_array(F.collect_set("last_session"), asc=False).alias("_days"))  # at most the market's sessions
    out = last.join(F.broadcast(days), "market")
    behind = F.when(F.col("last_session").isNull(), F.size("_days")).otherwise(F.array_position("_days", F.col("last_session")) - 1)
    return out.filter(behind >= sessions).select("market", "symbol", "last_session", F.col("_days")[0].alias("market_session"))
