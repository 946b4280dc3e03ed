"""Queries over bars that are derived from the order tables, one for each operator or group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import dates
from tidemark.operators import acceptance, calendar, candidates, chart, detection, digest, hygiene, labels, ranks, regime, runs, sectors, tables, universe
from tidemark.operators import indicators as ind
from tidemark.operators.copies import carried, spread
from tidemark.params import DERIVED, LOOKBACKS
from tidemark.plans import nights
from tidemark.sources import bars as bar_source
from tidemark.sources import derived, listings
from tidemark.sources.shared import compiled_by_parts, folder, stored
from tidemark.streaming import ingest, members

#: An instant inside the last sessions: the US bar of that day isn't final yet, the IDX bar is.
NOW = "2001-10-22 20:15:00"
DIGITS = 8


def r(name: str, value: Column | None = None) -> Column:
    return F.round(F.col(name) if value is None else value, DIGITS).alias(name)


class Tables:
    """The relations that queries share. What others are derived from is written once, at its first use, and read after that."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.params = spark, sf_dir, DERIVED
        compiled_by_parts(spark)

    @cached_property
    def raw(self) -> DataFrame:
        return derived.raw_bars(self.spark, self.sf_dir)

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame]:
        return derived.traded_and_index(self.spark, self.sf_dir)

    @cached_property
    def bars(self) -> DataFrame:
        return DataFrame.unionByName(*self.parts)

    @cached_property
    def days(self) -> DataFrame:
        """market, session of every session: an index has a bar on each, so that the calendar needs no scan of all bars."""
        return self.parts[1].select("market", "session")

    @cached_property
    def instruments(self) -> DataFrame:
        return derived.instruments(self.spark, self.sf_dir)

    @cached_property
    def resolutions(self) -> DataFrame:
        return derived.resolutions(self.spark, self.sf_dir, self.days)

    @cached_property
    def labels(self) -> DataFrame:
        return derived.labels(self.spark, self.sf_dir, self.days)

    @cached_property
    def runs(self) -> DataFrame:
        return derived.runs(self.spark, self.sf_dir, self.days)

    @cached_property
    def counted(self) -> DataFrame:
        """The universe, and below ranks and detections, with copies where suppliers share a symbol."""
        return stored(universe.counted(self.instruments, self.bars, self.resolutions, self.params, days=self.days), "universe")

    @cached_property
    def counted_ranks(self) -> DataFrame:
        return stored(ranks.ranks(self.counted, self.bars, self.params), "ranks")

    @cached_property
    def counted_detections(self) -> DataFrame:
        return stored(detection.detections(self.counted, self.counted_ranks, self.bars, self.params), "detections")

    @cached_property
    def universe(self) -> DataFrame:
        return spread(self.counted)

    @cached_property
    def ranks(self) -> DataFrame:
        return spread(self.counted_ranks)

    @cached_property
    def detections(self) -> DataFrame:
        return spread(self.counted_detections)

    @cached_property
    def gates(self) -> DataFrame:
        return detection.bar_gates(self.bars, self.params)

    @cached_property
    def sessions(self) -> DataFrame:
        return calendar.sessions(self.days).select("market", "session")

    @cached_property
    def digest(self) -> DataFrame:
        return stored(digest.digest(self.counted_detections, self.bars, self.counted_ranks, self.labels, self.sessions, None, self.params), "digest")


def _symbol_key(k: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 5, "0"))


def listing_source(t: Tables) -> DataFrame:
    """Two listing files and a list of symbols, as text lines made from suppliers."""
    own = t.spark.read.parquet(f"{t.sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    test, etf = F.when(F.col("k") % 10 == 1, "Y").otherwise("N"), F.when(F.col("k") % 13 == 0, "Y").otherwise("N")
    sym = _symbol_key(F.col("k"))
    one = own.filter("k % 3 = 0").select(F.concat_ws("|", sym, F.concat(F.lit(" "), F.col("name"), F.lit(" ")), F.lit("Q"), test, F.lit("N"), F.lit("100"), etf, F.lit("N")).alias("value"))
    two = own.filter("k % 3 = 1").select(F.concat_ws("|", sym, "name", F.lit("N"), sym, etf, F.lit("100"), test, sym).alias("value"))
    text = lambda *lines: t.spark.createDataFrame([(x,) for x in lines], "value string")
    one = text("Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares", "File Creation Time: 1102200121:30|||||||", "S1|short").union(one)
    two = text("ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol", "").union(two)
    us = listings.index_rows(t.spark, "US").unionByName(listings.us_listing(one)).unionByName(listings.us_listing(two))
    return us.unionByName(listings.idx_instruments(own.filter("k % 3 = 2").select(sym.alias("symbol"))))


def clean_bars(t: Tables) -> DataFrame:
    names = {v: k for k, v in bar_source.RAW.items()}
    rows = t.raw.select("market", "symbol", F.concat(F.col("session").cast("string"), F.lit("T00:00:00")).alias("Date"), *[F.col(c).alias(names[c]) for c in names], F.col("volume").alias("Volume"))
    return hygiene.clean(bar_source.parse_bars(rows), F.lit(NOW).cast("timestamp"), t.params).withColumn("dollar_volume", F.round(hygiene.dollar_volume(), DIGITS))


def keep_first_append(t: Tables) -> DataFrame:
    week = F.expr(derived.WEEK)
    first = t.bars.withColumn("delivery", F.lit(1))
    again = first.filter(week % 2 == 1).withColumn("close", F.col("close") + 1).withColumn("delivery", F.lit(2))
    stored = t.bars.filter(week % 5 == 0)
    return tables.keep_first(first.unionByName(again), stored)


def last_final(t: Tables) -> DataFrame:
    at = F.explode(F.array(F.expr("CAST(date_add(session, 4) AS TIMESTAMP) + INTERVAL 12 HOURS"), F.expr("CAST(date_add(session, 6) AS TIMESTAMP) + INTERVAL 12 HOURS"))).alias("now")
    rows = t.sessions.select("market", "session", at)
    due = dates.run_is_due(F.date_add("session", 4), F.col("market"), F.col("now"), t.params)
    return rows.select("market", "session", "now", dates.last_final_session(F.col("market"), F.col("now"), t.params).alias("last_final"), due.alias("run_due"))


ROLLING = ("adr", "adr_abs", "sma10", "sma20", "sma50", "adj_sma10", "adj_sma20")


def adr_sma(t: Tables) -> DataFrame:
    rows = ind.rolling(t.bars, t.params)
    return rows.select("market", "symbol", "session", "idx", *[r(c) for c in ROLLING], *[f"{c}_rising" for c in ("sma20", "adj_sma10", "adj_sma20")])


def calendar_returns(t: Tables) -> DataFrame:
    return ind.calendar_returns(t.bars).withColumn("raw_return", F.round("raw_return", DIGITS))


def _rounded_ranks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_return", F.round("raw_return", DIGITS)).withColumn("percentile", F.round("percentile", DIGITS))


def rank_table(t: Tables) -> DataFrame:
    return _rounded_ranks(t.ranks)


def rank_ranges(t: Tables) -> DataFrame:
    """rank_table, as it is ranked where a session has too many members for one task."""
    return _rounded_ranks(spread(ranks.ranks(t.counted, t.bars, replace(t.params, sorted_rows=0))))


def flagship(t: Tables) -> DataFrame:
    """Boards of the names that traded on a session: bars, calendar returns, ranks, top 30."""
    returns = ind.calendar_returns(t.bars.filter("symbol NOT LIKE '^%'"))
    return ranks.boards(returns, t.params).withColumn("raw_return", F.round("raw_return", DIGITS)).withColumn("percentile", F.round("percentile", DIGITS))


def leaderboards(t: Tables) -> DataFrame:
    return ranks.leaderboards(t.counted_ranks, t.bars, t.params).withColumn("raw_return", F.round("raw_return", DIGITS)).withColumn("adr", F.round("adr", DIGITS))


def _flat(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("shape_differential", F.round("shape_differential", DIGITS))
    for x in LOOKBACKS:
        out = out.withColumn(f"share_{x}", F.round(F.col("shares")[x], DIGITS)).withColumn(f"k_{x}", F.col("decile_counts")[x])
    return out.drop("shares", "decile_counts")


def sector_board(t: Tables) -> DataFrame:
    return _flat(sectors.sector_board(t.ranks, t.labels, t.params)).withColumn("temporal_delta", F.round("temporal_delta", DIGITS))


def industry_board(t: Tables) -> DataFrame:
    return _flat(sectors.industry_board(t.ranks, t.labels, t.params))


def leave_one_out(t: Tables) -> DataFrame:
    return sectors.leave_one_out(t.ranks, t.labels, t.params).withColumn("share", F.round("share", DIGITS))


def cluster(t: Tables) -> DataFrame:
    c = F.col("cluster")
    rows = detection.clusters(ind.rolling(t.bars, t.params), t.params)
    return rows.select("market", "symbol", "session", c["k"].alias("k"), c["high"].alias("high"), c["low"].alias("low"), r("range_adr", c["range_adr"]))


def catch_up(t: Tables) -> DataFrame:
    return detection.catch_up(ind.rolling(t.bars, t.params), t.params).select("market", "symbol", "session", "caught_up")


def _passing(t: Tables) -> DataFrame:
    return t.gates.filter("passes").select("market", "symbol", "session", "idx", "adr", "adr_abs", "close", "cluster", "sma20_rising", "move", "recent")


def _bases(t: Tables) -> DataFrame:
    rows = detection.base_span(_passing(t).filter("move IS NOT NULL"), t.params)
    return rows.filter(F.col("base_len") >= t.params.base_min)


def _shapes(t: Tables) -> DataFrame:
    return detection.with_bars(_bases(t), ind.numbered(t.bars), t.params)


def prior_move(t: Tables) -> DataFrame:
    return _passing(t).select("market", "symbol", "session", r("gain", F.col("move.gain")), F.col("move.peak").alias("peak"))


def base_span(t: Tables) -> DataFrame:
    return _bases(t).select("market", "symbol", "session", "base_start", "base_len")


def churn_dryup(t: Tables) -> DataFrame:
    return detection.churn_dryup(_shapes(t), t.params).select("market", "symbol", "session", "base_low", r("churn_l"), r("dryup"))


def envelope(t: Tables) -> DataFrame:
    f = F.col("fit")
    rows = detection.envelope(_shapes(t), t.params)
    return rows.select("market", "symbol", "session", *[r(c, f[c]) for c in ("slope", "overshoot_adr", "line_end")], f["line_ok"].alias("line_ok"), f["touch_zones"].alias("touch_zones"))


ROUNDED = ("stop", "stopw_adr", "move_gain", "adr", "cluster_range_adr", "overshoot_adr", "slope", "line_end", "churn_l", "dryup")


def detections(t: Tables) -> DataFrame:
    return t.detections.select(*[r(c) if c in ROUNDED else F.col(c) for c in t.detections.columns])


def _hits() -> Column:
    return F.array_join(F.transform("breakdown", lambda x: F.when(x["hit"], F.concat(x["dimension"], F.lit("+"), x["weight"].cast("string"))).otherwise(x["dimension"])), ",")


def star_score(t: Tables) -> DataFrame:
    rows = spread(candidates.scored(t.counted_detections, t.counted_ranks, t.labels, t.params))
    return rows.select("market", "session", "symbol", "score", _hits().alias("breakdown"), r("sector_share"), "prior_move")


def candidate_list(t: Tables) -> DataFrame:
    rows = candidates.candidates(t.counted_detections, t.counted_ranks, t.labels, t.params)
    return rows.withColumn("breakdown", _hits()).withColumn("dist_adr", F.round("dist_adr", DIGITS)).withColumn("stopw_adr", F.round("stopw_adr", DIGITS))


def _rounded_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stopw_adr", F.round("stopw_adr", DIGITS)).withColumn("pct_through", F.round("pct_through", DIGITS))


def digest_rows(t: Tables) -> DataFrame:
    return _rounded_digest(t.digest)


def digest_report(t: Tables) -> DataFrame:
    return digest.report(t.digest, t.sessions)


def _charted(t: Tables) -> DataFrame:
    """Every candidate symbol, as of its market's last session with a detection."""
    last = t.counted_detections.groupBy("market").agg(F.max("session").alias("as_of"))
    return t.instruments.filter("role = 'candidate'").select("market", "symbol").join(F.broadcast(last), "market")


def chart_rows(t: Tables) -> DataFrame:
    rows = spread(chart.chart_rows(t.bars, _charted(t), t.counted_detections, t.params))
    return rows.select("market", "symbol", "session", "as_of", "back", "close", *[r(c) for c in ("sma10", "sma20", "sma50", "ema65", "dollar_volume", "envelope")], "in_base", "in_cluster")


def chart_bundle(t: Tables) -> DataFrame:
    """The nested bundle, told by a few of its figures."""
    rows = chart.chart_bundle(t.bars, _charted(t), t.counted_detections, t.counted_ranks, t.labels, t.params)
    s, f = F.col("setup"), F.col("facts")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["value"]), 4)
    return spread(rows.select(
        "market", "symbol", "as_of", F.size("candles").alias("n_candles"), F.col("candles")[0]["session"].alias("first_session"), total("sma50").alias("sma50_sum"), total("ema65").alias("ema65_sum"),
        s["base_start"].alias("base_start"), s["cluster_start"].alias("cluster_start"), s["trigger"].alias("trigger"), s["stop"].alias("stop"), F.coalesce(F.size(s["envelope"]), F.lit(0)).alias("n_envelope"),
        s["score"].alias("score"), r("dist_adr", f["dist_adr"]), F.round(f["decile_ranks"]["1m"], DIGITS).alias("decile_1m"), f["sector"].alias("sector"), *carried(rows),
    ).withColumn("n_envelope", F.greatest("n_envelope", F.lit(0))))


def run_gate(t: Tables) -> DataFrame:
    """Fetches without the weekly misses of every other month, so that some pulls are complete."""
    fine = t.resolutions.withColumn("status", F.when((F.month("session") % 2 == 0) & (F.col("status") == "unresolved"), "resolved").otherwise(F.col("status")))
    return runs.run_gate(t.instruments, fine, None, t.params)


def runs_summary(t: Tables) -> DataFrame:
    rows = runs.runs_summary(t.runs, t.universe, F.lit(NOW).cast("timestamp"), t.params)
    return rows.select("market", F.col("latest.session").alias("session"), F.col("latest.symbols_enumerated").alias("symbols_enumerated"), F.col("latest.symbols_resolved").alias("symbols_resolved"), "universe_size", "run_due", "stale")


def backfill_sessions(t: Tables) -> DataFrame:
    """Runs up to 2001 but for every seventh week; target: a day after the last session."""
    had = t.runs.filter(F.col("session") < F.lit("2001-06-01").cast("date")).unionByName(t.runs.filter(F.col("session") >= F.lit("2001-06-01").cast("date")).filter(F.expr(derived.WEEK) % 7 == 0).withColumn("status", F.lit("quarantined")))
    targets = t.days.groupBy("market").agg(F.date_add(F.max("session"), 1).alias("target"))
    return calendar.to_backfill(had, t.sessions, targets)


def _last_members(t: Tables) -> DataFrame:
    last = t.universe.groupBy("market").agg(F.max("session").alias("session"))
    return t.universe.join(F.broadcast(last), ["market", "session"], "left_semi")


def _cached(t: Tables) -> DataFrame:
    return t.labels.filter("CAST(substring(symbol, 2) AS INT) % 4 <> 1")


def label_refresh(t: Tables) -> DataFrame:
    """A third of the labels are new; what resolves is stamped with the last session."""
    members = _last_members(t)
    day = members.groupBy("market").agg(F.max("session").alias("day"))
    fetched = t.labels.withColumn("status", F.when(F.expr("CAST(substring(symbol, 2) AS INT) % 6 = 2"), "unresolved").otherwise("resolved")).join(F.broadcast(day), "market")
    fetched = fetched.select("market", "symbol", "status", "sector", F.upper("industry").alias("industry"), F.col("day").alias("as_of"))
    return labels.refresh(members, _cached(t), fetched, t.params)


def labels_to_fetch(t: Tables) -> DataFrame:
    return labels.to_fetch(_last_members(t), _cached(t), t.params)


def acceptance_figures(t: Tables) -> DataFrame:
    rows = acceptance.acceptance(t.universe, t.ranks, t.detections, t.labels, t.digest, t.params)
    return rows.withColumn("measured", F.round("measured", DIGITS))


def backfill(t: Tables) -> DataFrame:
    """Every session that backfill_sessions finds absent, computed as a night: the rows of each table, told by two figures."""
    got = nights.compute(t.instruments, t.bars, t.resolutions, t.labels, backfill_sessions(t), None, t.params, t.days)
    none = F.lit(None)
    rows = lambda name, df, symbol, lookback, a, b: df.select(F.lit(name).alias("table"), "market", "session", symbol.cast("string").alias("symbol"), lookback.cast("string").alias("lookback"), r("a", a.cast("double")), r("b", b.cast("double")))
    parts = [
        rows("universe", got.universe, F.col("symbol"), none, none, none),
        rows("ranks", got.ranks, F.col("symbol"), F.col("lookback"), F.col("percentile"), F.col("raw_return")),
        rows("detections", got.detections, F.col("symbol"), none, F.col("trigger"), F.col("stopw_adr")),
        rows("follow_through", got.follow_through, none, none, F.col("index_close"), F.col("broke_out")),
        rows("digest", got.digest, F.col("symbol"), none, F.col("position"), F.col("pct_through")),
    ]
    return reduce(DataFrame.unionByName, parts)


def ingest_counts(t: Tables) -> DataFrame:
    """All bars are delivered to a store that has those of every fifth week."""
    base = f"{folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    tables.append_bars(t.spark, base, t.bars.filter(F.expr(derived.WEEK) % 5 == 0))
    return tables.append_counted(t.spark, base, t.bars)


def stream_bars(t: Tables) -> DataFrame:
    """Even weeks are delivered, then all with other closes, in one batch; after a restart all once more. The stored bars, with their symbol's counts."""
    base = f"{folder(t.spark)}/stream-{uuid.uuid4().hex}"
    names = {v: k for k, v in bar_source.RAW.items()}
    own = t.raw.select("market", "symbol", F.col("session").cast("string").alias("Date"), *[F.col(c).alias(names[c]) for c in names], F.col("volume").alias("Volume"))
    own = stored(own, "raw")
    put = lambda rows, more: rows.withColumn("Close", F.col("Close") + more).write.mode("append").parquet(f"{base}/raw")
    go = lambda: ingest.start(t.spark, f"{base}/raw", f"{base}/bars", f"{base}/check", F.lit(NOW).cast("timestamp"), t.params).awaitTermination()
    put(own.filter(F.expr(derived.WEEK.replace("session", "CAST(Date AS DATE)")) % 2 == 0), 0)
    put(own, 1)
    go()
    put(own, 2)
    go()
    counts = ingest.feed(t.spark, f"{base}/bars").groupBy("market", "symbol").agg(*[F.sum(c).alias(c) for c in ("delivered", "added")], *[F.max(c).alias(c) for c in ("total", "last_session")])
    return tables.read(t.spark, f"{base}/bars", "bars").select("market", "symbol", "session", "close", "volume").join(counts, ["market", "symbol"])


def _by_thirds(t: Tables, rows: DataFrame, name: str) -> tuple[str, Column, list[DataFrame]]:
    """A new folder, whether a session is in the first third of the weeks' range, and the rows (stored) of each third."""
    week = F.expr(derived.WEEK)
    a, b = rows.agg(F.coalesce(F.min(week), F.lit(0)), F.coalesce(F.max(week), F.lit(0))).first()
    third = F.floor((week - a) * 3 / (b - a + 1))
    return f"{folder(t.spark)}/{name}-{uuid.uuid4().hex}", third == 0, [rows.filter(third == i) for i in range(3)]


def stream_universe(t: Tables) -> DataFrame:
    """The universe with the sessions of a first third as the stored state, and the others as a stream that is stopped and started once."""
    rows = stored(members.grid(t.instruments, t.bars, t.resolutions, t.params, t.days), "grid")
    shared = bool(carried(rows))
    base, early, (first, *later) = _by_thirds(t, rows, "grid")
    for rows in later:
        rows.write.mode("append").parquet(f"{base}/raw")
        members.start_members(t.spark, f"{base}/raw", f"{base}/members", f"{base}/check", first, t.params, shared=shared).awaitTermination()
    before = universe.counted(t.instruments, t.bars.filter(early), t.resolutions.filter(early), t.params, days=t.days.filter(early))  # a session's members depend on no later one
    return spread(before.unionByName(members.read(t.spark, f"{base}/members", members.SHARED_MEMBERS if shared else members.MEMBERS)))


def stream_digest(t: Tables) -> DataFrame:
    """The digest with its repeat markers from a stream of reports; those of a first third are the stored state."""
    base, _, (first, *later) = _by_thirds(t, t.digest, "reports")
    for rows in later:
        rows.select("market", "symbol", "session").write.mode("append").parquet(f"{base}/raw")
        members.start_repeats(t.spark, f"{base}/raw", f"{base}/marks", f"{base}/check", first).awaitTermination()
    streamed = reduce(DataFrame.unionByName, later).drop("repeat", "last_reported").join(members.read(t.spark, f"{base}/marks", members.REPEATS), ["market", "symbol", "session"])
    # The stream marks a symbol's session once; what is reported more than once on it repeats itself.
    again = F.row_number().over(Window.partitionBy("market", "symbol", "session").orderBy("position")) > 1
    streamed = streamed.withColumn("_again", again).withColumn("repeat", F.col("repeat") | F.col("_again"))
    streamed = streamed.withColumn("last_reported", F.when(F.col("_again"), F.col("session")).otherwise(F.col("last_reported"))).drop("_again")
    return _rounded_digest(first.unionByName(streamed))


_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "boards": flagship,
    "listing_source": listing_source,
    "clean_bars": clean_bars,
    "keep_first_append": keep_first_append,
    "calendar": lambda t: calendar.sessions(t.days),
    "last_sessions": lambda t: calendar.last_session(t.bars),
    "last_final_session": last_final,
    "adr_sma": adr_sma,
    "ema65": lambda t: ind.ema(t.bars, t.params.ema).withColumn("ema", F.round("ema", DIGITS)),
    "median_dollar_volume": lambda t: t.bars.select("market", "symbol", "session", r("dollar_volume", ind.median_dollar_volume(t.params))),
    "calendar_returns": calendar_returns,
    "universe": lambda t: t.universe,
    "unresolved": lambda t: runs.unresolved(t.instruments, t.resolutions),
    "rank_table": rank_table,
    "rank_ranges": rank_ranges,
    "decile_gate": lambda t: ranks.decile_gate(t.counted_ranks, t.params),
    "detection_gate": lambda t: ranks.detection_gate(t.counted_ranks, t.params),
    "breadth_counts": lambda t: ranks.breadth_counts(t.counted_ranks, t.params),
    "leaderboards": leaderboards,
    "leaderboards_without_low_adr": lambda t: ranks.without_low_adr(leaderboards(t), t.params),
    "board_names": lambda t: ranks.board_names(t.counted_ranks, t.params),
    "sector_board": sector_board,
    "industry_board": industry_board,
    "leave_one_out": leave_one_out,
    "cluster": cluster,
    "catch_up": catch_up,
    "prior_move": prior_move,
    "base_span": base_span,
    "churn_dryup": churn_dryup,
    "envelope": envelope,
    "detections": detections,
    "star_score": star_score,
    "candidates": candidate_list,
    "regime": lambda t: regime.regime(t.bars, t.universe, t.params).withColumn("breadth", F.round("breadth", DIGITS)),
    "market_breadth": lambda t: regime.breadth(t.universe, t.bars, t.params).withColumn("breadth", F.round("breadth", DIGITS)),
    "follow_through": lambda t: regime.follow_through(t.bars, t.params),
    "digest": digest_rows,
    "digest_report": digest_report,
    "chart_rows": chart_rows,
    "chart_bundle": chart_bundle,
    "run_gate": run_gate,
    "runs_summary": runs_summary,
    "backfill_sessions": backfill_sessions,
    "labels_to_fetch": labels_to_fetch,
    "label_refresh": label_refresh,
    "label_coverage": lambda t: labels.coverage(t.universe, t.labels),
    "retention": lambda t: tables.retained(t.ranks, t.params.retention_months).withColumn("raw_return", F.round("raw_return", DIGITS)).withColumn("percentile", F.round("percentile", DIGITS)),
    "readable_sessions": lambda t: tables.readable(t.universe, t.runs, "published"),
    "debris": lambda t: tables.debris(t.universe, t.runs.filter("status = 'published'")),
    "acceptance": acceptance_figures,
    "spot_check": lambda t: acceptance.spot_check(t.universe, ("S00001", "S00002", "S00003", "S00005", "S00008", "S00013")),
    "backfill": backfill,
    "ingest_counts": ingest_counts,
    "stream_bars": stream_bars,
    "stream_universe": stream_universe,
    "stream_digest": stream_digest,
}


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


QUERIES = {name: _query(f) for name, f in _QUERIES.items()}
