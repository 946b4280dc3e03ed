"""The whole flow over any set of sessions, in one plan for each table.

All (market, session, symbol) keys are computed together; a nightly run is the same plan for one session,
over the bars that it depends on and the state that the run before has left.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce

from dateutil.relativedelta import relativedelta
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import calendar, candidates, detection, digest, hygiene, ranks, regime, runs, tables, universe
from tidemark.operators import labels as label_rules
from tidemark.operators.copies import spread
from tidemark.params import Params
from tidemark.sources import files, shared, versions
from tidemark.sources.bars import parse_bars

#: The tables that a night publishes.
STAGED = ("runs", "universe", "ranks", "detections", "follow_through", "digest_breaks", "digest_reports", "symbol_state")


@dataclass
class Nights:
    universe: DataFrame
    ranks: DataFrame
    detections: DataFrame
    follow_through: DataFrame
    digest: DataFrame


def compute(instruments: DataFrame, bars: DataFrame, resolutions: DataFrame, labels: DataFrame, nights: DataFrame | None = None, reported: DataFrame | None = None, params: Params = Params(), calendar_days: DataFrame | None = None) -> Nights:
    """Every derived table; nights (market, session) limits the sessions that are given back, not what they see.

    Membership carries over sessions, and the triggers that a night tests are those of the latest session
    with detections, however long ago: so everything is computed up to the last night of each market.
    :func:`run_market` reads what has been stored instead. calendar_days: the sessions of bars, if they are known.
    """
    shared.compiled_by_parts(bars.sparkSession)
    bars = shared.stored(bars, "bars")
    members = shared.stored(universe.counted(instruments, bars, resolutions, params, days=calendar_days), "universe")
    if nights is None:
        wanted, own = members, None
    else:
        own = shared.stored(nights.select("market", "session").distinct(), "nights")
        last = own.groupBy("market").agg(F.max("session").alias("_last"))
        wanted = members.join(F.broadcast(last), "market").filter(F.col("session") <= F.col("_last")).drop("_last")
    limit = (lambda x: x) if own is None else (lambda x: x.join(F.broadcast(own), ["market", "session"], "left_semi"))
    all_ranks = shared.stored(ranks.ranks(wanted, bars, params), "ranks")
    found = shared.stored(detection.detections(wanted, all_ranks, bars, params), "detections")
    days = calendar.sessions(bars).select("market", "session") if own is None else own
    return Nights(*[spread(limit(x)) for x in (members, all_ranks, found)], limit(regime.follow_through(bars, params)), digest.digest(found, bars, all_ranks, labels, days, reported, params))


def ingest(spark: SparkSession, base: str, raw: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    """Raw rows to stored bars: parse, drop phantoms and what isn't final, append what isn't stored. Gives market, symbol, delivered, added for every symbol that raw has a row of: a name that went quiet has none added."""
    parsed = parse_bars(raw)
    counts = tables.append_counted(spark, base, hygiene.clean(parsed, now, params))
    return parsed.select("market", "symbol").distinct().join(counts, ["market", "symbol"], "left").na.fill(0, ["delivered", "added"])


@dataclass
class Span:
    """What a market's run computes: the nights from first to last; known is the session whose state it goes on from, if there is one."""

    market: str
    first: date
    last: date
    known: date | None


#: Months before the first night that are read of every symbol: the longest lookback, and the bar before its anchor.
MONTHS = 13


def needed_bars(spark: SparkSession, base: str, spans: list[Span], state: DataFrame, params: Params = Params()) -> DataFrame:
    """The bars that the nights of spans depend on, with deep (are these all bars of the symbol?).

    Of every symbol those of the last months are read. Earlier ones are read only of symbols that have some and
    whose recent bars don't reach back far enough: fewer before the first night than detection looks at, none
    at the longest lookback's anchor, or late ones, which the state doesn't know of. All bars of a market
    without a state are read.
    """
    month = lambda d: d.replace(day=1)
    begin = {x.market: month(x.first - relativedelta(months=MONTHS)) if x.known else None for x in spans}
    here = lambda x, test: F.lit(False) if x is None else (F.col("market") == x.market) & test
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    upto = [here(x, F.col("month") <= month(x.last)) for x in spans]
    recent = any_of(t & (F.lit(True) if begin[x.market] is None else F.col("month") >= F.lit(begin[x.market])) for x, t in zip(spans, upto, strict=True))
    ends = spark.createDataFrame([(x.market, x.first, x.last, x.known, x.first - relativedelta(months=12)) for x in spans], "market string, _first date, _last date, _known date, _anchor date")
    bars = tables.read(spark, base, "bars", lambda x: x.filter(recent)).join(F.broadcast(ends.select("market", "_last")), "market").filter(F.col("session") <= F.col("_last")).drop("_last")
    whole = [x.market for x in spans if x.known is None]
    if len(whole) == len(spans):
        return bars.withColumn("deep", F.lit(True))

    n = bars.join(F.broadcast(ends), "market").groupBy("market", "symbol").agg(
        F.count_if(F.col("session") <= F.col("_known")).alias("_in"), F.count_if(F.col("session") < F.col("_first")).alias("_before"),
        F.min("session").alias("_oldest"), F.first("_anchor").alias("_anchor"),
    )
    where = tables.path(base, "late")
    late = spark.read.schema("symbol string, market string").parquet(where) if tables.exists(spark, where) else spark.createDataFrame([], "symbol string, market string")
    late = late.select("market", "symbol").distinct().withColumn("_late", F.lit(True))
    held = state.select("market", "symbol", "bars", "member").join(n, ["market", "symbol"], "left").join(late, ["market", "symbol"], "full")
    reach = max(params.move_windows) + 1
    short = (F.coalesce("_before", F.lit(0)) < reach) | F.col("_oldest").isNull() | (F.col("_oldest") > F.col("_anchor"))
    more = (F.col("bars") > F.coalesce("_in", F.lit(0))) & short & (F.col("_in").isNotNull() | F.col("member"))
    deep = shared.stored(held.filter(F.coalesce("_late", F.lit(False)) | more).filter(~F.col("market").isin(whole)).select("market", "symbol"), "deep")
    if not deep.take(1):
        return bars.withColumn("deep", F.col("market").isin(whole))
    early = any_of(here(x, F.col("month") < F.lit(begin[x.market])) for x in spans if begin[x.market])
    older = tables.read(spark, base, "bars", lambda x: x.filter(early)).join(deep, ["market", "symbol"], "left_semi")
    marked = bars.join(deep.withColumn("deep", F.lit(True)), ["market", "symbol"], "left").withColumn("deep", F.coalesce("deep", F.col("market").isin(whole)))
    return marked.unionByName(older.withColumn("deep", F.lit(True)))


def next_state(bars: DataFrame, spans: list[Span], state: DataFrame, members: DataFrame, reports: DataFrame) -> DataFrame:
    """symbol_state as of each span's last night: the number of bars so far, membership, and the last report."""
    ends = state.sparkSession.createDataFrame([(x.market, x.last, x.known) for x in spans], "market string, _last date, _known date")
    key = ["market", "symbol"]
    counts = bars.join(F.broadcast(ends), "market").groupBy(*key).agg(F.count("*").alias("_all"), F.count_if(F.col("session") > F.col("_known")).alias("_new"), F.max("deep").alias("_deep"))
    last = members.join(F.broadcast(ends.select("market", F.col("_last").alias("session"))), ["market", "session"], "left_semi").select(*key, F.lit(True).alias("_member"))
    told = reports.groupBy(*key).agg(F.max("session").alias("_told"))
    out = state.select(*key, "bars", "last_report").join(counts, key, "full").join(last, key, "full").join(told, key, "full").join(F.broadcast(ends), "market")
    n = F.when(F.coalesce("_deep", F.lit(False)) | F.col("bars").isNull(), F.coalesce("_all", F.lit(0))).otherwise(F.col("bars") + F.coalesce("_new", F.lit(0)))
    return out.select("market", F.col("_last").alias("session"), "symbol", n.cast("long").alias("bars"), F.coalesce("_member", F.lit(False)).alias("member"), F.greatest("last_report", "_told").alias("last_report"))


def run_market(spark: SparkSession, base: str, instruments: DataFrame, resolutions: DataFrame, labels: DataFrame, targets: DataFrame, now: Column, params: Params = Params(), fetched: DataFrame | None = None) -> DataFrame:
    """Computes and stores every session that a run for targets (market, target) lacks; gives the new run records.

    A run goes on from the state that the last one left, and reads the bars of the last months only. It
    stages all its rows and then publishes the sessions of each market by one commit, so that a run that breaks
    off at any point leaves nothing that is seen, and a run of another market isn't in its way; another run
    of the same market makes the later of the two fail. Ranks beyond their retention go. Each night has a
    report under reports; reports that an earlier run has published but not written out are written first.

    labels: stored first where no labels are. fetched: outcomes of label fetches; those that the members of
    a target session that is computed now ask for go into the stored labels.
    resolutions: the fetch outcomes of the target sessions, which hold for every session that is filled in.
    A market whose pull is incomplete gets a quarantined run for its target and nothing else. Bars must be stored already.
    """
    shared.compiled_by_parts(spark)
    seen, attempt = tables.last_commits(spark, base), uuid.uuid4().hex
    write_out(spark, base)
    labels_at = tables.path(base, "labels")
    kept = lambda df: versions.upsert(spark, labels_at, schemas.reconcile(df, "labels"), schemas.schema("labels"), schemas.KEYS["labels"])
    if not versions.last(spark, labels_at)[0] and labels.take(1):
        kept(labels)
    labels = tables.read(spark, base, "labels")
    stored = shared.stored(tables.read(spark, base, "runs"), "runs")
    asked = resolutions.join(F.broadcast(targets.select("market", F.col("target").alias("session"))), ["market", "session"], "left_semi")
    gate = shared.stored(runs.run_gate(instruments, asked, stored, params), "gate")
    good = targets.join(F.broadcast(gate.filter("status = 'published'").select("market")), "market", "left_semi")
    latest = {r["market"]: r["d"] for r in stored.filter("status = 'published'").groupBy("market").agg(F.max("session").alias("d")).collect()}  # a row a market
    recent = lambda x: x.filter(F.col("month") >= F.lit(min(latest.values()).replace(day=1))) if latest else x.limit(0)
    nights = shared.stored(calendar.to_backfill(stored, tables.read(spark, base, "bars", recent).select("market", "session"), good), "nights")
    days = [(r["market"], r["session"]) for r in nights.collect()]  # a row a session
    held_back = gate.filter("status <> 'published'").select("market", "session", "status", "symbols_enumerated", "symbols_resolved").join(stored.select("market", "session"), ["market", "session"], "left_anti")
    counts = gate.filter("status = 'published'").select("market", "status", "symbols_enumerated", "symbols_resolved")
    record = nights.join(F.broadcast(counts), "market").select("market", "session", "status", "symbols_enumerated", "symbols_resolved").unionByName(held_back)
    record = shared.stored(record.withColumn("created_at", now.cast("timestamp")), "record")
    tables.stage(spark, base, "runs", record, attempt)
    if days:
        night(spark, base, attempt, instruments, asked, labels, nights, days, latest, good, fetched, kept, params)
        tables.commit(spark, base, attempt, STAGED, days, seen)
    other = [(r["market"], r["session"]) for r in record.collect() if (r["market"], r["session"]) not in days]
    if other:
        tables.commit(spark, base, attempt, ("runs",), other, tables.last_commits(spark, base) if days else seen)
    if days:
        write_out(spark, base)
        where = tables.path(base, "late")
        for market in {m for m, _ in days}:
            files.delete(spark, f"{where}/market={market}")
        tables.prune(spark, base, "ranks", params.retention_months)
    return record


def night(spark, base: str, attempt: str, instruments, asked, labels, nights, days: list, latest: dict, good, fetched, kept, params: Params) -> None:
    """Stages all tables of the nights."""
    known = {r["market"]: r["d"] for r in tables.commits(spark, base).filter("table = 'symbol_state'").groupBy("market").agg(F.max("session").alias("d")).collect()}  # a row a market
    spans = [Span(m, min(d for k, d in days if k == m), max(d for k, d in days if k == m), known.get(m) if known.get(m) == latest.get(m) else None) for m in sorted({m for m, _ in days})]
    old = [(x.market, x.known) for x in spans if x.known]
    at = lambda x, when: reduce(lambda a, b: a | b, [(F.col("market") == m) & (F.col("session") == F.lit(d)) for m, d in when], F.lit(False))
    state = shared.stored(tables.read(spark, base, "symbol_state", lambda x: x.filter(at(x, old))), "state")
    marked = shared.stored(needed_bars(spark, base, spans, state, params), "night_bars")
    bars = marked.drop("deep")
    own = lambda t: tables.staged(spark, base, t, attempt, days)
    put = lambda t, rows: tables.stage(spark, base, t, rows, attempt)

    outcomes = asked.drop("session").join(F.broadcast(nights), "market")
    signals = universe.membership(instruments, bars, outcomes, params, None).join(F.broadcast(nights), ["market", "session"], "left_semi")
    signals = signals.drop("member").join(state.select("market", "symbol", F.col("member").alias("_prior")), ["market", "symbol"], "left")
    upto = universe.ind.by_symbol().rowsBetween(universe.ind.Window.unboundedPreceding, 0)
    is_member = F.coalesce(F.last("signal", ignorenulls=True).over(upto) == 1, F.col("_prior"), F.lit(False))
    put("universe", signals.withColumn("_m", is_member).filter("_m").select("market", "session", "symbol"))
    if fetched is not None:
        targets = good.withColumnRenamed("target", "session").join(F.broadcast(nights), ["market", "session"], "left_semi")
        members = own("universe").join(F.broadcast(targets), ["market", "session"], "left_semi")
        kept(label_rules.resolved(members, labels, fetched, params).select(*labels.columns))
        labels = tables.read(spark, base, "labels")
    put("ranks", ranks.ranks(own("universe"), bars, params))
    put("detections", detection.detections(own("universe"), own("ranks"), bars, params))
    put("follow_through", regime.follow_through(bars, params).join(F.broadcast(nights), ["market", "session"], "left_semi"))

    # The triggers that the first night tests are those of the last session with detections, however long ago.
    before = tables.commits(spark, base).filter("table = 'detections' AND rows > 0").join(F.broadcast(nights.groupBy("market").agg(F.min("session").alias("_first"))), "market").filter("session < _first")
    live = [(r["market"], r["d"]) for r in before.groupBy("market").agg(F.max("session").alias("d")).collect()]  # a row a market
    back = lambda t: own(t).unionByName(tables.read(spark, base, t, lambda x: x.filter(at(x, live))))
    told = state.filter("last_report IS NOT NULL").select("market", F.col("last_report").alias("session"), "symbol")
    report = shared.stored(digest.digest(back("detections"), bars, back("ranks"), labels, nights, told, params), "digest")
    put("digest_breaks", report.select("market", "session", "symbol"))
    put("digest_reports", digest.report(report, nights))
    put("symbol_state", next_state(marked, spans, state, own("universe"), report))


def write_out(spark: SparkSession, base: str) -> None:
    """Writes out the reports of each market's last commit of nights that aren't there as files yet."""
    last = tables.commits(spark, base).filter("table = 'digest_reports'")
    attempts = last.groupBy("market").agg(F.max_by("attempt", "session").alias("attempt"))
    due = [(r["market"], r["session"]) for r in last.join(F.broadcast(attempts), ["market", "attempt"], "left_semi").collect()]  # sessions of one run a market
    due = [(m, d) for m, d in due if not tables.exists(spark, f"{tables.path(base, 'reports')}/market={m}/session={d}")]
    if due:
        days = spark.createDataFrame(due, "market string, session date")
        digest.write_report(tables.read(spark, base, "digest_reports", lambda x: x.join(F.broadcast(days), ["market", "session"], "left_semi")), tables.path(base, "reports"))


def candidate_list(night: Nights, labels: DataFrame, params: Params = Params()) -> DataFrame:
    return candidates.candidates(night.detections, night.ranks, labels, params)
