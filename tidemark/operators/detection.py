"""Consolidation bases: prior move, base, catch-up, cluster, envelope and the signals read from them.

The gates on a name are independent, so the cheap ones, columns of one window pass, come first; the run-up and
the base's span are columns of the same sort. Only the bars of bases that are left are attached as an array,
for medians and the envelope's grid search; that search alone runs in pandas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import indicators as ind
from tidemark.operators.copies import carried
from tidemark.operators.ranks import detection_gate
from tidemark.params import Params
from tidemark.sources.shared import stored

SEEN = ["market", "symbol", "session"]


def clusters(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """bars (with adr_abs) with cluster: the widest trailing window that is tight, as (k, high, low, range_adr), or null."""
    w, found = ind.by_symbol(), []
    back = {f"_{x}{i}": F.lag(x, i).over(w) for x in ("high", "low") for i in range(1, max(params.cluster_ks))}
    rows = bars.withColumns(back | {"_bars": F.row_number().over(w)})
    for k in params.cluster_ks:
        own = lambda x: [F.col(x), *[F.col(f"_{x}{i}") for i in range(1, k)]]  # noqa: B023, E731
        high, low = F.greatest(*own("high")), F.least(*own("low"))
        spread = F.try_divide(high - low, F.col("adr_abs"))
        fits = (F.col("_bars") >= k) & (F.col("adr_abs") > 0) & (spread <= params.tight)
        found.append(F.when(fits, F.struct(F.lit(k).alias("k"), high.alias("high"), low.alias("low"), spread.alias("range_adr"))))
    return rows.withColumn("cluster", F.coalesce(*found)).drop(*back, "_bars")


def catch_up(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """bars (with adr_abs, sma10, sma20) with caught_up: the close isn't far above either average. Far below is fine."""
    near = (F.col("close") - F.col("sma10") <= params.catch_up_10 * F.col("adr_abs")) & (F.col("close") - F.col("sma20") <= params.catch_up_20 * F.col("adr_abs"))
    return bars.withColumn("caught_up", F.coalesce(near, F.lit(False)))


def _both(earlier: Column, later: Column) -> Column:
    """The run-up over two spans that follow each other or overlap: later ends last.

    A low that lies in later is later's own first lowest, and later's peak is the whole one; another lies before
    later, so that every bar of later comes after it. Hence an overlap does no harm.
    """
    top = F.greatest(earlier["top"], later["top"])
    mine = F.struct(later["low"], later["at"]) <= F.struct(earlier["low"], earlier["at"])
    kept = F.struct(earlier["low"].alias("low"), earlier["at"].alias("at"), F.greatest(earlier["peak"], later["top"]).alias("peak"), top.alias("top"))
    return F.when(earlier.isNull(), later).when(mine, F.struct(later["low"].alias("low"), later["at"].alias("at"), later["peak"].alias("peak"), top.alias("top"))).otherwise(kept)


def run_ups(bars: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """bars (with idx) with a column for each size: the run-up of the last so many bars, (low, at, peak, top).

    low and at are the first lowest low and its idx, peak the first highest high from there on, top that of the
    whole span; both highs as (high, back), where back is the negative idx. Spans of 1, 2, 4, ... bars are built
    by doubling, and two of them that overlap make any other, so a bar costs a row of each power of two and all
    sizes share one sort. Where a symbol has fewer bars, a span begins with the first.
    """
    w = ind.by_symbol()
    high = F.struct(F.col("high"), (-F.col("idx")).alias("back"))
    out = bars.withColumn("_up0", F.struct(F.col("low"), F.col("idx").alias("at"), high.alias("peak"), high.alias("top")))
    level = {name: n.bit_length() - 1 for name, n in sizes.items()}
    for k in range(max(level.values())):
        before = F.lag(f"_up{k}", 1 << k).over(w)
        out = out.withColumn("_before", before).withColumn(f"_up{k + 1}", _both(F.col("_before"), F.col(f"_up{k}")))
    lags = {f"_{name}": F.lag(f"_up{level[name]}", n - (1 << level[name])).over(w) for name, n in sizes.items()}
    out = out.withColumns(lags).withColumns({name: _both(F.col(f"_{name}"), F.col(f"_up{level[name]}")) for name in sizes})
    return out.select(*bars.columns, *sizes)


def prior_move(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """bars (with idx) with move: (gain, peak idx) of the best run-up from a window's first lowest low to its first highest high after it, or null.

    Also with recent: the idx of the first highest high of the last base_max bars.
    """
    out = run_ups(bars, {f"_move{n}": n + 1 for n in params.move_windows} | {"_recent": params.base_max})
    moves = []
    for place, n in enumerate(params.move_windows):
        up = F.col(f"_move{n}")
        gain = (up["peak"]["high"] / up["low"] - 1.0) * 100.0
        fine = (F.least(F.col("idx"), F.lit(n)) + 1 > 5) & (up["low"] > 0)
        moves.append(F.when(fine, F.struct(gain.alias("gain"), F.lit(-place).alias("place"), (-up["peak"]["back"]).alias("peak"))))
    return out.withColumn("move", F.greatest(*moves)).withColumn("recent", -F.col("_recent")["top"]["back"]).select(*bars.columns, "move", "recent")


def base_span(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (with move, recent) with base_start (idx) and base_len: the base begins at the peak, or at recent if that is over base_max bars ago."""
    out = rows.withColumn("base_start", F.when(F.col("idx") - F.col("move.peak") + 1 > params.base_max, F.col("recent")).otherwise(F.col("move.peak")))
    return out.withColumn("base_len", (F.col("idx") - F.col("base_start") + 1).cast("int"))


MOVE = "gain double, peak int, recent int"


def best_moves(highs: list, lows: list, params: Params = Params()) -> pd.DataFrame:
    """Of each series of last bars: gain of the best run-up, and its peak and the first highest high of the last base_max bars, in places back from the end."""
    reach = max(params.base_max, *[n + 1 for n in params.move_windows])
    size = np.fromiter(map(len, highs), int, len(highs))
    high, low = np.full((len(highs), reach), -np.inf), np.full((len(highs), reach), np.inf)
    for i, (h, x) in enumerate(zip(highs, lows, strict=True)):
        n = min(len(h), reach)
        high[i, reach - n :], low[i, reach - n :] = h[-n:], x[-n:]
    own, place, gains, peaks = np.arange(len(highs)), np.arange(reach), [], []
    for n in params.move_windows:
        at = low[:, reach - n - 1 :].argmin(axis=1) + reach - n - 1  # the first lowest
        peak = np.where(place >= at[:, None], high, -np.inf).argmax(axis=1)  # the first highest from there on
        least = low[own, at]
        fine = (np.minimum(size, n + 1) > 5) & (least > 0)
        gains.append(np.where(fine, (high[own, peak] / np.where(fine, least, 1.0) - 1.0) * 100.0, -np.inf))
        peaks.append(reach - 1 - peak)
    gain, peak = np.array(gains), np.array(peaks)
    best = gain.argmax(axis=0)  # of equal gains that of the first window
    gain = gain[best, own]
    recent = reach - 1 - (high[:, reach - params.base_max :].argmax(axis=1) + reach - params.base_max)
    return pd.DataFrame({"gain": np.where(np.isneginf(gain), np.nan, gain), "peak": peak[best, own], "recent": recent})


def moves(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (with idx, win) with move and recent, as :func:`prior_move` has them for every bar: for few rows, whose bars are at hand.

    In pandas, so that a filter by them isn't pushed below, which would cut and search the arrays twice.
    """

    @F.pandas_udf(MOVE)
    def best(highs: pd.Series, lows: pd.Series) -> pd.DataFrame:
        return best_moves(highs.to_list(), lows.to_list(), params)

    # A null is less than any value; a high that is none doesn't count, and neither does a window whose low isn't known.
    known = lambda x: F.transform("win", lambda b: F.coalesce(b[x].cast("double"), F.lit(float("-inf"))))
    out = rows.withColumn("_best", best(known("high"), known("low")))
    move = F.when(F.col("_best.gain").isNotNull(), F.struct(F.col("_best.gain").alias("gain"), (F.col("idx") - F.col("_best.peak")).alias("peak")))
    return out.withColumn("move", move).withColumn("recent", F.col("idx") - F.col("_best.recent")).drop("_best")


def with_bars(rows: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (with idx, base_start) with win, the bars (idx, high, low, volume, session) of a base at most and of the quiet before it, in order; and base, those of the base."""
    return with_base(last_bars(rows, bars, params.base_max + params.dryup_bars))


def with_base(rows: DataFrame) -> DataFrame:
    return rows.withColumn("base", F.expr("slice(win, greatest(size(win) - (idx - base_start), 1), size(win))"))


def last_bars(rows: DataFrame, bars: DataFrame, reach: int) -> DataFrame:
    """rows (with idx) with win, the last reach bars (idx, high, low, volume, session) up to idx, in order.

    Bars go by blocks of a symbol's history, those of a block and the one before it as one array: of bounded
    size however long the history is, and only of blocks that some row ends in.
    """
    block = lambda idx: F.floor(idx / reach).cast("int")
    key = ["market", "symbol", "_block"]
    rows = stored(rows.withColumn("_block", block(F.col("idx"))), "bases")  # read twice: for their blocks, and to be given their bars
    at = block(F.col("idx"))
    held = bars.withColumn("_block", F.explode(F.array(at, at + 1))).join(rows.select(*key).distinct(), key, "left_semi")
    arrays = held.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "high", "low", "volume", "session"))).alias("_all"))
    # idx has no gaps, so a bar's place in its array is told by the first one's: arrays are cut, not searched.
    start = f"greatest(idx - {reach} + 1 - _all[0].idx, 0)"
    return rows.join(arrays, key).withColumn("win", F.expr(f"slice(_all, {start} + 1, idx - _all[0].idx - {start} + 1)")).drop("_all", "_block")


def _median(values: str) -> str:
    return f"element_at(transform(array(sort_array({values})), v -> (v[(size(v) - 1) div 2] + v[size(v) div 2]) / 2D), 1)"


def churn_dryup(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (with base) with base_low, churn_l (sum of ranges by span by length) and dryup (median volume by that of the bars before)."""
    out = rows.withColumn("base_low", F.expr("array_min(base.low)")).withColumn("_span", F.expr("array_max(base.high)") - F.col("base_low"))
    total = F.expr("aggregate(base, 0D, (a, x) -> a + (x.high - x.low))")
    out = out.withColumn("churn_l", F.when(F.col("_span") > 0, total / F.col("_span") / F.col("base_len")).otherwise(0.0))
    out = out.withColumn("_before", F.expr(f"slice(win.volume, greatest(size(win) - size(base) - {params.dryup_bars}, 0) + 1, least(size(win) - size(base), {params.dryup_bars}))"))
    out = out.withColumn("_quiet", F.expr(f"CASE WHEN size(_before) > 0 THEN {_median('_before')} END"))
    dry = F.when(F.coalesce("_quiet", F.lit(0.0)) <= 0, 1.0).otherwise(F.expr(_median("base.volume")) / F.col("_quiet"))
    return out.withColumn("dryup", dry).drop("_span", "_before", "_quiet")


FIT = "slope double, line_ok boolean, touch_zones int, overshoot_adr double, line_end double"
FIT_COLUMNS = [x.split()[0] for x in FIT.split(", ")]
FIT_CELLS = 1 << 16  #: slopes by bars of a portion of bases: 512 KB an array, which caches hold
FIT_STEP = 14  #: of so many slopes one is tried first


def fit_envelope(high: np.ndarray, adr_abs: float, anchor: int, cluster_k: int, params: Params = Params()) -> tuple[float, bool, int, float, float]:
    """The line through the anchor (a place in the base, or before it if negative) with the slope of least loss, and its verdict.

    Of equal losses (to nine places) the steepest slope stands. The line's height at the anchor is the first
    element of high; the base's highs follow.
    """
    top, base = high[0], high[1:]
    t = np.arange(len(base))
    slopes = -params.max_slope * adr_abs * (1.0 - np.arange(params.slopes) / (params.slopes - 1)) + 0.0
    gap = base - (top + slopes[:, None] * (t - anchor))
    loss = np.round(np.where(gap > 0, params.over_weight * gap, -gap).sum(axis=1), 9)
    slope = float(slopes[loss.argmin()])
    gap = base - (top + slope * (t - anchor))
    near = params.touch * adr_abs
    touches = np.flatnonzero((np.abs(gap) <= near) & (t < len(base) - cluster_k))
    zones = int(1 + (np.diff(touches) >= params.touch_gap).sum()) if len(touches) else 0
    over = float(max(0.0, (gap[gap > near] / adr_abs).max(initial=0.0)))
    back = zones >= 1 and touches[0] <= params.reach * len(base)
    return slope, bool((zones >= params.zones_min or back) and over <= params.max_overshoot), zones, over, float(top + slope * (len(base) - anchor))


def fit_envelopes(highs: list, adr_abs: np.ndarray, anchor: np.ndarray, cluster_k: np.ndarray, params: Params = Params()) -> pd.DataFrame:
    """:func:`fit_envelope` of many bases: those of one length at once, in portions of bounded size, and only slopes near the best."""
    sizes, found = np.fromiter(map(len, highs), int, len(highs)), []
    for size in np.unique(sizes):
        same, n = np.flatnonzero(sizes == size), int(size) - 1
        portion = max(1, FIT_CELLS // (2 * FIT_STEP * max(n, 1)))
        for at in range(0, len(same), portion):
            found.append(_fit_equal(same[at : at + portion], n, highs, adr_abs, anchor, cluster_k, params))
    return pd.concat(found).sort_index() if found else pd.DataFrame(columns=FIT_COLUMNS)


def _fit_equal(own: np.ndarray, n: int, highs: list, adr_abs: np.ndarray, anchor: np.ndarray, cluster_k: np.ndarray, params: Params) -> pd.DataFrame:
    """The fits of bases own (places in highs), all of n bars, by place."""
    high = np.array([highs[i] for i in own], float)
    top, base, adr = high[:, :1], high[:, 1:], adr_abs[own].astype(float)[:, None]
    t, length = np.arange(n), n - anchor[own].astype(int)
    back = t - anchor[own].astype(int)[:, None]
    slopes = -params.max_slope * adr * (1.0 - np.arange(params.slopes) / (params.slopes - 1)) + 0.0

    def least(places: np.ndarray) -> np.ndarray:
        """The first of these places in slopes (a row a base) with the least loss."""
        gap = np.take_along_axis(slopes, places, axis=1)[:, :, None] * back[:, None, :]
        gap += top[:, :, None]
        np.subtract(base[:, None, :], gap, out=gap)
        # The weighted gap is the greater of the two above the line only, as over_weight is positive.
        loss = np.round(np.maximum(params.over_weight * gap, -gap).sum(axis=2), 9)
        return np.take_along_axis(places, loss.argmin(axis=1)[:, None], axis=1)

    # The loss is convex in the slope: the first least one lies between the neighbours of the first least of every FIT_STEP-th.
    near_it = least(np.tile(np.arange(0, params.slopes, FIT_STEP), (len(own), 1))) + np.arange(1 - FIT_STEP, FIT_STEP)
    slope = np.take_along_axis(slopes, least(np.clip(near_it, 0, params.slopes - 1)), axis=1)
    gap = base - (top + slope * back)
    near = params.touch * adr
    touches = (np.abs(gap) <= near) & (t < n - cluster_k[own].astype(int)[:, None])
    last = np.maximum.accumulate(np.where(touches, t, -n - params.touch_gap), axis=1)
    before = np.concatenate([np.full((len(own), 1), -n - params.touch_gap), last[:, :-1]], axis=1)[:, :n]
    zones = (touches & (t - before >= params.touch_gap)).sum(axis=1)
    over = np.where(gap > near, gap / adr, 0.0).max(axis=1, initial=0.0)
    soon = (zones >= 1) & ((touches.argmax(axis=1) if n else 0) <= params.reach * n)
    fine = ((zones >= params.zones_min) | soon) & (over <= params.max_overshoot)
    return pd.DataFrame(dict(zip(FIT_COLUMNS, (slope[:, 0], fine, zones, over, top[:, 0] + slope[:, 0] * length), strict=True)), index=own)


def envelope(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (with base, win, cluster, adr_abs) with fit."""

    @F.pandas_udf(FIT)
    def fit(highs: pd.Series, adr_abs: pd.Series, anchor: pd.Series, k: pd.Series) -> pd.DataFrame:
        return fit_envelopes(highs.to_list(), adr_abs.to_numpy(), anchor.to_numpy(), k.to_numpy(), params)

    first = F.expr("-array_max(transform(slice(win, greatest(size(win) - cluster.k, 0) + 1, cluster.k), x -> struct(x.high AS high, -x.idx AS back))).back")
    highs = F.expr("concat(array(cluster.high), base.high)")
    out = rows.withColumn("anchor", first)
    return out.withColumn("fit", fit(highs, F.col("adr_abs"), F.col("anchor") - F.col("base_start"), F.col("cluster.k")))


def bar_gates(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """All bars with the window columns, whether they pass the cheap gates, idx, move and recent."""
    return cheap_gates(prior_move(ind.numbered(bars), params), params)  # below the other windows, so that no filter is pushed into its expressions


def cheap_gates(bars: DataFrame, params: Params = Params()) -> DataFrame:
    """All bars with the window columns, idx, and whether they pass the cheap gates."""
    out = catch_up(clusters(ind.rolling(bars, params), params), params)
    fine = (F.col("idx") >= params.history) & (F.col("adr") > 0) & F.col("caught_up") & F.col("cluster").isNotNull()
    return out.withColumn("passes", F.coalesce(fine, F.lit(False)))


def passing(gates: DataFrame, gated: DataFrame) -> DataFrame:
    """gated (market, symbol, session) whose last bar on or before it passes the cheap gates, with what of cheap_gates the base is read from.

    A bar holds until the next one. Only those that pass are sorted with sessions, and one whose next is not after the
    session is none's last: the others, most bars, aren't exchanged again.
    """
    held = gates.withColumn("until", F.lead("session").over(ind.by_symbol())).filter("passes AND (until IS NULL OR until > session)")
    keep = ["idx", "adr", "adr_abs", "close", "cluster", "sma20_rising", "until"]
    at = ind.as_of(held, gated.select("market", "symbol", F.col("session").alias("day"), *carried(gated)), keep).withColumnRenamed("day", "session")
    return at.filter("idx IS NOT NULL AND (until IS NULL OR session < until)").drop("until")


def geometry(rows: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """rows (of cheap_gates) that passed the cheap gates, with the base and everything that is read from it. Run-ups are those of these rows, a few of the bars."""
    out = moves(last_bars(rows, bars, max(params.base_max + params.dryup_bars, *[n + 1 for n in params.move_windows])), params)
    out = base_span(out.filter("move IS NOT NULL"), params).filter(F.col("base_len") >= params.base_min)
    return envelope(churn_dryup(with_base(out), params), params)


def stop_width(stop: Column, trigger: Column, adr: Column) -> Column:
    return F.try_divide(F.try_divide(stop, F.when(trigger > 0, trigger)), F.when(adr > 0, adr))


def detections(universe: DataFrame, ranks: DataFrame, bars: DataFrame, params: Params = Params()) -> DataFrame:
    """The detection of every gated member on every session of universe, as of its last bar on or before it; copies of members stay."""
    gated = universe.join(detection_gate(ranks, params), ["market", "session", "symbol"], "left_semi")
    at = passing(cheap_gates(bars, params), gated)
    rows = geometry(at, ind.numbered(bars).select("market", "symbol", "idx", "high", "low", "volume", "session"), params)
    c, f = F.col("cluster"), F.col("fit")
    stop = c["high"] - c["low"]
    out = rows.select(
        *SEEN, F.lit(params.detector_version).alias("detector_version"), c["high"].alias("trigger"), stop.alias("stop"), stop_width(stop, c["high"], F.col("adr")).alias("stopw_adr"),
        "base_len", F.col("move.gain").alias("move_gain"), "adr", "close", c["k"].alias("cluster_k"), c["high"].alias("cluster_high"), c["low"].alias("cluster_low"), c["range_adr"].alias("cluster_range_adr"),
        f["line_ok"].alias("line_ok"), f["touch_zones"].alias("touch_zones"), f["overshoot_adr"].alias("overshoot_adr"), f["slope"].alias("slope"), f["line_end"].alias("line_end"),
        "base_low", "churn_l", "sma20_rising", "dryup", *carried(rows),
    )
    return out.select(*schemas.schema("detections").names, *carried(out))


def dist_adr() -> Column:
    """Distance from close to trigger in ADRs; null where that isn't defined."""
    unit = F.col("adr") * F.col("close")
    return F.try_divide(F.col("trigger") - F.col("close"), F.when(unit > 0, unit))
