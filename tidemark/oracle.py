"""The SQL that each query equals, for DuckDB over the same tables.

One chain of common table expressions derives every relation from the order tables; a query's SQL is the
chain and a last SELECT. Expressions that aren't read cost nothing.
"""

from __future__ import annotations

from tidemark.params import ACCEPTANCE, DERIVED, DIMENSIONS, LOOKBACKS

P = DERIVED
KEY = "market, session, symbol"
W = "PARTITION BY market, symbol ORDER BY session"
WEEK = "(datediff('day', DATE '1995-01-02', session) // 7)"
MARKET = "CASE WHEN k % 2 = 0 THEN 'US' ELSE 'IDX' END"
SYMBOL = "'S' || lpad(CAST(k AS VARCHAR), 5, '0')"


def anchor(x: str) -> str:
    unit, n = LOOKBACKS[x]
    return f"CAST(session - INTERVAL {n} {unit[:-1]} AS DATE)"


def full(value: str, n: int, w: str = W) -> str:
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN avg({value}) OVER {frame} END"


def _cluster() -> str:
    cases = []
    for k in P.cluster_ks:
        f = f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        spread = f"(max(high) OVER {f} - min(low) OVER {f}) / nullif(adr_abs, 0)"
        cases.append(f"WHEN adr_abs > 0 AND count(*) OVER {f} = {k} AND {spread} <= {P.tight} THEN {{'k': {k}, 'high': max(high) OVER {f}, 'low': min(low) OVER {f}, 'range_adr': {spread}}}")
    return "CASE " + " ".join(cases) + " END"


def _moves() -> str:
    return " UNION ALL ".join(
        f"""SELECT o.market, o.symbol, o.idx, {place} AS place, o.low AS low, o.start, max({{'high': b.high, 'back': -b.idx}}) AS peak
        FROM (SELECT d.market, d.symbol, d.idx, min({{'low': b.low, 'idx': b.idx}}).idx AS start, min({{'low': b.low, 'idx': b.idx}}).low AS low, count(*) AS n
              FROM passing d JOIN roll b ON b.market = d.market AND b.symbol = d.symbol AND b.idx BETWEEN d.idx - {w} AND d.idx GROUP BY ALL) o
        JOIN roll b ON b.market = o.market AND b.symbol = o.symbol AND b.idx BETWEEN o.start AND o.idx WHERE o.n > 5 AND o.low > 0 GROUP BY ALL"""
        for place, w in enumerate(P.move_windows)
    )


def _points() -> tuple[str, str]:
    hits = {
        "Tightness": f"cluster_k >= {P.tight_k}", "Orderliness": f"churn_l BETWEEN {P.churn_low} AND {P.churn_high}", "Prior move": "prior_move", "Base length": f"base_len <= {P.short_base}",
        "MA support": "sma20_rising", "Volume": f"dryup <= {P.dry}", "Sector": f"sector_share >= {P.share_min}", "ADR": f"adr >= {P.adr_min}",
    }
    points = " + ".join(f"CASE WHEN {hits[k]} THEN {w} ELSE 0 END" for k, w in DIMENSIONS)
    return f"({points}) / 2.0", "concat_ws(',', " + ", ".join(f"CASE WHEN {hits[k]} THEN '{k}+{w}' ELSE '{k}' END" for k, w in DIMENSIONS) + ")"


SCORE, HITS = _points()


def _fold(axis: str, name: str) -> str:
    ks = ", ".join(f"count(DISTINCT CASE WHEN lookback = '{x}' AND percentile >= {P.top_decile} THEN symbol END) AS k_{x}" for x in LOOKBACKS)
    return f"{name} AS (SELECT market, session, {axis} AS label, count(DISTINCT symbol) AS members, {ks} FROM ranks JOIN labels USING (market, symbol) WHERE {axis} <> '' GROUP BY market, session, {axis})"


BASE = f"""
WITH RECURSIVE lines AS (
  SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS session, CAST(round(l_discount * 100) AS INT) - 5 AS d,
         CAST(round(l_tax * 100) AS INT) AS t, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem),
weeks AS (SELECT k, session, sum(d) AS d, max(t) AS t, sum(q) AS vol, (k * 7 + {WEEK}) % 23 AS ph FROM lines GROUP BY k, session),
walk AS (SELECT *, sum(d) OVER (PARTITION BY k ORDER BY session) AS c, sum(d) OVER (PARTITION BY k ORDER BY session) - d AS p FROM weeks),
raw AS (
  SELECT {MARKET} AS market, {SYMBOL} AS symbol, session, round(100.0::DOUBLE * exp(p / 100.0::DOUBLE), 4) AS open,
         round(100.0::DOUBLE * exp(greatest(p, c) / 100.0::DOUBLE) * (1 + t / 200.0::DOUBLE), 4) AS high,
         round(100.0::DOUBLE * exp(least(p, c) / 100.0::DOUBLE) / (1 + t / 200.0::DOUBLE), 4) AS low,
         round(100.0::DOUBLE * exp(c / 100.0::DOUBLE), 4) AS close,
         CASE WHEN k % 7 = 0 AND session < DATE '1998-01-05' THEN round(100.0::DOUBLE * exp(c / 100.0::DOUBLE) * 0.5::DOUBLE, 4)
              ELSE round(100.0::DOUBLE * exp(c / 100.0::DOUBLE), 4) END AS adj_close,
         CAST(CASE WHEN ph = 0 THEN 0 ELSE vol END AS BIGINT) AS volume
  FROM walk),
idx AS (SELECT market, session, ((2 * sum(CAST(round(close * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS c FROM raw WHERE volume > 0 GROUP BY market, session),
bars AS (
  SELECT * FROM raw WHERE volume > 0
  UNION ALL SELECT market, CASE market WHEN 'US' THEN '^IXIC' ELSE '^JKSE' END, session, c, c, c, c, c, 1 FROM idx),
cal AS (SELECT market, session, row_number() OVER (PARTITION BY market ORDER BY session) AS n FROM (SELECT DISTINCT market, session FROM bars)),
instr AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'US' ELSE 'IDX' END AS market, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS symbol,
         CASE s_suppkey % 11 WHEN 5 THEN 'Acme Warrant' WHEN 6 THEN 'Beta American Depositary Shares' ELSE 'Corp - Common Stock' END AS name
  FROM supplier),
outcomes AS (
  SELECT market, symbol, session, CASE WHEN k % 50 = 49 THEN 'refused' WHEN (k * 31 + {WEEK}) % 17 = 0 THEN 'unresolved' ELSE 'resolved' END AS status
  FROM instr JOIN cal USING (market)),
labels AS (
  SELECT market, symbol, r_name AS sector, n_name AS industry, CAST(last - CAST(k % 30 AS INT) AS DATE) AS as_of
  FROM instr JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  JOIN (SELECT market, max(session) AS last FROM cal GROUP BY market) USING (market) WHERE k % 20 <> 3),
runs AS (
  SELECT market, session, CASE WHEN {WEEK} % 13 = 0 THEN 'quarantined' ELSE 'published' END AS status,
         CAST(count(*) FILTER (WHERE status <> 'refused') AS INT) AS symbols_enumerated, CAST(count(*) FILTER (WHERE status = 'resolved') AS INT) AS symbols_resolved
  FROM outcomes GROUP BY market, session),
roll0 AS (
  SELECT *, row_number() OVER ({W}) - 1 AS idx, {full("(high / nullif(low, 0) - 1)", P.window)} AS adr, {full("close", 10)} AS sma10, {full("close", 20)} AS sma20, {full("close", 50)} AS sma50,
         {full("adj_close", 10)} AS adj_sma10, {full("adj_close", 20)} AS adj_sma20,
         quantile_cont(close * volume, 0.5) OVER ({W} ROWS BETWEEN {P.window - 1} PRECEDING AND CURRENT ROW) AS dv
  FROM bars),
roll1 AS (
  SELECT *, adr * close AS adr_abs, {", ".join(f"coalesce(round({x}, 10) > lag(round({x}, 10), {P.rising_lag}) OVER ({W}), false) AS {x}_rising" for x in ("sma20", "adj_sma10", "adj_sma20"))} FROM roll0),
roll AS (
  SELECT *, {_cluster()} AS cluster, coalesce(close - sma10 <= {P.catch_up_10} * adr_abs AND close - sma20 <= {P.catch_up_20} * adr_abs, false) AS caught_up FROM roll1),
passing AS (SELECT * FROM roll WHERE idx >= {P.history} AND adr > 0 AND caught_up AND cluster IS NOT NULL),
grid AS (
  SELECT i.market, i.symbol, name, c.session, CASE WHEN r.symbol IS NULL THEN 0 ELSE 1 END AS traded, r.dv, r.idx + 1 AS bar_no, status
  FROM instr i JOIN cal c USING (market) LEFT JOIN roll r USING (market, symbol, session) LEFT JOIN outcomes USING (market, symbol, session)),
state AS (
  SELECT *, sum(traded) OVER ({W} ROWS BETWEEN {P.window - 1} PRECEDING AND CURRENT ROW) >= {P.density_min}
            AND max(traded) OVER ({W} ROWS BETWEEN {P.density_recent - 1} PRECEDING AND CURRENT ROW) = 1 AS dense,
         coalesce(last_value(bar_no IGNORE NULLS) OVER ({W}), 0) AS age, coalesce(last_value(dv IGNORE NULLS) OVER ({W}), 0) AS liquidity
  FROM grid),
signals AS (
  SELECT *, CASE WHEN status <> 'resolved' THEN NULL WHEN regexp_matches(name, '(?i)\\bwarrants?\\b') OR age < {P.min_bars} OR NOT dense THEN 0
                 WHEN liquidity >= 4000 THEN 1 WHEN liquidity < {P.exit_share} * 4000 THEN 0 END AS signal FROM state),
universe AS (
  SELECT market, session, symbol FROM (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER ({W}), 0) AS member FROM signals) WHERE member = 1),
keys_bar AS (SELECT market, symbol, session FROM bars),
returns_bar AS (SELECT * FROM (SELECT 1) LIMIT 0),
ends AS (
  SELECT u.market, u.session, u.symbol, b.adj_close AS end_close FROM universe u ASOF JOIN bars b ON u.market = b.market AND u.symbol = b.symbol AND u.session >= b.session),
anchored AS (SELECT *, unnest([{", ".join(f"{{'lookback': '{x}', 'anchor': {anchor(x)}}}" for x in LOOKBACKS)}], recursive := true) FROM ends),
returns AS (
  SELECT a.market, a.session, a.symbol, a.lookback, a.end_close / b.adj_close - 1 AS raw_return
  FROM anchored a ASOF JOIN bars b ON a.market = b.market AND a.symbol = b.symbol AND a.anchor >= b.session WHERE b.adj_close <> 0),
ranks AS (SELECT *, cume_dist() OVER (PARTITION BY market, session, lookback ORDER BY raw_return) AS percentile FROM returns),
gate AS (SELECT DISTINCT {KEY} FROM ranks WHERE percentile >= {P.top_decile} AND lookback IN {P.gate_lookbacks}),
breadth AS (SELECT {KEY}, CAST(count(*) FILTER (WHERE percentile >= {P.top_decile}) AS INT) AS breadth FROM ranks GROUP BY {KEY}),
boards AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY market, session, lookback ORDER BY raw_return DESC, symbol) AS INT) AS rank FROM ranks) WHERE rank <= {P.board_size}),
rank_days AS (
  SELECT market, session, lag(session) OVER (PARTITION BY market ORDER BY session) AS before, lag(session, {P.delta_sessions}) OVER (PARTITION BY market ORDER BY session) AS before20
  FROM (SELECT DISTINCT market, session FROM ranks)),
boards_all AS (
  SELECT b.market, b.session, b.lookback, b.rank, b.symbol, b.raw_return, coalesce(breadth, 0) AS breadth, e.symbol IS NULL AS is_new,
         b.lookback = '{P.short_lookback}' AND b.raw_return >= {P.surge} AS surge, r.adr
  FROM boards b JOIN rank_days d USING (market, session) LEFT JOIN boards e ON e.market = b.market AND e.session = d.before AND e.lookback = b.lookback AND e.symbol = b.symbol
  LEFT JOIN breadth br ON br.market = b.market AND br.session = b.session AND br.symbol = b.symbol LEFT JOIN roll r ON r.market = b.market AND r.session = b.session AND r.symbol = b.symbol),
{_fold("sector", "sector_fold")},
{_fold("industry", "industry_fold")},
loo0 AS (
  SELECT market, session, symbol, sector, max(CASE WHEN lookback = '{P.delta_lookback}' AND percentile >= {P.top_decile} THEN 1 ELSE 0 END) AS hit
  FROM ranks JOIN labels USING (market, symbol) WHERE sector <> '' GROUP BY ALL),
loo AS (
  SELECT {KEY}, coalesce((sum(hit) OVER s - hit) / nullif(count(*) OVER s - 1, 0), 0) AS share FROM loo0 WINDOW s AS (PARTITION BY market, session, sector)),
moves AS ({_moves()}),
best AS (
  SELECT market, symbol, idx, max({{'gain': (peak.high / low - 1) * 100, 'place': -place, 'peak': -peak.back}}) AS move FROM moves GROUP BY market, symbol, idx),
recent AS (
  SELECT d.market, d.symbol, d.idx, -max({{'high': b.high, 'back': -b.idx}}).back AS peak
  FROM passing d JOIN roll b ON b.market = d.market AND b.symbol = d.symbol AND b.idx BETWEEN d.idx - {P.base_max - 1} AND d.idx GROUP BY ALL),
bases0 AS (
  SELECT d.*, m.move, CASE WHEN d.idx - m.move.peak + 1 > {P.base_max} THEN r.peak ELSE m.move.peak END AS base_start
  FROM passing d JOIN best m USING (market, symbol, idx) JOIN recent r USING (market, symbol, idx)),
bases AS (SELECT *, CAST(idx - base_start + 1 AS INT) AS base_len FROM bases0 WHERE idx - base_start + 1 >= {P.base_min}),
in_base AS (
  SELECT d.market, d.symbol, d.session, d.idx, d.base_start, d.base_len, d.adr_abs, d.cluster, b.idx AS t, b.high, b.low, b.volume
  FROM bases d JOIN roll b ON b.market = d.market AND b.symbol = d.symbol AND b.idx BETWEEN d.base_start AND d.idx),
before_base AS (
  SELECT d.market, d.symbol, d.idx, quantile_cont(CAST(b.volume AS DOUBLE), 0.5) AS quiet
  FROM bases d JOIN roll b ON b.market = d.market AND b.symbol = d.symbol AND b.idx BETWEEN d.base_start - {P.dryup_bars} AND d.base_start - 1 GROUP BY ALL),
shape AS (
  SELECT i.market, i.symbol, i.session, i.idx, min(low) AS base_low, CASE WHEN max(high) - min(low) > 0 THEN sum(high - low) / (max(high) - min(low)) / any_value(base_len) ELSE 0.0 END AS churn_l,
         CASE WHEN coalesce(any_value(quiet), 0) <= 0 THEN 1.0 ELSE quantile_cont(CAST(volume AS DOUBLE), 0.5) / any_value(quiet) END AS dryup
  FROM in_base i LEFT JOIN before_base q USING (market, symbol, idx) GROUP BY ALL),
anchors AS (
  SELECT d.market, d.symbol, d.idx, -max({{'high': b.high, 'back': -b.idx}}).back AS anchor
  FROM bases d JOIN roll b ON b.market = d.market AND b.symbol = d.symbol AND b.idx BETWEEN d.idx - d.cluster.k + 1 AND d.idx GROUP BY ALL),
lined AS (SELECT i.*, a.anchor FROM in_base i JOIN anchors a USING (market, symbol, idx)),
losses AS (
  SELECT market, symbol, idx, s, -{P.max_slope} * adr_abs * (1.0::DOUBLE - s / {P.slopes - 1}.0::DOUBLE) + 0.0 AS slope,
         round(sum(CASE WHEN gap > 0 THEN {P.over_weight} * gap ELSE -gap END), 9) AS loss
  FROM (SELECT market, symbol, idx, s, adr_abs, high - (cluster.high - {P.max_slope} * adr_abs * (1.0::DOUBLE - s / {P.slopes - 1}.0::DOUBLE) * (t - anchor)) AS gap FROM lined, range({P.slopes}) g(s)) GROUP BY market, symbol, idx, s, adr_abs),
slopes AS (SELECT market, symbol, idx, slope FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, idx ORDER BY loss, s) AS n FROM losses) WHERE n = 1),
gaps AS (SELECT l.*, slope, high - (cluster.high + slope * (t - anchor)) AS gap FROM lined l JOIN slopes USING (market, symbol, idx)),
touches AS (
  SELECT market, symbol, idx, min(t) AS first_touch, count(*) FILTER (WHERE before IS NULL OR t - before >= {P.touch_gap}) AS zones
  FROM (SELECT *, lag(t) OVER (PARTITION BY market, symbol, idx ORDER BY t) AS before FROM gaps WHERE abs(gap) <= {P.touch} * adr_abs AND t < idx - cluster.k + 1) GROUP BY ALL),
fits0 AS (
  SELECT market, symbol, session, idx, any_value(slope) AS slope, any_value(base_start) AS base_start, any_value(base_len) AS base_len,
         coalesce(max(CASE WHEN gap > {P.touch} * adr_abs THEN gap / adr_abs END), 0.0) AS overshoot_adr, any_value(cluster.high + slope * (idx + 1 - anchor)) AS line_end
  FROM gaps GROUP BY market, symbol, session, idx),
fits AS (
  SELECT f.*, CAST(coalesce(zones, 0) AS INT) AS touch_zones,
         (coalesce(zones, 0) >= {P.zones_min} OR (coalesce(zones, 0) >= 1 AND first_touch <= base_start + {P.reach}::DOUBLE * base_len)) AND overshoot_adr <= {P.max_overshoot} AS line_ok
  FROM fits0 f LEFT JOIN touches USING (market, symbol, idx)),
gated AS (
  SELECT u.market, u.symbol, u.session, b.idx FROM (SELECT * FROM universe SEMI JOIN gate USING (market, session, symbol)) u
  ASOF JOIN roll b ON u.market = b.market AND u.symbol = b.symbol AND u.session >= b.session),
dets AS (
  SELECT g.market, g.symbol, g.session, {P.detector_version} AS detector_version, d.cluster.high AS trigger, d.cluster.high - d.cluster.low AS stop,
         (d.cluster.high - d.cluster.low) / d.cluster.high / d.adr AS stopw_adr, d.base_len, d.move.gain AS move_gain, d.adr, d.close, d.cluster.k AS cluster_k, d.cluster.high AS cluster_high,
         d.cluster.low AS cluster_low, d.cluster.range_adr AS cluster_range_adr, f.line_ok, f.touch_zones, f.overshoot_adr, f.slope, f.line_end, s.base_low, s.churn_l, d.sma20_rising, s.dryup
  FROM gated g JOIN bases d USING (market, symbol, idx) JOIN fits f USING (market, symbol, idx) JOIN shape s USING (market, symbol, idx)),
scored0 AS (
  SELECT d.*, coalesce(share, 0.0) AS sector_share, g.symbol IS NOT NULL AS prior_move, coalesce(breadth, 0) AS breadth, industry, sector
  FROM dets d LEFT JOIN loo USING (market, session, symbol) LEFT JOIN gate g USING (market, session, symbol) LEFT JOIN breadth USING (market, session, symbol) LEFT JOIN labels USING (market, symbol)),
scored AS (SELECT *, {SCORE} AS score, {HITS} AS breakdown FROM scored0),
det_days AS (SELECT DISTINCT market, session AS before FROM dets),
live AS (SELECT c.market, c.session, max(before) AS before FROM cal c JOIN det_days d ON d.market = c.market AND d.before < c.session GROUP BY ALL),
broke AS (
  SELECT b.market, b.session, s.symbol, s.score, s.industry, s.line_ok, (s.trigger - b.low) / s.trigger / s.adr AS stopw_adr, b.close, s.trigger, (b.close - s.trigger) / s.trigger * 100 AS pct_through
  FROM scored s JOIN live l ON l.market = s.market AND l.before = s.session JOIN bars b ON b.market = s.market AND b.symbol = s.symbol AND b.session = l.session WHERE b.close > s.trigger),
digests AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY market, session ORDER BY score DESC, line_ok DESC, symbol) AS INT) AS position,
         lag(session) OVER (PARTITION BY market, symbol ORDER BY session) AS last_reported FROM broke),
averages AS (
  SELECT *, lag(adj_sma10, {P.rising_lag}) OVER ({W}) AS fast_before, lag(adj_sma20, {P.rising_lag}) OVER ({W}) AS slow_before
  FROM (SELECT * REPLACE (round(adj_sma10, 10) AS adj_sma10, round(adj_sma20, 10) AS adj_sma20) FROM roll) roll),
states AS (
  SELECT market, symbol, session, adj_close,
         CASE WHEN idx + 1 < {P.warm_up} THEN NULL WHEN adj_sma10 < fast_before AND adj_sma20 < slow_before AND adj_sma10 < adj_sma20 THEN 'HOSTILE'
              WHEN adj_close > adj_sma10 AND adj_close > adj_sma20 AND adj_sma10 > fast_before AND adj_sma20 > slow_before THEN 'FRIENDLY' ELSE 'CHOPPY' END AS state,
         CASE WHEN idx + 1 >= {P.warm_up} AND adj_close > adj_sma10 AND adj_close > adj_sma20 AND adj_sma10 > fast_before AND adj_sma20 > slow_before THEN 1.0 ELSE 0.0 END AS up
  FROM averages),
market_breadth AS (
  SELECT u.market, u.session, avg(coalesce(up, 0.0)) AS breadth
  FROM universe u ASOF LEFT JOIN states s ON u.market = s.market AND u.symbol = s.symbol AND u.session >= s.session GROUP BY ALL),
ema_rec AS (
  SELECT market, symbol, idx, (SELECT avg(x.close) FROM roll0 x WHERE x.market = r.market AND x.symbol = r.symbol AND x.idx < {P.ema}) AS ema FROM roll0 r WHERE idx = {P.ema - 1}
  UNION ALL
  SELECT e.market, e.symbol, e.idx + 1, e.ema + 2.0::DOUBLE / {P.ema + 1} * (r.close - e.ema) FROM ema_rec e JOIN roll0 r ON r.market = e.market AND r.symbol = e.symbol AND r.idx = e.idx + 1),
emas AS (SELECT market, symbol, session, ema FROM roll0 LEFT JOIN ema_rec USING (market, symbol, idx)),
charted AS (SELECT market, symbol, as_of FROM instr JOIN (SELECT market, max(session) AS as_of FROM dets GROUP BY market) USING (market)),
chart0 AS (
  SELECT r.*, c.as_of, e.ema AS ema65, row_number() OVER (PARTITION BY r.market, r.symbol ORDER BY r.session DESC) - 1 AS back
  FROM charted c JOIN roll r ON r.market = c.market AND r.symbol = c.symbol AND r.session <= c.as_of JOIN emas e ON e.market = r.market AND e.symbol = r.symbol AND e.session = r.session),
chart1 AS (
  SELECT c.*, d.slope, d.cluster_high, coalesce(back < d.base_len, false) AS in_base, coalesce(back < d.cluster_k, false) AS in_cluster
  FROM chart0 c LEFT JOIN dets d ON d.market = c.market AND d.symbol = c.symbol AND d.session = c.as_of WHERE back < {P.chart_bars}),
chart AS (
  SELECT *, CASE WHEN in_base THEN cluster_high + slope * (max(CASE WHEN in_cluster THEN {{'high': high, 'back': back}} END) OVER (PARTITION BY market, symbol).back - back) END AS envelope FROM chart1)
"""
BASE = BASE.replace("keys_bar AS (SELECT market, symbol, session FROM bars),\nreturns_bar AS (SELECT * FROM (SELECT 1) LIMIT 0),\n", "")


def rd(*names: str) -> str:
    return ", ".join(f"round({x}, 8) AS {x}" for x in names)


SHARES = ", ".join(f"round(coalesce(k_{x} / nullif(members, 0), 0.0), 8) AS share_{x}, CAST(coalesce(k_{x}, 0) AS BIGINT) AS k_{x}" for x in LOOKBACKS)
SHAPE = f"coalesce(k_{P.short_lookback} / nullif(members, 0), 0.0) - coalesce(k_{P.long_lookback} / nullif(members, 0), 0.0)"
AXIS = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(P.sectors)) + ") axis(axis, label)"
SECTOR = f"""
SELECT market, session, label AS sector, CAST(members AS BIGINT) AS members, {SHARES}, round(shape, 8) AS shape_differential, round(delta, 8) AS temporal_delta, coalesce(eligible, false) AS rotation_eligible,
       coalesce(k_{P.delta_lookback}, 0) < {P.rotation_min} AS delta_low_confidence, CAST(row_number() OVER (PARTITION BY market, session ORDER BY eligible DESC, shape DESC, axis) AS INT) AS position,
       CAST(row_number() OVER (PARTITION BY market, session ORDER BY eligible DESC, delta DESC NULLS LAST, axis) AS INT) AS delta_position,
       CAST(CASE WHEN bool_and(eligible) OVER (PARTITION BY market, session) THEN -1 ELSE count(*) FILTER (WHERE eligible) OVER (PARTITION BY market, session) END AS INT) AS first_ineligible
FROM (SELECT d.market, d.session, axis, label, coalesce(s.members, 0) AS members, {", ".join(f"coalesce(s.k_{x}, 0) AS k_{x}" for x in LOOKBACKS)}, coalesce(s.k_{P.short_lookback}, 0) >= {P.rotation_min} AS eligible,
             {SHAPE.replace("k_", "s.k_").replace("members", "s.members")} AS shape,
             CASE WHEN before20 IS NOT NULL THEN coalesce(s.k_{P.delta_lookback} / nullif(s.members, 0), 0.0) - coalesce(o.k_{P.delta_lookback} / nullif(o.members, 0), 0.0) END AS delta
      FROM rank_days d CROSS JOIN {AXIS} LEFT JOIN sector_fold s USING (market, session, label) LEFT JOIN sector_fold o ON o.market = d.market AND o.session = d.before20 AND o.label = axis.label)"""
FIGURES = f"""
figures AS (
  SELECT u.market, u.session, u.n, u.n_labelled, coalesce(g.n, 0) AS n_gate, coalesce(b.n, 0) AS n_boards, coalesce(k.n, 0) AS n_breaks, coalesce(d.n, 0) AS n_det, d.*  EXCLUDE (market, session, n)
  FROM (SELECT market, session, count(*) AS n, count(l.symbol) AS n_labelled FROM universe u LEFT JOIN labels l USING (market, symbol) GROUP BY ALL) u
  LEFT JOIN (SELECT market, session, count(DISTINCT symbol) AS n FROM ranks WHERE percentile >= {P.top_decile} GROUP BY ALL) g USING (market, session)
  LEFT JOIN (SELECT market, session, count(DISTINCT symbol) AS n FROM boards GROUP BY ALL) b USING (market, session)
  LEFT JOIN (SELECT market, session, count(DISTINCT symbol) AS n FROM digests GROUP BY ALL) k USING (market, session)
  LEFT JOIN (SELECT market, session, count(*) AS n, avg((stopw_adr > {P.affordable})::INT) AS b6, avg((line_end > cluster_high)::INT) AS b7, avg((cluster_k = 3)::INT) AS b8,
                    avg((score >= {P.four_star})::INT) AS b9, median(stopw_adr) AS ms, median(cluster_k) AS mk FROM scored GROUP BY ALL) d USING (market, session)),
long AS (
  {" UNION ALL ".join(
      f"SELECT market, session, '{key}' AS key, '{label}' AS label, '{unit}' AS unit, CAST({m} AS DOUBLE) AS measured, CAST(CASE market "
      + " ".join(f"WHEN '{k}' THEN {v}" for k, v in e.items())
      + f" END AS DOUBLE) AS expected, {d} AS detail FROM figures"
      for (key, label, unit, e), (m, d) in zip(ACCEPTANCE, [
          ("n", "''"), ("n_gate / n", "''"), ("n_boards", "''"), ("n_det", "''"), ("n_breaks", "''"),
          ("coalesce(b6, 0)", "CASE WHEN ms IS NULL THEN 'no detections' ELSE printf('median %.2f×', ms) END"), ("coalesce(b7, 0)", "''"),
          ("coalesce(b8, 0)", "CASE WHEN mk IS NULL THEN 'no detections' ELSE 'median k=' || regexp_replace(printf('%.1f', mk), '\\.0$', '') END"), ("coalesce(b9, 0)", "''"), ("n_labelled / n", "''")], strict=True))})
"""
ROUNDED = ("stop", "stopw_adr", "move_gain", "adr", "cluster_range_adr", "overshoot_adr", "slope", "line_end", "churn_l", "dryup")
CACHED = "(SELECT * FROM labels WHERE CAST(substr(symbol, 2) AS INT) % 4 <> 1)"
LAST = "(SELECT u.* FROM universe u JOIN (SELECT market, max(session) AS session FROM universe GROUP BY market) USING (market, session))"
FETCH = f"""asked AS (
  SELECT market, symbol, true AS is_new FROM {LAST} ANTI JOIN {CACHED} c USING (market, symbol)
  UNION ALL SELECT market, symbol, false FROM (
    SELECT market, symbol, row_number() OVER (PARTITION BY market ORDER BY as_of, symbol) AS n, ceil(count(*) OVER (PARTITION BY market) / {P.label_slice}.0) AS size
    FROM {CACHED} SEMI JOIN {LAST} m USING (market, symbol)) WHERE n <= size)"""
FRIDAY = "CAST(session + CASE WHEN market = 'US' AND d = 4 THEN 3 ELSE 4 END AS DATE)"
LOOK = f"[{', '.join(repr(x) for x in LOOKBACKS)}]"

ABSENT = f""", had AS (
  SELECT market, session, status FROM runs WHERE session < DATE '2001-06-01' UNION ALL SELECT market, session, 'quarantined' FROM runs WHERE session >= DATE '2001-06-01' AND {WEEK} % 7 = 0),
target AS (SELECT market, CAST(max(session) + 1 AS DATE) AS session FROM cal GROUP BY market),
latest AS (SELECT market, max(session) AS latest FROM had WHERE status = 'published' GROUP BY market),
absent AS (SELECT market, session FROM (SELECT c.market, c.session FROM cal c JOIN latest USING (market) WHERE c.session > latest UNION SELECT * FROM target) ANTI JOIN had USING (market, session))"""

_SELECTS = {
    "boards": f""", k AS (SELECT market, symbol, session, adj_close AS end_close FROM bars WHERE symbol NOT LIKE '^%'),
a AS (SELECT *, unnest([{", ".join(f"{{'lookback': '{x}', 'anchor': {anchor(x)}}}" for x in LOOKBACKS)}], recursive := true) FROM k),
rt AS (SELECT a.market, a.session, a.symbol, a.lookback, a.end_close / b.adj_close - 1 AS raw_return FROM a ASOF JOIN bars b ON a.market = b.market AND a.symbol = b.symbol AND a.anchor >= b.session),
rk AS (SELECT *, cume_dist() OVER (PARTITION BY market, session, lookback ORDER BY raw_return) AS percentile,
              CAST(row_number() OVER (PARTITION BY market, session, lookback ORDER BY raw_return DESC, symbol) AS INT) AS rank FROM rt)
SELECT {KEY}, lookback, {rd("percentile", "raw_return")}, rank FROM rk WHERE rank <= {P.board_size}""",
    "listing_source": """, s AS (SELECT s_suppkey AS k, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS symbol, s_name AS name FROM supplier)
SELECT 'US' AS market, '^IXIC' AS symbol, 'reference' AS role, '' AS name UNION ALL SELECT 'IDX', '^JKSE', 'reference', ''
UNION ALL SELECT 'US', symbol, CASE WHEN k % 13 = 0 THEN 'reference' ELSE 'candidate' END, trim(name) FROM s WHERE k % 3 < 2 AND k % 10 <> 1
UNION ALL SELECT 'IDX', symbol, 'candidate', '' FROM s WHERE k % 3 = 2""",
    "clean_bars": "SELECT *, round(close * volume, 8) AS dollar_volume FROM raw WHERE volume > 0 AND (session < DATE '2001-10-22' OR (session = DATE '2001-10-22' AND market = 'IDX'))",
    "keep_first_append": f"""SELECT * EXCLUDE (delivery, n) FROM (
  SELECT *, row_number() OVER (PARTITION BY market, symbol, session ORDER BY delivery) AS n FROM (
    SELECT *, 1 AS delivery FROM bars UNION ALL SELECT * REPLACE (close + 1 AS close), 2 FROM bars WHERE {WEEK} % 2 = 1))
WHERE n = 1 AND {WEEK} % 5 <> 0""",
    "calendar": "SELECT market, session, CAST(n AS INT) AS n FROM cal",
    "last_sessions": "SELECT market, symbol, max(session) AS last_session FROM bars GROUP BY market, symbol",
    "last_final_session": f"SELECT market, session, CAST(session + CAST(d AS INT) AS TIMESTAMP) + INTERVAL 12 HOUR AS now, {FRIDAY} AS last_final, CAST(session + 4 AS DATE) < {FRIDAY} AS run_due FROM cal, (VALUES (4), (6)) v(d)",
    "adr_sma": f"SELECT market, symbol, session, CAST(idx AS INT) AS idx, {rd('adr', 'adr_abs', 'sma10', 'sma20', 'sma50', 'adj_sma10', 'adj_sma20')}, sma20_rising, adj_sma10_rising, adj_sma20_rising FROM roll",
    "ema65": "SELECT market, symbol, session, round(ema, 8) AS ema FROM emas",
    "median_dollar_volume": "SELECT market, symbol, session, round(dv, 8) AS dollar_volume FROM roll0",
    "calendar_returns": f""", a AS (SELECT *, unnest([{", ".join(f"{{'lookback': '{x}', 'anchor': {anchor(x)}}}" for x in LOOKBACKS)}], recursive := true) FROM (SELECT market, symbol, session, adj_close AS end_close FROM bars))
SELECT a.market, a.symbol, a.session, a.lookback, round(a.end_close / b.adj_close - 1, 8) AS raw_return FROM a ASOF JOIN bars b ON a.market = b.market AND a.symbol = b.symbol AND a.anchor >= b.session""",
    "universe": "SELECT * FROM universe",
    "unresolved": "SELECT market, session, symbol FROM outcomes WHERE status <> 'resolved'",
    "rank_table": f"SELECT {KEY}, lookback, {rd('percentile', 'raw_return')} FROM ranks",
    "rank_ranges": f"SELECT {KEY}, lookback, {rd('percentile', 'raw_return')} FROM ranks",
    "decile_gate": f"SELECT DISTINCT {KEY} FROM ranks WHERE percentile >= {P.top_decile}",
    "detection_gate": "SELECT * FROM gate",
    "breadth_counts": "SELECT * FROM breadth",
    "leaderboards": "SELECT * REPLACE (round(raw_return, 8) AS raw_return, round(adr, 8) AS adr) FROM boards_all",
    "leaderboards_without_low_adr": f"SELECT * REPLACE (round(raw_return, 8) AS raw_return, round(adr, 8) AS adr) FROM boards_all WHERE adr IS NULL OR round(adr, 8) >= {P.low_adr}",
    "board_names": f"SELECT DISTINCT {KEY} FROM boards",
    "sector_board": SECTOR,
    "industry_board": f"""SELECT market, session, label AS industry, sector, members, {SHARES}, round({SHAPE}, 8) AS shape_differential,
       CAST(row_number() OVER (PARTITION BY market, session ORDER BY {SHAPE} DESC, label) AS INT) AS position
FROM industry_fold LEFT JOIN (SELECT market, session, industry AS label, min(sector) AS sector FROM ranks JOIN labels USING (market, symbol) GROUP BY ALL) USING (market, session, label) WHERE members >= {P.industry_min}""",
    "leave_one_out": "SELECT market, session, symbol, round(share, 8) AS share FROM loo",
    "cluster": "SELECT market, symbol, session, cluster.k AS k, cluster.high AS high, cluster.low AS low, round(cluster.range_adr, 8) AS range_adr FROM roll",
    "catch_up": "SELECT market, symbol, session, caught_up FROM roll",
    "prior_move": "SELECT d.market, d.symbol, d.session, round(move.gain, 8) AS gain, CAST(move.peak AS INT) AS peak FROM passing d LEFT JOIN best USING (market, symbol, idx)",
    "base_span": "SELECT market, symbol, session, CAST(base_start AS INT) AS base_start, base_len FROM bases",
    "churn_dryup": f"SELECT market, symbol, session, base_low, {rd('churn_l', 'dryup')} FROM shape",
    "envelope": f"SELECT market, symbol, session, {rd('slope', 'overshoot_adr', 'line_end')}, line_ok, touch_zones FROM fits",
    "detections": f"SELECT * REPLACE ({rd(*ROUNDED)}) FROM dets",
    "star_score": "SELECT market, session, symbol, score, breakdown, round(sector_share, 8) AS sector_share, prior_move FROM scored",
    "candidates": f"""SELECT {KEY}, CAST(row_number() OVER (PARTITION BY market, session ORDER BY score DESC, line_ok DESC, symbol) AS INT) AS position, score, breakdown,
       round((trigger - close) / (adr * close), 8) AS dist_adr, round(stopw_adr, 8) AS stopw_adr, stopw_adr <= {P.affordable} AS affordable, industry, breadth FROM scored""",
    "regime": """SELECT market, session, state, CASE state WHEN 'FRIENDLY' THEN 'full size' WHEN 'CHOPPY' THEN 'reduced' WHEN 'HOSTILE' THEN 'sit out' END AS posture, round(breadth, 8) AS breadth
FROM states LEFT JOIN market_breadth USING (market, session) WHERE symbol LIKE '^%'""",
    "market_breadth": "SELECT market, session, round(breadth, 8) AS breadth FROM market_breadth",
    "follow_through": f"""SELECT market, session, CASE WHEN count(*) OVER w = {P.breakout} THEN adj_close > max(adj_close) OVER w END AS broke_out, adj_close AS index_close
FROM bars WHERE symbol LIKE '^%' WINDOW w AS ({W} ROWS BETWEEN {P.breakout} PRECEDING AND 1 PRECEDING)""",
    "digest": "SELECT market, session, position, symbol, score, industry, round(stopw_adr, 8) AS stopw_adr, close, trigger, round(pct_through, 8) AS pct_through, last_reported IS NOT NULL AS repeat, last_reported FROM digests",
    "digest_report": """, rows AS (
  SELECT market, session, string_agg('| ' || symbol || ' | ' || regexp_replace(printf('%.1f', score), '\\.0$', '') || '★ | ' || coalesce(nullif(industry, ''), '—') || ' | ' || CASE WHEN stopw_adr < 0 AND stopw_adr > -0.005 THEN '-' ELSE '' END || CAST(CAST(round(CAST(stopw_adr AS DECIMAL(24,12)), 2) AS DECIMAL(18,2)) AS VARCHAR) || ' | '
         || CAST(CAST(round(CAST(close AS DECIMAL(24,12)), 2) AS DECIMAL(18,2)) AS VARCHAR) || ' | ' || CAST(CAST(round(CAST(trigger AS DECIMAL(24,12)), 2) AS DECIMAL(18,2)) AS VARCHAR) || ' | ' || '+' || CAST(CAST(round(CAST(pct_through AS DECIMAL(24,12)), 2) AS DECIMAL(18,2)) AS VARCHAR) || '% | '
         || CASE WHEN last_reported IS NULL THEN '' ELSE '↺ last reported ' || CAST(last_reported AS VARCHAR) END || ' |', chr(10) ORDER BY position) AS t
  FROM digests GROUP BY market, session)
SELECT market, session, '# ' || market || ' digest — ' || CAST(session AS VARCHAR) || chr(10) || chr(10)
       || 'Report a name when today''s close is above yesterday''s trigger — i.e. today''s close is above the last four sessions'' high.' || chr(10) || chr(10)
       || coalesce('| Ticker | Score | Industry | Stop ÷ADR | Close | Trigger | % through | |' || chr(10) || '|---|---|---|---|---|---|---|---|' || chr(10) || t, 'No breaks tonight.') || chr(10) AS text
FROM cal LEFT JOIN rows USING (market, session)""",
    "chart_rows": f"SELECT market, symbol, session, as_of, CAST(back AS INT) AS back, close, {rd('sma10', 'sma20', 'sma50', 'ema65')}, round(dv, 8) AS dollar_volume, round(envelope, 8) AS envelope, in_base, in_cluster FROM chart",
    "chart_bundle": """, one AS (
  SELECT market, symbol, as_of, CAST(count(*) AS INT) AS n_candles, min(session) AS first_session, coalesce(sum(sma50), 0) AS a, coalesce(sum(ema65), 0) AS b, min(session) FILTER (WHERE in_base) AS base_start,
         min(session) FILTER (WHERE in_cluster) AS cluster_start, CAST(count(envelope) AS INT) AS n_envelope FROM chart GROUP BY ALL)
SELECT o.market, o.symbol, as_of, n_candles, first_session, round(a, 4) AS sma50_sum, round(b, 4) AS ema65_sum, base_start, cluster_start, trigger, cluster_low AS stop, n_envelope, score,
       round((trigger - close) / (adr * close), 8) AS dist_adr, CASE WHEN s.symbol IS NOT NULL THEN round(r.percentile, 8) END AS decile_1m, CASE WHEN s.symbol IS NOT NULL THEN s.sector END AS sector
FROM one o LEFT JOIN scored s ON s.market = o.market AND s.symbol = o.symbol AND s.session = as_of
LEFT JOIN ranks r ON r.market = o.market AND r.symbol = o.symbol AND r.session = as_of AND r.lookback = '1m'""",
    "run_gate": f""", c AS (
  SELECT market, session, CAST(count(*) FILTER (WHERE status <> 'refused') AS INT) AS symbols_enumerated,
         CAST(count(*) FILTER (WHERE status = 'resolved' OR (status = 'unresolved' AND month(session) % 2 = 0)) AS INT) AS symbols_resolved FROM outcomes GROUP BY market, session),
d AS (SELECT *, symbols_resolved >= {P.resolution_floor} * symbols_enumerated AS whole FROM c),
e AS (SELECT *, last_value(CASE WHEN whole THEN symbols_enumerated END IGNORE NULLS) OVER (PARTITION BY market ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d)
SELECT market, session, CASE WHEN whole AND (prev IS NULL OR symbols_enumerated >= {P.enumeration_floor} * prev) THEN 'published' ELSE 'quarantined' END AS status, symbols_enumerated, symbols_resolved FROM e""",
    "runs_summary": """SELECT market, r.session, symbols_enumerated, symbols_resolved, CAST((SELECT count(*) FROM universe u WHERE u.market = r.market AND u.session = r.session) AS INT) AS universe_size,
       r.session < CASE r.market WHEN 'US' THEN DATE '2001-10-19' ELSE DATE '2001-10-22' END AS run_due, newest = 'quarantined' AS stale
FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY session DESC) AS n FROM runs WHERE status = 'published') r
JOIN (SELECT market, arg_max(status, session) AS newest FROM runs GROUP BY market) USING (market) WHERE n = 1""",
    "backfill_sessions": f"{ABSENT} SELECT * FROM absent",
    "labels_to_fetch": f", {FETCH} SELECT * FROM asked",
    "label_refresh": f""", {FETCH}, got AS (
  SELECT l.market, l.symbol, l.sector, upper(l.industry) AS industry, (SELECT max(session) FROM universe u WHERE u.market = l.market) AS as_of
  FROM labels l SEMI JOIN asked USING (market, symbol) WHERE CAST(substr(l.symbol, 2) AS INT) % 6 <> 2)
SELECT market, symbol, coalesce(g.sector, c.sector) AS sector, coalesce(g.industry, c.industry) AS industry, coalesce(g.as_of, c.as_of) AS as_of FROM {CACHED} c FULL JOIN got g USING (market, symbol)""",
    "label_coverage": f"SELECT {KEY} FROM universe SEMI JOIN labels USING (market, symbol)",
    "retention": f"SELECT {KEY}, lookback, {rd('percentile', 'raw_return')} FROM ranks JOIN (SELECT market, CAST(max(session) - INTERVAL {P.retention_months} MONTH AS DATE) AS since FROM ranks GROUP BY market) USING (market) WHERE session >= since",
    "readable_sessions": f"SELECT {KEY} FROM universe SEMI JOIN (SELECT * FROM runs WHERE status = 'published') r USING (market, session)",
    "debris": "SELECT DISTINCT market, session FROM universe ANTI JOIN (SELECT * FROM runs WHERE status = 'published') r USING (market, session)",
    "acceptance": f""", {FIGURES}
SELECT market, session, key, label, unit, round(measured, 8) AS measured, expected, detail,
       CASE WHEN expected IS NULL THEN false WHEN expected = 0 THEN measured <> 0 ELSE abs(measured - expected) > {P.tolerance} * abs(expected) END AS deviates FROM long""",
    "spot_check": """, w AS (SELECT * FROM (SELECT DISTINCT market, session FROM universe), (VALUES ('S00001'), ('S00002'), ('S00003'), ('S00005'), ('S00008'), ('S00013')) v(symbol))
SELECT w.market, w.session, w.symbol, u.symbol IS NOT NULL AS present FROM w LEFT JOIN universe u USING (market, session, symbol)""",
    "backfill": f"""{ABSENT}, days AS (SELECT market, session FROM absent),
a AS (SELECT market, session, symbol, NULL AS lookback, NULL AS a, NULL AS b, 'universe' AS tab FROM universe
      UNION ALL SELECT market, session, symbol, lookback, percentile, raw_return, 'ranks' FROM ranks
      UNION ALL SELECT market, session, symbol, NULL, trigger, stopw_adr, 'detections' FROM dets
      UNION ALL SELECT market, session, NULL, NULL, adj_close, CAST(CASE WHEN count(*) OVER w = {P.breakout} THEN adj_close > max(adj_close) OVER w END AS DOUBLE), 'follow_through'
        FROM bars WHERE symbol LIKE '^%' WINDOW w AS ({W} ROWS BETWEEN {P.breakout} PRECEDING AND 1 PRECEDING)
      UNION ALL SELECT market, session, symbol, NULL, position, pct_through, 'digest' FROM digests)
SELECT tab AS "table", market, session, symbol, CAST(lookback AS VARCHAR) AS lookback, round(CAST(a AS DOUBLE), 8) AS a, round(CAST(b AS DOUBLE), 8) AS b FROM a SEMI JOIN days USING (market, session)""",
}

ORACLE_SQL = {name: BASE + text for name, text in _SELECTS.items()}

ORACLE_SQL["ingest_counts"] = BASE + f" SELECT market, symbol, count(*) AS delivered, count(*) FILTER (WHERE {WEEK} % 5 <> 0) AS added FROM bars GROUP BY market, symbol"
ORACLE_SQL |= {"stream_universe": ORACLE_SQL["universe"], "stream_digest": ORACLE_SQL["digest"]}
ORACLE_SQL["stream_bars"] = BASE + f""", clean AS (SELECT * FROM raw WHERE volume > 0 AND (session < DATE '2001-10-22' OR (session = DATE '2001-10-22' AND market = 'IDX')))
SELECT market, symbol, session, CASE WHEN {WEEK} % 2 = 0 THEN close ELSE close + 1 END AS close, volume, delivered, added, total, last_session
FROM clean JOIN (SELECT market, symbol, CAST(sum(CASE WHEN {WEEK} % 2 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS delivered, count(*) AS added, count(*) AS total, max(session) AS last_session FROM clean GROUP BY market, symbol) USING (market, symbol)"""
