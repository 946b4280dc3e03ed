"""Ten figures of each session against their expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.candidates import scored
from tidemark.operators.ranks import board_names, decile_gate
from tidemark.params import ACCEPTANCE, SPOT_CHECK, Params

KEY = ["market", "session"]


def deviates(measured: Column, expected: Column, params: Params = Params()) -> Column:
    """Over the tolerance apart; any difference if nothing is expected at zero; never without an expectation."""
    return F.when(expected.isNull(), False).when(expected == 0, measured != 0).otherwise(F.abs(measured - expected) > params.tolerance * F.abs(expected))


def figures(universe: DataFrame, ranks: DataFrame, detections: DataFrame, labels: DataFrame, breaks: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, B1 to B10 and the medians of stop width and cluster length, for each session of universe."""
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    have = labels.select("market", "symbol", F.lit(1).alias("_has"))
    members = universe.join(have, ["market", "symbol"], "left").groupBy(*KEY).agg(F.count("*").alias("n"), F.count("_has").alias("n_labelled"))
    gate = decile_gate(ranks, params).groupBy(*KEY).agg(F.count("*").alias("n_gate"))
    boards = board_names(ranks, params).groupBy(*KEY).agg(F.count("*").alias("n_boards"))
    reports = breaks.select(*KEY, "symbol").distinct().groupBy(*KEY).agg(F.count("*").alias("n_breaks"))
    found = scored(detections, ranks, labels, params).groupBy(*KEY).agg(
        F.count("*").alias("n_det"), F.count_if(F.col("stopw_adr") > params.affordable).alias("n_wide"), F.count_if(F.col("line_end") > F.col("cluster_high")).alias("n_line"),
        F.count_if(F.col("cluster_k") == 3).alias("n_k3"), F.count_if(F.col("score") >= params.four_star).alias("n_star"),
        F.percentile("stopw_adr", 0.5).alias("median_stop"), F.percentile("cluster_k", 0.5).alias("median_k"),
    )
    out = members
    for x in (gate, boards, found, reports):
        out = out.join(x, KEY, "left")
    out = out.fillna(0, ["n_gate", "n_boards", "n_breaks", "n_det", "n_wide", "n_line", "n_k3", "n_star"])
    return out.select(
        *KEY, F.col("n").cast("double").alias("B1"), share("n_gate", "n").alias("B2"), F.col("n_boards").cast("double").alias("B3"), F.col("n_det").cast("double").alias("B4"),
        F.col("n_breaks").cast("double").alias("B5"), share("n_wide", "n_det").alias("B6"), share("n_line", "n_det").alias("B7"), share("n_k3", "n_det").alias("B8"),
        share("n_star", "n_det").alias("B9"), share("n_labelled", "n").alias("B10"), "median_stop", "median_k",
    )


def acceptance(universe: DataFrame, ranks: DataFrame, detections: DataFrame, labels: DataFrame, breaks: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, key, label, unit, measured, expected, deviates, detail: ten rows a session."""
    rows = []
    for key, label, unit, expected in ACCEPTANCE:
        by_market = F.coalesce(*[F.when(F.col("market") == m, F.lit(v)) for m, v in expected.items()], F.lit(None).cast("double"))
        detail = F.lit("")
        if key == "B6":
            detail = F.when(F.col("median_stop").isNull(), "no detections").otherwise(F.format_string("median %.2f×", "median_stop"))
        elif key == "B8":
            detail = F.when(F.col("median_k").isNull(), "no detections").otherwise(F.concat(F.lit("median k="), F.regexp_replace(F.format_string("%.1f", "median_k"), r"\.0$", "")))
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.col(key).alias("measured"), by_market.alias("expected"), detail.alias("detail")))
    long = figures(universe, ranks, detections, labels, breaks, params).select(*KEY, F.explode(F.array(*rows)).alias("x")).select(*KEY, "x.*")
    return long.withColumn("deviates", deviates(F.col("measured"), F.col("expected"), params))


def spot_check(universe: DataFrame, names: tuple = SPOT_CHECK) -> DataFrame:
    """market, session, symbol, present: which of the names each session's universe has."""
    days = universe.select(*KEY).distinct()
    wanted = days.select(*KEY, F.explode(F.array(*[F.lit(x) for x in names])).alias("symbol"))
    have = universe.filter(F.col("symbol").isin(*names)).withColumn("_in", F.lit(True))
    return wanted.join(have, [*KEY, "symbol"], "left").select(*KEY, "symbol", F.coalesce("_in", F.lit(False)).alias("present"))
