"""How much of each sector and industry is in the top decile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.calendar import session_before
from tidemark.params import LOOKBACKS, Params


def labelled(ranks: DataFrame, labels: DataFrame, axis: str) -> DataFrame:
    """ranks with the axis' label; those without one are on no axis."""
    named = labels.filter(F.col(axis).isNotNull() & (F.col(axis) != "")).select("market", "symbol", F.col(axis).alias("label"))
    return ranks.join(named, ["market", "symbol"])


def fold(ranks: DataFrame, labels: DataFrame, axis: str, params: Params = Params()) -> DataFrame:
    """market, session, label, members (symbols with any rank) and k_<lookback> (those in its top decile).

    Rows are reduced to one a symbol first, so that members are counted, not made distinct.
    """
    top = [F.max(((F.col("lookback") == x) & (F.col("percentile") >= params.top_decile)).cast("int")).alias(f"k_{x}") for x in LOOKBACKS]
    by_symbol = labelled(ranks, labels, axis).groupBy("market", "session", "label", "symbol").agg(*top)
    return by_symbol.groupBy("market", "session", "label").agg(F.count("*").alias("members"), *[F.sum(f"k_{x}").alias(f"k_{x}") for x in LOOKBACKS])


def _share(lookback: str) -> Column:
    return F.coalesce(F.try_divide(F.col(f"k_{lookback}"), F.col("members")), F.lit(0.0))


def _maps() -> list[Column]:
    keys = F.array(*[F.lit(x) for x in LOOKBACKS])
    return [F.map_from_arrays(keys, F.array(*[_share(x) for x in LOOKBACKS])).alias("shares"), F.map_from_arrays(keys, F.array(*[F.col(f"k_{x}") for x in LOOKBACKS])).alias("decile_counts")]


def leave_one_out(ranks: DataFrame, labels: DataFrame, params: Params = Params(), lookback: str | None = None) -> DataFrame:
    """market, session, symbol, share: of the others in the symbol's sector, those in the top decile."""
    x = lookback or params.delta_lookback
    own = labelled(ranks, labels, "sector").groupBy("market", "session", "label", "symbol").agg(F.max(((F.col("lookback") == x) & (F.col("percentile") >= params.top_decile)).cast("int")).alias("hit"))
    w = Window.partitionBy("market", "session", "label")
    share = F.coalesce(F.try_divide(F.sum("hit").over(w) - F.col("hit"), F.count("*").over(w) - 1), F.lit(0.0))
    return own.select("market", "session", "symbol", share.alias("share"))


def sector_board(ranks: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Every sector of the axis on every session of ranks, dead ones at 0, in board order (position from 1).

    first_ineligible is the place (from 0) of the first sector that can't rotate, -1 if all can; it is the same
    in both orders.
    """
    axis = F.posexplode(F.array(*[F.lit(x) for x in params.sectors])).alias("axis", "label")
    grid = session_before(ranks, params.delta_sessions).select("market", "session", "before", axis)
    counts = fold(ranks, labels, "sector", params)
    now = grid.join(counts, ["market", "session", "label"], "left").fillna(0, ["members", *[f"k_{x}" for x in LOOKBACKS]])
    x = params.delta_lookback
    past = counts.select("market", F.col("session").alias("before"), "label", _share(x).alias("_past"))
    out = now.join(past, ["market", "before", "label"], "left")
    delta = F.when(F.col("before").isNotNull(), _share(x) - F.coalesce("_past", F.lit(0.0)))
    out = out.select(
        "market", "session", F.col("label").alias("sector"), "axis", "members", *_maps(), (_share(params.short_lookback) - _share(params.long_lookback)).alias("shape_differential"),
        delta.alias("temporal_delta"), (F.col(f"k_{params.short_lookback}") >= params.rotation_min).alias("rotation_eligible"), (F.col(f"k_{x}") < params.rotation_min).alias("delta_low_confidence"),
    )
    order = Window.partitionBy("market", "session").orderBy(F.desc("rotation_eligible"), F.desc("shape_differential"), "axis")
    by_delta = Window.partitionBy("market", "session").orderBy(F.desc("rotation_eligible"), F.desc_nulls_last("temporal_delta"), "axis")
    out = out.withColumn("position", F.row_number().over(order)).withColumn("delta_position", F.row_number().over(by_delta)).drop("axis")
    first = F.min(F.when(~F.col("rotation_eligible"), F.col("position") - 1)).over(Window.partitionBy("market", "session"))
    return out.withColumn("first_ineligible", F.coalesce(first, F.lit(-1)))


def industry_board(ranks: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Industries with enough members, each with the least sector of its ranked members' labels."""
    counts = fold(ranks, labels, "industry", params).filter(F.col("members") >= params.industry_min)
    who = ranks.select("market", "session", "symbol").distinct().join(labels.filter("industry <> '' AND sector <> ''"), ["market", "symbol"])
    sector = who.groupBy("market", "session", F.col("industry").alias("label")).agg(F.min("sector").alias("sector"))
    out = counts.join(sector, ["market", "session", "label"], "left")
    out = out.select("market", "session", F.col("label").alias("industry"), "sector", "members", *_maps(), (_share(params.short_lookback) - _share(params.long_lookback)).alias("shape_differential"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("market", "session").orderBy(F.desc("shape_differential"), "industry")))
