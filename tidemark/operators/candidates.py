"""The star score of a detection, and the sorted list of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.copies import placed
from tidemark.operators.detection import dist_adr
from tidemark.operators.ranks import breadth
from tidemark.params import DIMENSIONS, Params

KEY = ["market", "session", "symbol"]


def star_score(prior_move: Column, sector_share: Column, params: Params = Params()) -> tuple[Column, Column]:
    """Stars (0 to 5 by halves) and the breakdown, an array of (dimension, weight, hit), of a detection's columns."""
    hits = {
        "Tightness": F.col("cluster_k") >= params.tight_k,
        "Orderliness": F.col("churn_l").between(params.churn_low, params.churn_high),
        "Prior move": prior_move,
        "Base length": F.col("base_len") <= params.short_base,
        "MA support": F.col("sma20_rising"),
        "Volume": F.col("dryup") <= params.dry,
        "Sector": sector_share >= params.share_min,
        "ADR": F.col("adr") >= params.adr_min,
    }
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in hits.items()}
    points = sum((F.when(sure[k], w).otherwise(0) for k, w in DIMENSIONS), F.lit(0))
    return points / F.lit(2.0), F.array(*[F.struct(F.lit(k).alias("dimension"), F.lit(w).alias("weight"), sure[k].alias("hit")) for k, w in DIMENSIONS])


def scored(detections: DataFrame, ranks: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """detections with sector_share, prior_move, score, breakdown, breadth, industry and sector; copies stay."""
    # One pass over ranks gives each name's breadth, gate and hit; a sector's other members are counted by window.
    top = F.col("percentile") >= params.top_decile
    own = ranks.groupBy(*KEY).agg(
        breadth(ranks, params), F.max(top & F.col("lookback").isin(*params.gate_lookbacks)).alias("_gate"),
        F.max((top & (F.col("lookback") == params.delta_lookback)).cast("int")).alias("_hit"),
    )
    named = labels.filter("sector <> ''").select("market", "symbol", F.col("sector").alias("_axis")).distinct()  # a symbol counts once in a sector
    w = Window.partitionBy("market", "session", "_axis")
    share = F.when(F.col("_axis").isNotNull(), F.try_divide(F.sum("_hit").over(w) - F.col("_hit"), F.count("*").over(w) - 1))
    own = own.join(named, ["market", "symbol"], "left").withColumn("_share", share).select(*KEY, "breadth", "_gate", "_share")
    out = detections.join(own, KEY, "left").join(labels.select("market", "symbol", "industry", "sector"), ["market", "symbol"], "left")
    out = out.withColumn("sector_share", F.coalesce("_share", F.lit(0.0))).withColumn("prior_move", F.coalesce("_gate", F.lit(False))).withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    stars, rows = star_score(F.col("prior_move"), F.col("sector_share"), params)
    return out.withColumn("score", stars).withColumn("breakdown", rows).drop("_share", "_gate")


def candidates(detections: DataFrame, ranks: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """market, session, position, symbol, score, breakdown, dist_adr, stopw_adr, affordable, industry, breadth."""
    out = scored(detections, ranks, labels, params)
    order = Window.partitionBy("market", "session").orderBy(F.desc("score"), F.desc("line_ok"), "symbol")
    out = placed(out, order, "position").withColumn("affordable", F.coalesce(F.col("stopw_adr") <= params.affordable, F.lit(False)))
    return out.select("market", "session", "position", "symbol", "score", "breakdown", dist_adr().alias("dist_adr"), "stopw_adr", "affordable", "industry", "breadth")
