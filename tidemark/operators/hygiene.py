"""Which delivered bars and instruments count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import is_final
from tidemark.params import Params

#: Fixed value: names that mark what isn't common stock, as whole words.
NOT_COMMON = r"(?i)\b(?:warrants?|rights?|units?|notes?|bonds?|debentures?|preferred|pfd|trusts?|funds?)\b"


def dollar_volume() -> Column:
    return F.col("close") * F.col("volume")


def drop_phantoms(bars: DataFrame) -> DataFrame:
    return bars.filter("volume > 0")


def keep_final(bars: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    return bars.filter(is_final(F.col("session"), F.col("market"), now, params))


def is_usable(now: Column, params: Params = Params()) -> Column:
    """The test that clean goes by."""
    return (F.col("volume") > 0) & is_final(F.col("session"), F.col("market"), now, params)


def clean(bars: DataFrame, now: Column, params: Params = Params()) -> DataFrame:
    """Traded and final bars."""
    return keep_final(drop_phantoms(bars), now, params)


def is_common_stock(name: Column) -> Column:
    """No name passes, and so do depositary shares."""
    return ~F.coalesce(name, F.lit("")).rlike(NOT_COMMON)
