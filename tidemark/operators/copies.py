"""Rows that stand for several equal ones: where candidates share a symbol, joins by it would multiply them.

A relation may have the column copies, which tells how many rows each stands for. Relations without it are as
they read, and every function here leaves them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

COPIES = "copies"


def carried(rows: DataFrame) -> list[str]:
    """The column, if rows has it."""
    return [COPIES] if COPIES in rows.columns else []


def weight(rows: DataFrame) -> Column:
    return F.col(COPIES) if carried(rows) else F.lit(1)


def spread(rows: DataFrame) -> DataFrame:
    """Every row as often as it stands for, without the column."""
    if not carried(rows):
        return rows
    return rows.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int")))).drop(COPIES)


def placed(rows: DataFrame, order: WindowSpec, name: str, most: int | None = None) -> DataFrame:
    """rows spread, with each one's place in order from 1, and _copy, its number from 0 among those of its row; most: the places that are kept."""
    rows = rows.withColumn(name, F.row_number().over(order))
    if most is not None:
        rows = rows.filter(F.col(name) <= most)  # a row is at least one
    if not carried(rows):
        return rows.withColumn("_copy", F.lit(0))
    rows = rows.withColumn(name, F.sum(COPIES).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(COPIES))
    n = F.col(COPIES)
    if most is not None:
        rows, n = rows.filter(F.col(name) < most), F.least(n, F.lit(most) - F.col(name))
    out = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), n.cast("int") - 1))).drop(COPIES)
    return out.withColumn(name, (F.col(name) + F.col("_copy") + 1).cast("int"))
