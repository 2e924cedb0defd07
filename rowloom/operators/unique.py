"""First-wins removal of repeated keys, and export projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: list[str], order_by: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first in ``order_by`` stays; null keys are equal. A key that is no column counts
    as null; if none is a column, all rows are equal and one stays. One shuffle, on the keys; a hot key meets its rows
    after each task has kept its own first (the window's group limit, or the top row of each task)."""
    known = [F.col(f"`{k}`") for k in keys if k in df.columns]
    if not known:
        return df.orderBy(*order_by).limit(1)
    w = Window.partitionBy(*known).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def export_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns in order; a name that is no column becomes an empty text column."""
    return df.select(*[F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
