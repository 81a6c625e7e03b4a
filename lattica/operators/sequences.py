"""Windows over sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_mean(rows: DataFrame, value: str, order: list[str], width: int, by: list[str]) -> DataFrame:
    """The rows with ``running_mean``, the mean of ``width`` values up to the row in its group's order; null until so many have come."""
    if width < 1:
        raise ValueError("width must be positive")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("running_mean", F.when(F.count(F.lit(1)).over(w) == width, F.avg(value).over(w)))
