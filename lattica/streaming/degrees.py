"""An extension beyond the batch operators: degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame, time: str | None = None, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """(v, d), or (window, v, d) with a watermark on ``time``: from a stream of (src, dst, ...)."""
    ends = edges.withWatermark(time, late) if time else edges
    keys = [F.window(time, window).alias("window")] if time and window else []
    return ends.select(*[c for c in [time] if c], F.explode(F.array("src", "dst")).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("d"))
