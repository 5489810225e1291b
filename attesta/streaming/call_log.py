"""Continuous cost rollup of the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.telemetry import measures, named


def cost_rollup(calls: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Measures per tumbling window, stage and model; works on streams and on tables alike."""
    rows = calls.withColumns({"ts": F.col("ts").cast("timestamp"), "s": named("stage"), "m": named("model")})
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "s", "m").agg(*measures())
    return out.select(F.col("w.start").alias("window_start"), F.col("s").alias("stage"), F.col("m").alias("model"), "n_calls", "cost", "tokens_in", "tokens_out")
