"""Running error rates over a stream of scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplekit.operators import metrics


def running_error_rates(stream: DataFrame, *, every: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per window of ts (and by): confusion counts and error rates. stream: ts, score, label, by. Rows later than `late` are dropped."""
    windowed = stream.withWatermark("ts", late).withColumn("window", F.window("ts", every))
    rates = metrics.with_error_rates(metrics.confusion(windowed, ["window", *(by or [])], threshold=threshold))
    return rates.select(F.col("window.start").alias("start"), *(by or []), "tp", "fn", "tn", "fp", "apcer", "bpcer", "acer")
