"""Bookkeeping of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def best_so_far(metrics: DataFrame, keys: list[str], epoch: str, loss: str) -> DataFrame:
    """Running best of a metrics table and whether an epoch would have been saved."""
    w = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(loss).over(w)
    return metrics.withColumn("best", best).withColumn("saved", F.col(loss) <= F.col("best"))
