"""Putting separately computed metrics of the same groups into one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One row per group with the metrics of every part; a metric a group lacks is null.

    The parts hold a row per group, so this unions a handful of rows and takes, per
    metric, the only value there is. No join, and no cross join when there are no keys.
    """
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    metrics = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.max(m).alias(m) for m in metrics])
