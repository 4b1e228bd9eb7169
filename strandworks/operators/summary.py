"""Run totals and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summary(reads: DataFrame, n_bytes: Column, groups: tuple[str, ...] = ("run",)) -> DataFrame:
    """reads (groups, len_raw_signal) -> groups, total_reads (empty ones too), total_bytes, reads_with_signal."""
    return reads.groupBy(*groups).agg(F.count("*").alias("total_reads"), F.sum(n_bytes).cast("long").alias("total_bytes"), F.count_if(F.col("len_raw_signal") > 0).alias("reads_with_signal"))


def preview_reads(reads: DataFrame, order: tuple[str, ...], batches: int = 1, batch_reads: int = 2_000) -> DataFrame:
    """The first batches * batch_reads reads in the given order."""
    return reads.orderBy(*order).limit(batches * batch_reads)
