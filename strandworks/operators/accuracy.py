"""Alignment identity: per row, summarised, compared between callers, gated by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import written
from .quantiles import with_quantiles


def alignment_identity(alignments: DataFrame) -> DataFrame:
    """alignments (matches, block_len) with identity, null where block_len is 0."""
    return alignments.withColumn("identity", F.try_divide(F.col("matches").cast("double"), F.col("block_len").cast("double")))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
MEDIAN = {"median": 0.5}


def summed(alignments: DataFrame, groups: tuple[str, ...], others: dict[str, Column], ps: dict[str, float], approximate: int | None) -> DataFrame:
    """alignments by groups: the aggregates of others, and quantiles of identity.

    These are exact, found by selection without a task that holds a group, unless an accuracy is given: the rank is then off by
    at most 1 / approximate of the group, for one look at the rows instead of three or more.
    """
    if approximate:
        return alignments.groupBy(*groups).agg(*[c.alias(n) for n, c in others.items()], *[F.percentile_approx("identity", p, approximate).alias(n) for n, p in ps.items()])
    held = written(alignments.select(*groups, "identity"), "identities")
    return with_quantiles(held.groupBy(*groups).agg(*[c.alias(n) for n, c in others.items()]), held, "identity", groups, ps)


def identity_summary(alignments: DataFrame, groups: tuple[str, ...] = (), approximate: int | None = None) -> DataFrame:
    """alignments (groups, identity) -> groups, mean, sstdev, q1, median, q3, n; approximate as in summed()."""
    others = {"mean": F.avg("identity"), "sstdev": F.stddev_samp("identity"), "n": F.count("identity")}
    return summed(alignments, groups, others, QUARTILES, approximate).select(*groups, "mean", "sstdev", *QUARTILES, "n")


def compare_runs(alignments: DataFrame, callers: tuple[str, ...], model: str = "model", caller: str = "caller", approximate: int | None = None) -> DataFrame:
    """alignments (model, caller, identity) -> a row a model, <caller>_mean and <caller>_median of each caller; approximate as in summed()."""
    each = summed(alignments, (model, caller), {"mean": F.avg("identity")}, MEDIAN, approximate)
    return each.groupBy(model).pivot(caller, list(callers)).agg(F.max("mean").alias("mean"), F.max("median").alias("median"))  # of one row each


def accuracy_gate(alignments: DataFrame, thresholds: DataFrame, model: str = "model", approximate: int | None = None) -> DataFrame:
    """alignments (model, identity), thresholds (model, threshold) -> model, median, threshold, status; approximate as in summed().

    status: pass, fail, or unknown_model for a model without a threshold.
    """
    medians = summed(alignments, (model,), {"n": F.count("identity")}, MEDIAN, approximate)
    status = F.when(F.col("threshold").isNull(), "unknown_model").when(F.col("median") >= F.col("threshold"), "pass").otherwise("fail")
    return medians.join(thresholds, model, "left").select(model, "median", "threshold", status.alias("status"))


def sample_type(models: DataFrame, column: str = "model") -> DataFrame:
    """models with sample_type, speed_tier and version, read off the model's name, such as dna_r10.4.1_e8.2_400bps_hac@v5.0.0.

    A name that begins with neither dna nor rna ends the job; a tier or version that it lacks is null.
    """
    name = F.element_at(F.split(column, "/"), -1)
    part = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    kind = F.coalesce(part("^(dna|rna)"), F.raise_error(F.concat(F.lit("neither dna nor rna: "), name)).cast("string"))
    return models.withColumns({"sample_type": kind, "speed_tier": part("_(fast|hac|sup)(?:@|$)"), "version": part("@(v[0-9.]+)$")})
