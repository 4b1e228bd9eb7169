"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import fresh_path, written

__all__ = ["fresh_path", "lower_ascii", "pick", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else df has (also names that differ in case only)."""
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
