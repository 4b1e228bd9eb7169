"""PAF alignment rows from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: positions of the fields that are used, from 0.
FIELDS = {"qname": (0, "string"), "tname": (5, "string"), "matches": (9, "bigint"), "block_len": (10, "bigint"), "mapq": (11, "int")}
LEAST_FIELDS = 12


def parse_paf(text: DataFrame) -> DataFrame:
    """Lines (value, and any other columns) -> those columns and FIELDS; optional tags after field 12 are ignored.

    A line with fewer fields, or with a number that is none, ends the job.
    """
    others = [c for c in text.columns if c != "value"]
    rows = text.where(F.col("value") != "").withColumn("_f", F.split("value", "\t", -1))
    fields = F.when(F.size("_f") < LEAST_FIELDS, F.raise_error(F.concat(F.lit("not a PAF line: "), F.substring("value", 1, 80))).cast("array<string>")).otherwise(F.col("_f"))
    rows = rows.select(*others, fields.alias("_f"))
    return rows.select(*others, *[F.get("_f", F.lit(i)).cast(kind).alias(n) for n, (i, kind) in FIELDS.items()])


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(spark.read.text(path))
