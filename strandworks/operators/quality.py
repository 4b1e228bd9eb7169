"""Read quality scores and their comparison between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import written
from ..functions.quality import read_score, six_digits

#: Fixed value: the largest mean absolute difference that passes.
MOST_DIFFERENCE = 0.36
RANGE_BYTES = 1 << 24


def read_qscore(reads: DataFrame) -> DataFrame:
    """reads (qstring) with qscore, null for empty qualities."""
    return reads.withColumn("qscore", read_score(F.col("qstring")))


def pair_reads(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("read_id",), mode: str = "id") -> DataFrame:
    """Reads of two runs side by side: keys, qstring_a, qstring_b; a full outer join, so reads of one run only stay.

    mode position pairs by the order of the files (path, position), as comparing line by line does; its key is ordinal.
    """
    if mode == "position":
        a, b, keys = numbered(a), numbered(b), ("ordinal",)
    left = a.select(*keys, F.col("qstring").alias("qstring_a"))
    right = b.select(*keys, F.col("qstring").alias("qstring_b"))
    return left.join(right, list(keys), "full")


def numbered(reads: DataFrame) -> DataFrame:
    """reads (path, position) with ordinal: the number of reads before it, by file and position.

    Reads are counted in byte ranges of a file, ranges are summed within their file and files among themselves, so no task
    numbers more than a range, adds up more than a file's ranges or sees more than one row a file. Reads meet the sums where they
    were numbered, by merging: left to sizes, Spark may take the reads for the smaller side and send them to all by the driver.
    """
    ranged = reads.withColumn("_r", F.floor(F.col("position") / F.lit(RANGE_BYTES)))
    counts = written(ranged.groupBy("path", "_r").agg(F.count("*").alias("_n")), "range-counts")
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.groupBy("path").agg(F.sum("_n").alias("_n")).select(F.col("path").alias("_file"), earlier(Window.orderBy("path")).alias("_files_before"))
    ranges = counts.select(F.col("path").alias("_path"), F.col("_r").alias("_range"), earlier(Window.partitionBy("path").orderBy("_r")).alias("_ranges_before"))
    starts = ranges.join(files, F.col("_path") == F.col("_file")).select("_path", "_range", (F.col("_files_before") + F.col("_ranges_before")).alias("_before")).hint("merge")
    within = F.row_number().over(Window.partitionBy("path", "_r").orderBy("position")) - 1
    return ranged.withColumn("_w", within).join(starts, (F.col("path") == F.col("_path")) & (F.col("_r") == F.col("_range"))).withColumn("ordinal", F.col("_before") + F.col("_w")).drop("_r", "_w", "_path", "_range", "_before")


def compare_qscores(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("read_id",), groups: tuple[str, ...] = (), mode: str = "id", compat: bool = False) -> DataFrame:
    """Two runs (keys, qstring) -> groups, n, mean_abs_diff, n_diff, n_left_only, n_right_only.

    groups are keys by which the report is split. compat rounds scores to six digits and cuts the mean to five decimals.
    """
    score = lambda c: six_digits(read_score(F.col(c))) if compat else read_score(F.col(c))
    pairs = pair_reads(a, b, keys, mode).withColumns({"_a": score("qstring_a"), "_b": score("qstring_b")})
    both: Column = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    mean = F.avg(F.when(both, F.abs(F.col("_a") - F.col("_b"))))
    return pairs.groupBy(*groups).agg(
        F.count_if(both).alias("n"),
        (F.floor(mean * 1e5) / 1e5 if compat else mean).alias("mean_abs_diff"),
        F.count_if(both & (F.col("_a") != F.col("_b"))).alias("n_diff"),
        F.count_if(F.col("qstring_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("qstring_a").isNull()).alias("n_right_only"),
    )


def qscore_gate(compared: DataFrame, most: float = MOST_DIFFERENCE) -> DataFrame:
    """compared with status pass or fail; a group without pairs fails."""
    return compared.withColumn("status", F.when(F.col("mean_abs_diff") <= most, "pass").otherwise("fail"))
