"""Signals: empty reads, calibration, normalisation, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..params import JobParams

#: Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def drop_empty_reads(reads: DataFrame) -> DataFrame:
    """Reads that have samples."""
    return reads.where(F.col("len_raw_signal") > 0)


def calibrated(raw: Column, offset: Column, span: Column, digitisation: Column) -> Column:
    """Picoamperes of raw samples."""
    return F.transform(raw, lambda x: (x + offset) * span / digitisation)


def calibrate_signal(reads: DataFrame) -> DataFrame:
    """reads with signal in picoamperes in place of raw_signal."""
    return reads.withColumn("signal", calibrated(F.col("raw_signal"), F.col("offset"), F.col("range"), F.col("digitisation"))).drop("raw_signal")


def median(values: Column) -> Column:
    """Exact median of an array of numbers, null if it is empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return let(F.sort_array(values), middle)


def scaled(signal: Column, shift: Column, scale: Column) -> Column:
    return F.transform(signal, lambda x: F.try_divide(x - shift, scale))


def normalize_signal(reads: DataFrame, mode: str = "med_mad", shift: float = 0.0, scale: float = 1.0) -> DataFrame:
    """reads (signal) with signal normalised, in one of two ways that are this library's own definition.

    fixed: (x - shift) / scale. med_mad: (x - median) / (median absolute deviation * 1.4826), nulls if that is 0.
    """
    if mode == "fixed":
        return reads.withColumn("signal", scaled(F.col("signal"), F.lit(shift), F.lit(scale)))
    if mode != "med_mad":
        raise ValueError(f"no such mode: {mode}")
    spread = lambda x, m: F.nullif(median(F.transform(x, lambda v: F.abs(v - m))), F.lit(0.0)) * MAD_SCALE
    return reads.withColumn("signal", let(F.col("signal"), lambda x: let(median(x), lambda m: let(spread(x, m), lambda d: scaled(x, m, d)))))


def chunk_offsets(n: Column, params: JobParams) -> Column:
    """Starts of the chunks of a signal of n > 0 samples.

    A chunk begins every step samples; if the signal is as long as a chunk, none begins so late that it passes the end, so
    the last two may coincide. A shorter signal is not moved back.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.ceil(n / F.lit(params.step)).cast("long") - 1)
    at = lambda i: i * params.step
    return F.transform(starts, lambda i: F.when(n >= params.samples, F.least(at(i), n - params.samples)).otherwise(at(i)))


def chunk_plan(reads: DataFrame, params: JobParams) -> DataFrame:
    """reads with samples (len_raw_signal) -> one row a chunk: the other columns, idx, input_offset, raw_chunk_size."""
    kept = [c for c in reads.columns if c not in ("raw_signal", "signal")]
    planned = drop_empty_reads(reads).select(*kept, F.posexplode(chunk_offsets(F.col("len_raw_signal"), params)).alias("idx", "input_offset"))
    return planned.withColumn("raw_chunk_size", F.least(F.lit(params.samples), F.col("len_raw_signal") - F.col("input_offset")).cast("int"))


def padded(part: Column, size: int) -> Column:
    """part repeated until it has size elements."""
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(part, k % F.size(part)))
    return F.when(F.size(part) < size, whole).otherwise(part)


def chunk_arrays(reads: DataFrame, params: JobParams) -> DataFrame:
    """reads (signal) -> the other columns and chunks, an array of idx, input_offset, raw_chunk_size and padded signal.

    As chunk_signal(), but a read's chunks stay together in its row.
    """
    kept = [c for c in reads.columns if c not in ("raw_signal", "signal")]
    cs = params.samples
    part = lambda o: F.slice("signal", o.cast("int") + 1, F.lit(cs))
    cut = F.transform(chunk_offsets(F.col("len_raw_signal"), params), lambda o, i: let(part(o), lambda p: F.struct(i.alias("idx"), o.alias("input_offset"), F.size(p).alias("raw_chunk_size"), padded(p, cs).alias("signal"))))
    return drop_empty_reads(reads).select(*kept, cut.alias("chunks"))


def chunk_signal(reads: DataFrame, params: JobParams) -> DataFrame:
    """reads (signal) -> one row a chunk with its own samples, short ones repeat-padded to the chunk size.

    Each chunk is cut out before rows are multiplied, so no row carries the whole signal.
    """
    kept = [c for c in reads.columns if c not in ("raw_signal", "signal")]
    cs = params.samples
    cut = F.transform(chunk_offsets(F.col("len_raw_signal"), params), lambda o, i: F.struct(i.alias("idx"), o.alias("input_offset"), F.slice("signal", o.cast("int") + 1, F.lit(cs)).alias("part")))
    rows = drop_empty_reads(reads).select(*kept, F.explode(cut).alias("c"))
    return rows.select(*kept, "c.idx", "c.input_offset", F.size("c.part").alias("raw_chunk_size"), padded(F.col("c.part"), cs).alias("signal"))
