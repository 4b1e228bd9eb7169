"""Arriving SLOW5 files through the read-level operators, as far as FASTQ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, infer, signal
from ..params import JobParams
from ..sources.fastq import fastq_lines
from ..sources.files import LISTED, named, ranges
from ..sources.slow5 import COLUMNS, SPLIT_BYTES
from ..sources.slow5_scan import Scan


def arriving_reads(spark: SparkSession, source: str, columns: dict[str, str] = COLUMNS, files_per_trigger: int = 100, bytes_per_trigger: int | None = None, tasks: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of path, position and columns of the records of files that come to source.

    The stream itself is of files: what a micro-batch takes is cut in byte ranges, and each range reads its own file's header,
    so files of one batch or of several may order their columns as they like. A column that a file lacks is null, one of
    another type ends the query, as does a record that cannot be read. A micro-batch has at most so many files, or, if given,
    about so many bytes; its ranges are dealt to so many tasks.
    """
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    files = spark.readStream.format("binaryFile").schema(LISTED).option(*limit).load(source)
    work = Scan(columns, None, False, False)
    return ranges(named(files), split_bytes).repartition(tasks or spark.sparkContext.defaultParallelism).mapInArrow(work, work.schema())


def drain(frame: DataFrame, sink: str, checkpoint: str, form: str = "parquet") -> None:
    """Appends what a stream has at the time to sink; the checkpoint makes each file count once."""
    frame.writeStream.format(form).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_reads(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], columns: dict[str, str] = COLUMNS, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """Takes every file that source has not yet given, in micro-batches, and appends transform(reads) to sink as Parquet.

    A read is complete in itself, so there is no state and no watermark. Returns what sink then holds.
    """
    reads = arriving_reads(spark, source, columns, files_per_trigger, bytes_per_trigger).drop("path", "position")
    drain(transform(reads), sink, checkpoint)
    return spark.read.parquet(sink)


def called_reads(reads: DataFrame, make_model: Callable[[], infer.Model], params: JobParams, is_rna: Column | None = None, mode: str = "med_mad", tolerate: tuple[str, ...] = ()) -> DataFrame:
    """reads (read_id, raw_signal, ...) -> the columns that are no signals, seq, qstring: every step from raw samples to bases.

    A read's chunks stay in its row, so there is neither window nor shuffle and a stream can take it as well as a table.
    Reads without samples or without bases are left out; a decoder's output that breaks a rule, or a read whose bases and
    qualities do not agree, ends the job.
    """
    signals = signal.normalize_signal(signal.calibrate_signal(signal.drop_empty_reads(reads)), mode)
    scored = infer.score_reads(signal.chunk_arrays(signals, params), make_model, params)
    stitched = assemble.stitch_arrays(infer.emit_arrays(scored, tolerate=tolerate), params).where(F.length("seq") > 0)
    return assemble.require_whole(assemble.orient_reads(stitched, F.lit(False) if is_rna is None else is_rna))


def stream_calls(spark: SparkSession, source: str, sink: str, checkpoint: str, make_model: Callable[[], infer.Model], params: JobParams, is_rna: Column | None = None, tolerate: tuple[str, ...] = (), columns: dict[str, str] = COLUMNS, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> None:
    """Signals of every file that source has not yet given -> FASTQ in sink."""
    reads = arriving_reads(spark, source, columns, files_per_trigger, bytes_per_trigger)
    drain(fastq_lines(called_reads(reads, make_model, params, is_rna, tolerate=tolerate)).select("value"), sink, checkpoint, "text")
