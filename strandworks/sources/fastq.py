"""FASTQ as a PySpark data source that splits files by byte ranges, and as text output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import Lines, listed, open_fs, ranges

SPLIT_BYTES = 64 << 20
SCHEMA = "path string, position long, read_id string, seq string, qstring string"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def is_record(lines: list[bytes]) -> bool:
    return len(lines) == 4 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1]) == len(lines[3])


def records(file: BinaryIO, start: int, end: int) -> Iterator[tuple[int, str, str, str]]:
    """Position, id, bases and qualities of the records that begin at or after start and before end.

    A record begins with a line @..., whose next line but one begins with + and whose second and fourth lines are equally
    long. A quality line that begins with @ cannot pass as one: two lines after it stand bases, and no bases begin with +.

    A split that begins inside a file skips the rest of the record before it, three lines at most, to its first record. From
    there on, and from the beginning of a file, everything but empty lines must be records, also the first one that begins
    after end: what is none is an error. So a record that a split begins with is looked at by the split before it too, and
    none can be damaged and passed over as the rest of another.
    """
    at = max(0, start - 1)
    file.seek(at)
    if start:
        at += len(file.readline())  # the line that begins before start is another split's
    window: list[tuple[int, bytes]] = []

    def fill() -> None:
        nonlocal at
        while len(window) < 4 and (line := file.readline()):
            if window or line.strip(b"\r\n"):  # empty lines between records
                window.append((at, line.rstrip(b"\r\n")))
            at += len(line)

    fill()
    passed, began = 0, False
    while start and window and (passed < 3 or not window[0][1]) and not is_record([x[1] for x in window]):
        passed += bool(window.pop(0)[1])
        fill()
    while window:
        lines, here = [x[1] for x in window], window[0][0]
        if here >= end and (not began or is_record(lines)):
            return
        if not is_record(lines):
            raise ValueError(f"no FASTQ record at byte {here}: {lines[0][:60]!r}")
        began = True
        yield here, lines[0][1:].split(None, 1)[0].decode() if lines[0][1:].strip() else "", lines[1].decode(), lines[3].decode()
        window.clear()
        fill()


def range_batches(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The records of a range, in batches of bounded size."""
    store, at = open_fs(path)
    names = ["path", "position", "read_id", "seq", "qstring"]
    with store.open_input_file(at) as raw:
        rows, size = [], 0
        for r in records(Lines(raw), start, end):
            rows.append((path, *r))
            size += len(r[2])
            if len(rows) >= 10_000 or size >= 16 << 20:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, start, end) -> their records."""
    for b in batches:
        for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            yield from range_batches(path, start, end)


class FastqReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        store, root = open_fs(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        before = self.path[: self.path.rindex(root)] if root in self.path else ""
        return [Split(before + f.path, a, min(f.size, a + self.split_bytes)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.split_bytes)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Split):
            return
        yield from range_batches(partition.path, partition.start, partition.end)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): path, position, read_id, seq, qstring. Option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_fastq(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, position, read_id, seq, qstring; (path, position) gives the order of the file.

    Files are listed by Spark, so of a folder that a stream has written only those count that the stream has committed.
    """
    files = listed(spark, path)
    n_bytes = files.agg(F.sum("length")).first()[0] or 0
    return ranges(files, split_bytes).repartition(max(1, -(-n_bytes // split_bytes))).mapInArrow(scan, SCHEMA)


def record_text(read_id: Column, seq: Column, qstring: Column) -> Column:
    """The four lines of a record, without the last line end; an error if seq and qstring differ in length."""
    text = F.concat(F.lit("@"), read_id, F.lit("\n"), seq, F.lit("\n+\n"), qstring)
    return F.when(F.length(seq) != F.length(qstring), F.raise_error(F.concat(F.lit("lengths differ: "), read_id)).cast("string")).otherwise(text)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """reads (read_id, seq, qstring) -> read_id, value, n_bytes (with the last line end); reads without bases give none."""
    return reads.where(F.length("seq") > 0).select("read_id", record_text(F.col("read_id"), F.col("seq"), F.col("qstring")).alias("value")).withColumn("n_bytes", (F.octet_length("value") + 1).cast("long"))


def write_fastq(reads: DataFrame, path: str, order: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes reads (read_id, seq, qstring) and tells what the job has seen: reads, reads_without_bases, records, bytes.

    order: columns by which the files and the records in them are put, such as (path, position) of the reads' own files; files
    are cut by ranges of these, so what stands one after the other in a folder's files is the order as a whole.
    """
    seen, wrote = Observation(), Observation()
    if order:  # before anything is counted, as cutting ranges looks at rows once more
        reads = reads.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.count_if(F.coalesce(F.length("seq"), F.lit(0)) == 0).alias("reads_without_bases"))
    lines = fastq_lines(counted).observe(wrote, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"))
    lines.select("value").write.text(path)
    return {**seen.get, **wrote.get}
