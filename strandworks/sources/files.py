"""Files in byte ranges: what tasks read, and how a listing becomes ranges."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of Spark's source of whole files; content is never asked for, so it is never read.
LISTED = "path string, modificationTime timestamp, length long, content binary"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Lines:
    """seek() and readline() over an Arrow file, buffered; fetched counts the bytes taken from the store."""

    def __init__(self, raw: pa.NativeFile, chunk: int = 1 << 20) -> None:
        self.raw, self.chunk, self.kept, self.at, self.fetched = raw, chunk, b"", 0, 0

    def seek(self, at: int) -> None:
        self.raw.seek(at)
        self.kept, self.at = b"", 0

    def readline(self) -> bytes:
        pieces, found = [], self.kept.find(b"\n", self.at)
        while found < 0:
            pieces.append(self.kept[self.at :])
            self.kept, self.at = self.raw.read(self.chunk), 0
            self.fetched += len(self.kept)
            if not self.kept:
                return b"".join(pieces)
            found = self.kept.find(b"\n")
        pieces.append(self.kept[self.at : found + 1])
        self.at = found + 1
        return b"".join(pieces)


def listed(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path and length of every file that is not empty; the listing is Spark's own, contents are not read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return named(reader.load(path))


def named(files: DataFrame) -> DataFrame:
    return files.select(F.col("_metadata.file_path").alias("path"), "length").where(F.col("length") > 0)


def ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """files (path, length) -> path, start, end of their ranges of at most split_bytes."""
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return cut.select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))
