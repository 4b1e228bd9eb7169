"""SLOW5 text files: reads, header attributes, directories of runs.

Files are read by byte ranges (slow5_scan), each with the header of its own file; parse() does the same for lines in a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import written
from .files import listed, ranges
from .slow5_scan import HEADS, MISSING, Scan, columns_of, heads, spark_type

#: Fixed values of the format: columns and their types, in file order.
COLUMNS = {
    "read_id": "char*",
    "read_group": "uint32_t",
    "digitisation": "double",
    "offset": "double",
    "range": "double",
    "sampling_rate": "double",
    "len_raw_signal": "uint64_t",
    "raw_signal": "int16_t*",
    "end_reason": "enum{unknown,partial,mux_change,unblock_mux_change,signal_positive,signal_negative}",
    "channel_number": "char*",
    "median_before": "double",
    "read_number": "int32_t",
    "start_mux": "uint8_t",
    "start_time": "uint64_t",
}
#: Rows of attributes or of files up to this many go to every task; more are joined by shuffle.
FEW_ROWS = 100_000
#: Bytes of a range.
SPLIT_BYTES = 32 << 20
RUN_FILES = "*.{slow5,txt}"


def lines(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """value and path of every line; splittable by line."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", RUN_FILES) if recursive else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def layouts(text: DataFrame) -> tuple[list[dict[str, str]], DataFrame]:
    """The headers of lines (value, path): each layout's columns with their types, and a table path, layout (its number).

    Few layouts as a rule; of files, the driver gets none. A file whose header names no columns, or names them twice in
    different ways, is an error.
    """
    head = text.where(F.startswith("value", F.lit("#read_id")) | F.startswith("value", F.lit("#char*")))
    name = F.when(F.startswith("value", F.lit("#read_id")), F.substring("value", 2, 1 << 20))
    kind = F.when(F.startswith("value", F.lit("#char*")), F.substring("value", 2, 1 << 20))
    agree = F.coalesce((F.min(name) == F.max(name)) & (F.min(kind) == F.max(kind)), F.lit(False))
    files = written(head.groupBy("path").agg(F.min(name).alias("names"), F.min(kind).alias("kinds"), agree.alias("one")), "layouts")
    found = files.groupBy("names", "kinds", "one").agg(F.min("path").alias("path")).orderBy("names", "kinds").collect()
    if not found or not all(r["one"] for r in found):
        raise ValueError("no SLOW5 header line names the columns" if not found else f"a SLOW5 header names its columns in part or in several ways: {next(r['path'] for r in found if not r['one'])}")
    number = F.coalesce(*[F.when((F.col("names") == r["names"]) & (F.col("kinds") == r["kinds"]), F.lit(k)) for k, r in enumerate(found)])
    return [columns_of(r["names"], r["kinds"]) for r in found], files.select("path", number.alias("layout"))


def parse(text: DataFrame, columns: dict[str, str] | None = None, mode: str = "failfast") -> DataFrame:
    """Lines (value, and any other columns) -> one row a record, columns found by name.

    Without columns the lines need a column path: each file's own header names its columns, whatever their order there, and
    a column that a file lacks is null. Types that are not the same in all files are an error.
    failfast: a record that cannot be read ends the job, whichever columns are asked for. flag: it gives a row of nulls with
    _corrupt true. "." is null; an empty raw signal is an empty array; enum ordinals become their labels.
    """
    if columns is not None:
        return parse_as(text, columns, mode)
    found, files = layouts(text)
    if len(found) == 1:
        return parse_as(text, found[0], mode)
    kinds: dict[str, str] = {}
    for names in found:
        for n, k in names.items():
            if spark_type(kinds.setdefault(n, k)) != spark_type(k):
                raise ValueError(f"SLOW5 headers disagree about the type of {n}: {kinds[n]} and {k}")
    others = [c for c in text.columns if c != "value"]
    files = files.toDF("_path", "_layout")
    laid = text.join(F.broadcast(files) if files.count() <= FEW_ROWS else files, F.col("path") == F.col("_path"))
    whole: DataFrame | None = None
    for number, names in enumerate(found):
        own = F.when(F.col("_layout") == number, F.col("value"))  # null, not filtered, so that no check of fields goes below the join
        part = parse_as(laid.withColumn("value", own).drop("_path", "_layout"), names, mode)
        part = part.select(*others, *[F.col(c) if c in names else F.lit(None).cast(spark_type(k)).alias(c) for c, k in kinds.items()], *(["_corrupt"] if mode == "flag" else []))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def parse_as(text: DataFrame, columns: dict[str, str], mode: str) -> DataFrame:
    """parse() of lines that all have these columns in this order."""
    records = text.where(F.col("value").isNotNull() & ~F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    records = records.withColumn("_f", F.split("value", "\t", -1))
    others = [c for c in text.columns if c != "value"]

    def field(i: int, kind: str) -> Column:
        raw = F.nullif(F.get(F.col("_f"), F.lit(i)), F.lit(MISSING))
        if kind.startswith("enum{"):
            labels = F.array(*[F.lit(x) for x in kind[5:-1].split(",")])
            return F.get(labels, raw.try_cast("int"))
        if kind.endswith("*") and kind != "char*":
            return F.when(raw == "", F.array().cast(spark_type(kind))).otherwise(F.transform(F.split(raw, ","), lambda x: x.try_cast(spark_type(kind[:-1]))))
        return raw.try_cast(spark_type(kind))

    parsed = records.select(*others, F.col("value"), F.col("_f"), *[field(i, kind).alias(name) for i, (name, kind) in enumerate(columns.items())])
    wrong = F.size("_f") != len(columns)
    for i, (name, kind) in enumerate(columns.items()):
        given = F.get(F.col("_f"), F.lit(i))
        wrong = wrong | F.coalesce(F.col(name).isNull() & (given != MISSING), F.lit(True))
        if kind.endswith("*") and kind != "char*":
            wrong = wrong | F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(False))
    wrong = wrong | F.coalesce(F.size("raw_signal") != F.col("len_raw_signal"), F.lit(True))
    if mode == "flag":
        return parsed.select(*others, *[F.when(~wrong, F.col(c)).alias(c) for c in columns], wrong.alias("_corrupt"))
    error = F.raise_error(F.concat(F.lit("not a SLOW5 record: "), F.substring("value", 1, 80))).cast("boolean")
    return parsed.where(F.when(wrong, error).otherwise(F.lit(True))).select(*others, *columns)  # in a filter, so that no plan prunes it


def file_heads(files: DataFrame) -> DataFrame:
    """Files (path, length) -> HEADS: the names and types of columns and the attributes of each, read up to its first record."""
    return files.mapInArrow(heads, HEADS)


def columns_of_files(found: DataFrame) -> tuple[dict[str, str], dict[str, str] | None]:
    """file_heads() -> all columns with their types, and those of files without a header: of the others, if these agree.

    The driver gets a row a layout, no files. Types that are not the same in all files are an error.
    """
    some = found.groupBy("names", "kinds", "one").agg(F.min("path").alias("path")).orderBy("names", "kinds").collect()
    given = [r for r in some if r["names"] is not None or r["kinds"] is not None]
    if not given:
        raise ValueError("no SLOW5 header line names the columns")
    for r in given:
        if not r["one"] or r["names"] is None or r["kinds"] is None:
            raise ValueError(f"a SLOW5 header names its columns in part or in several ways: {r['path']}")
    columns: dict[str, str] = {}
    for r in given:
        for n, k in columns_of(r["names"], r["kinds"]).items():
            if spark_type(columns.setdefault(n, k)) != spark_type(k):
                raise ValueError(f"SLOW5 headers disagree about the type of {n}: {columns[n]} and {k}")
    if len(given) < len(some) and len(given) > 1:
        raise ValueError(f"a SLOW5 file without a header, and several layouts beside it: {next(r['path'] for r in some if r not in given)}")
    return columns, columns_of(given[0]["names"], given[0]["kinds"]) if len(given) == 1 else None


def scan(files: DataFrame, mode: str = "failfast", only: list[str] | None = None, wide: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files (path, length) -> path, position and the columns of their records, all or those of only.

    Ranges are dealt out evenly, so many small files make few tasks and a large one makes many. Every field of every record
    is looked at; an array is built only where it is wanted.
    """
    columns, alone = columns_of_files(file_heads(files))
    if only is not None:
        if lost := [c for c in only if c not in columns]:
            raise ValueError(f"no SLOW5 header names {', '.join(lost)}")
        columns = {c: columns[c] for c in only}
    work = Scan(columns, alone, mode == "flag", wide)
    n_bytes = files.agg(F.sum("length")).first()[0] or 0
    return ranges(files, split_bytes).repartition(max(1, -(-n_bytes // split_bytes))).mapInArrow(work, work.schema())


def read_slow5(spark: SparkSession, path: str | list[str], mode: str = "failfast", positions: bool = False, only: list[str] | None = None, wide: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The reads of a file or directory, with the file's path.

    positions: with the byte at which a record begins, so (path, position) is the order of the files. only: these columns and
    no others; without raw_signal no samples leave the reader. wide: unsigned 64-bit integers as decimals. mode as in parse().
    """
    found = scan(listed(spark, path), mode, only, wide, split_bytes)
    return found if positions else found.drop("position")


def read_runs(spark: SparkSession, directory: str, mode: str = "failfast", positions: bool = False, only: list[str] | None = None, wide: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every file below directory as one job, with path and run: the name of the file's folder, without run= before it."""
    found = scan(listed(spark, directory, recursive=True, glob=RUN_FILES), mode, only, wide, split_bytes)
    run = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^run=", "")
    return found.select("path", run.alias("run"), *(["position"] if positions else []), *found.columns[2:])


def read_header(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """path, read_group, attr, value of every file, as header_attributes(); files are read up to their first record only."""
    found = file_heads(listed(spark, path, recursive, RUN_FILES if recursive else None))
    rows = found.select("path", F.explode("attributes").alias("a")).select("path", F.col("a.attr").alias("attr"), F.posexplode("a.values").alias("g", "value"))
    return rows.select("path", F.col("g").cast("bigint").alias("read_group"), "attr", "value")


def header_attributes(text: DataFrame) -> DataFrame:
    """Lines (value, path) -> path, read_group, attr, value: one row an attribute and read group, "." as null."""
    fields = F.split(F.substring("value", 2, 1 << 20), "\t", -1)
    rows = text.where(F.startswith("value", F.lit("@"))).select("path", F.get(fields, F.lit(0)).alias("attr"), F.posexplode(F.slice(fields, 2, 1 << 20)).alias("g", "v"))
    return rows.select("path", F.col("g").cast("bigint").alias("read_group"), "attr", F.nullif("v", F.lit(MISSING)).alias("value"))


def attach_attributes(reads: DataFrame, header: DataFrame, names: list[str]) -> DataFrame:
    """reads (path, read_group, ...) with one column a header attribute of names.

    Attributes are gathered first, a row a file and read group, and counted: few are broadcast, so no signal moves.
    """
    wide = written(header.where(F.col("attr").isin(names)).groupBy("path", "read_group").agg(*[F.max(F.when(F.col("attr") == n, F.col("value"))).alias(n) for n in names]), "attributes")
    return reads.join(F.broadcast(wide) if wide.count() <= FEW_ROWS else wide, ["path", "read_group"], "left")


def render(reads: DataFrame, columns: dict[str, str] = COLUMNS) -> Column:
    """One record line; columns that reads lacks are missing values."""

    def field(name: str, kind: str) -> Column:
        if name not in reads.columns:
            return F.lit(MISSING)
        if kind.startswith("enum{"):
            labels = F.array(*[F.lit(x) for x in kind[5:-1].split(",")])
            text = (F.array_position(labels, F.col(name)) - 1).cast("string")
        elif kind.endswith("*") and kind != "char*":
            text = F.array_join(F.transform(name, lambda x: x.cast("string")), ",")
        else:
            text = F.col(name).cast("string")
        return F.coalesce(text, F.lit(MISSING))

    return F.concat_ws("\t", *[field(n, k) for n, k in columns.items()])


def write_slow5(reads: DataFrame, path: str, attributes: dict[str, list[str | None]] | None = None, columns: dict[str, str] = COLUMNS) -> None:
    """Text files that each begin with the header; reads with a column run go to run=<run> folders that hold it once each."""
    groups = max([1, *map(len, (attributes or {}).values())])
    head = ["#slow5_version\t0.2.0", f"#num_read_groups\t{groups}", *("\t".join([f"@{a}", *(v or MISSING for v in vs)]) for a, vs in (attributes or {}).items()), "#" + "\t".join(columns.values()), "#" + "\t".join(columns)]
    line, whole = render(reads, columns), F.lit("\n".join(head))
    if "run" in reads.columns:
        headers = reads.select("run").distinct().select(whole.alias("value"), "run")
        reads.select(line.alias("value"), "run").unionByName(headers).write.partitionBy("run").text(path)
        return
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of each task, so of each file
    reads.select(line.alias("line")).select(F.when(first, F.concat(whole, F.lit("\n"), "line")).otherwise(F.col("line")).alias("value")).write.text(path)
