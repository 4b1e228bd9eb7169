"""What a task does with SLOW5 files: heads of files, records of byte ranges, fields and samples.

A range holds the records that begin in it. Every range reads the head of its own file first, up to the first record, so
columns are found by the names that this file gives them and nothing about files passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .files import Lines, open_fs

#: Fixed value of the format: a value that is not there.
MISSING = "."
HEAD_BYTES = 1 << 14
BATCH_BYTES = 16 << 20
BATCH_ROWS = 10_000

#: Fixed values of the format: integer types, their Spark type, smallest and largest value.
INTEGERS = {
    "int8_t": ("tinyint", -(2**7), 2**7 - 1),
    "uint8_t": ("smallint", 0, 2**8 - 1),
    "int16_t": ("smallint", -(2**15), 2**15 - 1),
    "uint16_t": ("int", 0, 2**16 - 1),
    "int32_t": ("int", -(2**31), 2**31 - 1),
    "uint32_t": ("bigint", 0, 2**32 - 1),
    "int64_t": ("bigint", -(2**63), 2**63 - 1),
    "uint64_t": ("bigint", 0, 2**63 - 1),
}
WIDE = ("decimal(20,0)", 0, 2**64 - 1)
_ARROW = {"string": pa.string(), "double": pa.float64(), "float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
_WHOLE = re.compile(rb"[+-]?[0-9]+")


class Corrupt(ValueError):
    """A record that cannot be read."""


def spark_type(kind: str, wide: bool = False) -> str:
    """wide: 64-bit unsigned integers as decimals, which hold all of them; as longs, those from 2^63 on are corrupt."""
    if kind.startswith("enum{") or kind == "char*":
        return "string"
    if kind.endswith("*"):
        return f"array<{spark_type(kind[:-1], wide)}>"
    if kind in ("float", "double"):
        return kind
    if kind == "uint64_t" and wide:
        return WIDE[0]
    if kind not in INTEGERS:
        raise ValueError(f"no such SLOW5 type: {kind}")
    return INTEGERS[kind][0]


def arrow_type(of: str) -> pa.DataType:
    return pa.list_(_ARROW[of[6:-1]]) if of.startswith("array<") else _ARROW[of]


@dataclass
class Head:
    """The lines of a file before its first record."""

    names: str | None = None
    kinds: str | None = None
    one: bool = True  # whether the lines that name columns agree
    attributes: list[tuple[str, list[str | None]]] = field(default_factory=list)


def read_head(lines: Lines) -> Head:
    """The head of the file that lines stand at the beginning of."""
    head = Head()
    while line := lines.readline():
        text = line.rstrip(b"\r\n")
        if text.startswith(b"@"):
            attr, *values = text[1:].decode().split("\t")
            head.attributes.append((attr, [None if v == MISSING else v for v in values]))
        elif text.startswith(b"#"):
            take_names(head, text[1:].decode())
        elif text:
            break
    return head


def take_names(head: Head, text: str) -> None:
    """A line after its #; one that names columns or types otherwise than a line before it makes the head disagree."""
    for attr, begins in (("names", "read_id"), ("kinds", "char*")):
        if text == begins or text.startswith(begins + "\t"):
            head.one &= getattr(head, attr) in (None, text)
            setattr(head, attr, text)


def head_of(path: str, chunk: int = HEAD_BYTES) -> tuple[Head, int]:
    """The head of a file, and how many bytes it took."""
    store, at = open_fs(path)
    with store.open_input_file(at) as raw:
        lines = Lines(raw, chunk)
        return read_head(lines), lines.fetched


def columns_of(names: str, kinds: str) -> dict[str, str]:
    n, k = names.split("\t"), kinds.split("\t")
    if len(n) != len(k) or len(set(n)) != len(n):
        raise ValueError(f"a SLOW5 header has {len(n)} names, {len(set(n))} of them different, and {len(k)} types")
    return dict(zip(n, k, strict=True))


def whole_numbers(text: bytes, low: int, high: int) -> np.ndarray:
    """Integers between commas, all at once; anything else is corrupt."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(text, np.uint8)
    comma = np.flatnonzero(b == 44)
    start, end = np.r_[0, comma + 1], np.r_[comma, len(b)]
    minus = b[np.minimum(start, len(b) - 1)] == 45
    size = end - start - minus
    if size.min() < 1 or size.max() > 18 or np.count_nonzero((b >= 48) & (b <= 57)) + len(comma) + np.count_nonzero(minus) != len(b):
        raise Corrupt("not a list of whole numbers")
    value, ten = np.zeros(len(start), np.int64), 1
    for k in range(int(size.max())):
        value += np.where(k < size, b[np.maximum(end - 1 - k, 0)].astype(np.int64) - 48, 0) * ten
        ten *= 10
    value = np.where(minus, -value, value)
    if value.min() < low or value.max() > high:
        raise Corrupt("a number that its type does not hold")
    return value


def parser(kind: str, wide: bool = False) -> Callable[[bytes], object]:
    """Text of a field that is there -> its value."""
    if kind == "char*":
        return bytes.decode
    if kind.startswith("enum{"):
        labels = kind[5:-1].split(",")

        def label(text: bytes) -> str:
            if not _WHOLE.fullmatch(text) or not 0 <= int(text) < len(labels):
                raise Corrupt("no such label")
            return labels[int(text)]

        return label
    if kind in ("float", "double"):

        def number(text: bytes) -> float:
            if b"_" in text:
                raise Corrupt("not a number")
            return float(text)

        return number
    if kind.endswith("*"):
        each = kind[:-1]
        if each in INTEGERS and each not in ("uint64_t", "int64_t"):
            _, low, high = INTEGERS[each]
            return lambda text: whole_numbers(text, low, high)
        one = parser(each, wide)
        return lambda text: [one(x) for x in text.split(b",")] if text else []
    _, low, high = WIDE if kind == "uint64_t" and wide else INTEGERS[kind]

    def integer(text: bytes) -> int:
        if not _WHOLE.fullmatch(text) or not low <= int(text) <= high:
            raise Corrupt("no number of its type")
        return int(text)

    return integer


class Layout:
    """The columns of one file: reads a record's fields by name."""

    def __init__(self, columns: dict[str, str], wide: bool = False) -> None:
        if lost := {"read_id", "len_raw_signal", "raw_signal"} - columns.keys():
            raise ValueError(f"a SLOW5 header lacks {', '.join(sorted(lost))}")
        self.columns, self.names = columns, list(columns)
        self.parsers = [parser(k, wide) for k in columns.values()]

    def __call__(self, line: bytes) -> dict[str, object]:
        """Values by name, null for missing ones; every field is looked at, whichever are wanted."""
        fields = line.split(b"\t")
        if len(fields) != len(self.names):
            raise Corrupt(f"{len(fields)} fields in place of {len(self.names)}")
        try:
            row = {n: None if text == b"." else parse(text) for n, text, parse in zip(self.names, fields, self.parsers, strict=True)}
        except ValueError as e:
            raise Corrupt(str(e)) from e
        if row["raw_signal"] is None or len(row["raw_signal"]) != row["len_raw_signal"]:
            raise Corrupt("another number of samples than it says")
        return row


def range_lines(lines: Lines, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Position and text of the lines that begin in a range."""
    at = max(0, start - 1)
    lines.seek(at)
    if start:
        at += len(lines.readline())  # the line that begins before start is another range's
    while at < end and (line := lines.readline()):
        yield at, line.rstrip(b"\r\n")
        at += len(line)


class Scan:
    """Ranges of files -> Arrow batches of path, position, the wanted columns and, if flagged, _corrupt.

    columns: wanted names with their types; a file that lacks one has nulls there, one that has it in another type is an
    error. alone: the columns of files without a header, if there are any to take.
    """

    def __init__(self, columns: dict[str, str], alone: dict[str, str] | None, flag: bool, wide: bool) -> None:
        self.columns, self.alone, self.flag, self.wide = columns, alone, flag, wide
        self.types = {n: arrow_type(spark_type(k, wide)) for n, k in columns.items()}

    def layout(self, path: str, head: Head) -> Layout:
        if head.names is None and head.kinds is None:
            if self.alone is None:
                raise ValueError(f"no SLOW5 header line names the columns: {path}")
            return Layout(self.alone, self.wide)
        if head.names is None or head.kinds is None or not head.one:
            raise ValueError(f"a SLOW5 header names its columns in part or in several ways: {path}")
        found = columns_of(head.names, head.kinds)
        for n in self.columns.keys() & found.keys():
            if spark_type(found[n], self.wide) != spark_type(self.columns[n], self.wide):
                raise ValueError(f"SLOW5 headers disagree about the type of {n}: {self.columns[n]} and {found[n]}")
        return Layout(found, self.wide)

    def records(self, path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, object] | None]]:
        """Position and values of a range's records; None for corrupt ones, which are errors unless flagged."""
        store, at = open_fs(path)
        with store.open_input_file(at) as raw:
            head = read_head(Lines(raw, HEAD_BYTES))
            layout = self.layout(path, head)
            for position, text in range_lines(Lines(raw), start, end):
                if not text or text[:1] == b"@":
                    continue
                if text[:1] == b"#":
                    take_names(head, text[1:].decode())
                    if not head.one:
                        raise ValueError(f"a SLOW5 header names its columns in part or in several ways: {path}")
                    continue
                try:
                    yield position, layout(text)
                except Corrupt as e:
                    if not self.flag:
                        raise ValueError(f"not a SLOW5 record ({e}) at byte {position} of {path}: {text[:80]!r}") from e
                    yield position, None

    def batch(self, paths: list[str], positions: list[int], rows: list[dict[str, object] | None]) -> pa.RecordBatch:
        arrays = [pa.array(paths, pa.string()), pa.array(positions, pa.int64())]
        for n, kind in self.types.items():
            values = [None if r is None else r.get(n) for r in rows]
            if pa.types.is_list(kind) and any(isinstance(v, np.ndarray) for v in values):
                sizes = np.array([0 if v is None else len(v) for v in values])
                flat = np.concatenate([v for v in values if v is not None]).astype(kind.value_type.to_pandas_dtype())
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind.value_type), mask=pa.array([v is None for v in values])))
            else:
                arrays.append(pa.array(values, kind))
        if self.flag:
            arrays.append(pa.array([r is None for r in rows], pa.bool_()))
        return pa.RecordBatch.from_arrays(arrays, ["path", "position", *self.types, *(["_corrupt"] if self.flag else [])])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, positions, rows, held = [], [], [], 0
        for b in batches:
            for path, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                for position, row in self.records(path, start, end):
                    paths.append(path)
                    positions.append(position)
                    rows.append(row and {n: row.get(n) for n in self.types})
                    held += 200 + (row["len_raw_signal"] * 8 if row and "raw_signal" in self.types else 0)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self.batch(paths, positions, rows)
                        paths, positions, rows, held = [], [], [], 0
        if rows:
            yield self.batch(paths, positions, rows)

    def schema(self) -> str:
        return ", ".join(["path string", "position long", *(f"`{n}` {spark_type(k, self.wide)}" for n, k in self.columns.items()), *(["_corrupt boolean"] if self.flag else [])])


HEADS = "path string, length long, names string, kinds string, one boolean, attributes array<struct<attr:string,values:array<string>>>, head_bytes long"
_ATTRIBUTES = pa.list_(pa.struct([("attr", pa.string()), ("values", pa.list_(pa.string()))]))


def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, length) -> HEADS; a file is read up to its first record."""
    for b in batches:
        found = [head_of(p) for p in b.column("path").to_pylist()]
        attributes = [[{"attr": a, "values": v} for a, v in h.attributes] for h, _ in found]
        columns = [pa.array([getattr(h, c) for h, _ in found], t) for c, t in (("names", pa.string()), ("kinds", pa.string()), ("one", pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), *columns, pa.array(attributes, _ATTRIBUTES), pa.array([n for _, n in found], pa.int64())], ["path", "length", "names", "kinds", "one", "attributes", "head_bytes"])
