"""WARC archives as a PySpark data source, and pages deduplicated into response and revisit records.

The reader plans one partition a file, the writer starts another file once one is large, so no partition grows with the
table. Predicates on record_type and on header columns are pushed to the reader: files that were written for other record
types are not opened; of the others it parses a record's headers first, and passes over the payload of a record that they rule
out: a member that the writer made says how long it is, so it is neither inflated nor read, nor are payloads in plain archives; only
gzip members of others are inflated to find their ends. Archives are gzip files of one member a record or plain. Headers are
read as they stand, so archives of others come out unaltered; in what is written, line ends within a value are percent-encoded,
as no header can hold them. An archive that ends inside a record, also inside its headers, is an error.

Revisits are found without html: rows are reduced to (page_id, digest) first, and what a page's record is follows from these.
Most rows with html are then written where they are read: a bitmap of bounded size tells those that cannot be revisits, and only
what it leaves open is shuffled.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNull, WriterCommitMessage

from .common import fresh_path, pick, table, written

VERSION = b"WARC/1.1"
FILE_BYTES = 32 << 20
CHUNK = 1 << 18
PIECE = 1 << 14
#: A gzip header with one extra field, this library's own: the length of the whole member in eight bytes.
MEMBER_HEAD = struct.Struct("<10sH2sHQ")
LENGTH_FIELD = b"SL"
LEAST_PAYLOAD = 100
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format: what a revisit that was found by its payload's digest declares.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A sieve has this many bits for each key, and in all no more than 2 ** MOST_BITS: 16 MB.
BITS_PER_KEY = 16
MOST_BITS = 27

#: Column and header of what the source reads; payload is the content block. The last three are this library's own.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "profile": "WARC-Profile",
    "content_type": "Content-Type",
    "page_id": "X-Page-ID",
    "refers_to_page": "X-Refers-To-Page-ID",
    "full_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def header_value(value: str) -> str:
    """In one header line: line ends are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, payload: bytes) -> bytes:
    lines = [VERSION, *(f"{HEADERS[k]}: {header_value(str(v))}".encode() for k, v in row.items() if k in HEADERS and v is not None), f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as one gzip member that says in its extra field how long it is, so that a reader can pass over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = MEMBER_HEAD.size + len(body) + 8
    head = MEMBER_HEAD.pack(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", 12, LENGTH_FIELD, 8, whole)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Stream:
    """Bytes of a plain or gzip archive in order, with a bounded buffer; inflated piece by piece, only as far as they are asked for."""

    def __init__(self, raw: io.RawIOBase) -> None:
        self.raw, self.kept, self.ended, self.inside = raw, bytearray(), False, False
        self.ahead, self.at = b"", 0  # bytes of the archive that are read but not used, and how many are used
        self.inflated = 0
        self._read()
        self.inflate = zlib.decompressobj(31) if self.ahead[:2] == b"\x1f\x8b" else None
        self.begin, self.length = 0, None  # of the member: the place of its first byte, and the length it says

    def _read(self) -> None:
        self.ahead = self.raw.read(CHUNK)
        self.ended = not self.ahead

    def _use(self, n: int) -> None:
        self.ahead, self.at = self.ahead[n:], self.at + n

    def _more(self) -> None:
        """Puts more bytes to kept, or finds the end."""
        if not self.ahead:
            self._read()
        if self.ended:
            if self.inside:
                raise ValueError("the archive ends inside a gzip member")
            return
        if not self.inflate:
            self.kept += self.ahead
            self._use(len(self.ahead))
            return
        if not self.inside:
            if len(self.ahead) < MEMBER_HEAD.size:
                self.ahead += self.raw.read(MEMBER_HEAD.size)
            self.begin, self.length, self.inside = self.at, said_length(self.ahead), True
            self.inflated_before = self.inflated
        out = self.inflate.decompress(self.ahead, PIECE)
        self.kept += out
        self.inflated += len(out)
        left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self._use(len(self.ahead) - len(left))
        if self.inflate.eof:
            self.inflate, self.inside = zlib.decompressobj(31), False

    def line(self) -> bytes | None:
        """Without its line end; None at the end of the archive."""
        looked = 0
        while (i := self.kept.find(b"\n", looked)) < 0 and not self.ended:
            looked = len(self.kept)
            self._more()
        if i < 0:
            if self.kept.strip():
                raise ValueError("the archive ends inside a line")
            return None
        found = bytes(self.kept[:i]).rstrip(b"\r")
        del self.kept[: i + 1]
        return found

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        out = bytearray()
        while n:
            if not self.kept:
                if self.ended:
                    raise ValueError("the archive ends inside a record")
                self._more()
            part = self.kept[:n]
            out += part
            n -= len(part)
            del self.kept[: len(part)]
        return bytes(out)

    def skip(self, n: int) -> None:
        """Passes over the next n bytes: by place in a plain archive, by its length where they end a member that says it."""
        if self.inflate and self.inside and self.length and n >= len(self.kept):
            size = self.inflated - self.inflated_before - len(self.kept) + n  # of the member's content, if the bytes end it
            if self._to(self.begin + self.length - 8, 8) and int.from_bytes(self.ahead[4:8], "little") == size & 0xFFFFFFFF:
                self._use(8)
                self.kept.clear()
                self.inflate, self.inside = zlib.decompressobj(31), False
                return
            raise ValueError("a gzip member is not as long as it says")
        if not self.inflate:
            n -= (held := min(n, len(self.kept)))
            del self.kept[:held]
            if n and not self._to(self.at + n - 1, 1):
                raise ValueError("the archive ends inside a record")
            self._use(1 if n else 0)
            return
        while n:
            n -= len(self.take(min(n, PIECE)))

    def _to(self, place: int, needed: int) -> bool:
        """Goes on to a place of the archive, without reading what is between; whether so many bytes are there."""
        if place - self.at < len(self.ahead):
            self._use(place - self.at)
        else:
            self.raw.seek(place)
            self.ahead, self.at = b"", place
        if len(self.ahead) < needed:
            self.ahead += self.raw.read(CHUNK)
        return len(self.ahead) >= needed


def said_length(head: bytes) -> int | None:
    """The length in the extra field of a gzip member that member() made."""
    if len(head) < MEMBER_HEAD.size or not head[3] & 4:
        return None
    _, _, name, size, length = MEMBER_HEAD.unpack_from(head)
    return length if name == LENGTH_FIELD and size == 8 else None


def headers(stream: Stream) -> dict[str, str]:
    """Up to the empty line, names in lower case; a line that begins with white space carries on the one before."""
    found: dict[str, str] = {}
    last = None
    while line := stream.line():
        if line[:1] in b" \t" and last is not None:
            found[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:60]!r}")
        last = name.strip().lower()
        found[last] = value.strip(" \t")
    if line is None:
        raise ValueError("the archive ends inside a record's headers")
    return found


def records(stream: Stream, wanted: Iterable[tuple[str, tuple]], payload: bool) -> Iterator[dict]:
    """Records whose headers meet wanted: (column, allowed values) each; with payload None unless asked for."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        found = headers(stream)
        if not found.get("content-length", "").isdigit():
            raise ValueError(f"a record without a length: {found.get('warc-record-id')}")
        row = {c: found.get(h.lower()) for c, h in HEADERS.items()}
        keep = all(row[c] in allowed for c, allowed in wanted)
        row["payload"], n = None, int(found["content-length"])
        if keep and payload:
            row["payload"] = stream.take(n)
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError(f"a record is not as long as it says: {found.get('warc-record-id')}")
        else:
            stream.skip(n + 4)
        if keep:
            yield row


def file_name(record_type: str) -> str:
    """Tells that all records of the file have one type."""
    return f"part-{uuid.uuid4().hex}.only-{record_type}.warc.gz"


def types_of(path: str) -> str | None:
    """The record type of all records, where file_name() gave the name."""
    found = re.search(r"\.only-([a-z]+)\.warc\.gz$", path)
    return found[1] if found else None


@dataclass
class FilePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, IN and null tests on header columns; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | EqualNullSafe):
                self.wanted.append((column, (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, tuple(v for v in f.value if v is not None)))
            elif column in HEADERS and isinstance(f, IsNull):
                self.wanted.append((column, (None,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One a file, in name order, without files whose records all have another type than is wanted."""
        store, root = open_fs(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else "file://"
        host = self.path.partition("://")[2].partition("/")[0] if scheme not in ("file://",) and "://" in self.path else ""
        asked = [allowed for c, allowed in self.wanted if c == "record_type"]
        kept = lambda f: f.endswith((".warc", ".warc.gz")) and all(types_of(f) in (None, *allowed) for allowed in asked)
        return [FilePartition(f"{scheme}{host}{f.path}" if host and not f.path.startswith(host) else f"{scheme}{f.path}") for f in sorted(found, key=lambda x: x.path) if f.is_file and kept(f.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "payload"]
        kinds = [pa.string()] * len(HEADERS) + [pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
        if partition is None or not hasattr(partition, "path"):  # no file at all
            return
        store, at = open_fs(partition.path)
        with store.open_input_file(at) as raw:
            rows, size = [], 0
            for r in records(Stream(raw), self.wanted, self.payload):
                rows.append(r)
                size += len(r["payload"] or b"")
                if len(rows) >= 1000 or size >= 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int) -> None:
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        files, open_files = [], {}  # by record type: the stream and how much it has
        for b in iterator:
            for row in b.to_pylist():
                kind = re.sub("[^a-z]", "", str(row["record_type"]))
                out, size = open_files.get(kind, (None, FILE_BYTES))
                if size >= FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"{root}/{file_name(kind)}.tmp")
                    out, size = store.open_output_stream(files[-1], compression=None), 0
                data = member(record_bytes(row, row["payload"] or b""), self.level)
                out.write(data)
                open_files[kind] = out, size + len(data)
        for out, _ in open_files.values():
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only files of successful tasks get their final names; those of lost ones stay invisible to the reader."""
        store, root = open_fs(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        for f in files:
            store.move(f, f.removesuffix(".tmp"))
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps(len(files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = open_fs(self.path)
        for f in [f for m in messages if m for f in m.files]:
            store.delete_file(f)


class WarcSource(DataSource):
    """spark.read.format("warc").load(dir), df.write.format("warc").mode("append").save(dir).

    Options: payload=false reads headers only; level is the gzip level of what is written.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", "1")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def sieve(keys: DataFrame, bits: int) -> DataFrame:
    """keys (h long) -> a bitmap of 2 ** bits bits in rows of 4 KB, with the bit of each key set."""
    at = F.pmod("h", F.lit(1 << bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_map"))


def sieved(rows: DataFrame, found: DataFrame, bits: int, name: str) -> DataFrame:
    """rows (h, ...) with whether the bit of h is set; where it is not, h is none of the keys."""
    at = F.pmod("h", F.lit(1 << bits)) + 1
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    met = rows.withColumn("_b", F.bitmap_bucket_number(at)).join(F.broadcast(found), F.col("_b") == F.col("_bucket"), "left")
    return met.select(*rows.columns, bit.alias(name))


def bits_for(keys: int) -> int:
    return max(15, min(MOST_BITS, (keys * BITS_PER_KEY).bit_length()))


def record_id(*parts: Column) -> Column:
    """A name-based UUID of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-a$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, least: int = LEAST_PAYLOAD, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) -> the records to write; date is that of the crawl, which pages do not have.

    Equal payloads of at least `least` bytes have one response, that of the smallest page_id (repeated rows of that page are
    responses too, a null page_id is the largest); the others revisit it without a payload. Null html is an empty payload.
    Every record has an id of its own; a revisit refers to that of the first response, by page_id, in WARC-Refers-To.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest")).withColumn("h", F.xxhash64("page_id", "digest"))
    keys = written(rows.select("page_id", "url", "n", "digest", "h", F.monotonically_increasing_id().alias("row")), "page-keys")
    # aggregates are written before they are joined, as only then can the rows of a hot digest be split
    first = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    again = keys.groupBy("h", "page_id", "digest").agg(F.min("row").alias("first_row"), F.count("*").alias("rows")).where("rows > 1")
    first, again = written(first.select(F.col("digest").alias("_digest"), "first_id"), "first-pages"), written(again.select(F.col("h").alias("_h"), F.col("page_id").alias("_page"), F.col("digest").alias("_d"), "first_row"), "repeated-pages")
    told = keys.join(first, F.col("digest") == F.col("_digest"), "left").join(again, (F.col("h") == F.col("_h")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_d")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    told = written(told.select("page_id", "url", "n", "digest", "h", "row", "first_id", "first_row", revisit.alias("revisit")), "page-states")

    def record(kind: str, refers: Column, refers_page: Column, own: Column, payload: Column) -> list[Column]:
        return [
            own.alias("record_id"),
            F.lit(kind).alias("record_type"),
            F.col("url").alias("target_uri"),
            F.lit(date).alias("date"),
            F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
            refers.cast("string").alias("refers_to"),
            F.lit(PROFILE if kind == "revisit" else None).cast("string").alias("profile"),
            F.lit("text/html; charset=utf-8").alias("content_type"),
            F.col("page_id").cast("string").alias("page_id"),
            refers_page.cast("string").alias("refers_to_page"),
            F.col("n").cast("string").alias("full_length"),
            payload.alias("payload"),
        ]

    nothing = F.lit(None)
    plain = record_id(F.col("page_id"), F.col("digest"))
    # of a page's repeated rows the first has the plain id, the others add their row
    own = F.when(F.col("first_row").isNull() | (F.col("first_row") == F.col("row")), plain).otherwise(record_id(F.col("page_id"), F.col("digest"), F.col("row")))
    visits = told.where("revisit").select(*record("revisit", record_id(F.col("first_id"), F.col("digest")), F.col("first_id"), own, F.lit(None).cast("binary")))
    # what is neither a revisit nor repeated needs nothing but its html: rows that the sieve of all others leaves out are such
    special = written(told.where("revisit or first_row is not null").select("h").distinct(), "special-keys")
    count = special.count()
    if not count:
        return rows.select(*record("response", nothing, nothing, plain, F.col("payload")))
    bits = bits_for(count)
    others = written(sieve(special, bits), "sieve")
    looked = sieved(rows, others, bits, "caught")
    direct = looked.where("not caught").select(*record("response", nothing, nothing, plain, F.col("payload")))
    # responses that it caught: repeated pages, and some by chance; a second sieve finds their html, which alone is shuffled
    caught = written(sieved(told.where("not revisit"), others, bits, "caught").where("caught").drop("caught"), "caught-pages")
    needed = caught.select("h").distinct()
    again_bits = bits_for(needed.count())
    there = sieved(looked.where("caught"), written(sieve(needed, again_bits), "sieve"), again_bits, "needed").where("needed").select(F.col("h").alias("_h"), F.col("digest").alias("_d"), F.col("page_id").alias("_page"), "payload")
    there = there.dropDuplicates(["_h", "_d", "_page"])
    kept = caught.join(there, (F.col("h") == F.col("_h")) & (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_page")))
    return direct.unionByName(kept.select(*record("response", nothing, nothing, own, F.col("payload")))).unionByName(visits)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The archives of page_records(): page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from the payload read back, a revisit's from its headers.
    """
    read = lambda kind, payload: spark.read.format("warc").option("payload", payload).load(path).where(F.col("record_type") == kind)
    number = lambda c: F.col(c).cast("long").alias(c)
    full = read("response", "true").select(number("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    brief = read("revisit", "false").select(number("page_id"), F.col("full_length").cast("long").alias("payload_bytes"), F.substring("payload_digest", len("sha256:") + 1, 64).alias("payload_digest"), "record_type", F.col("refers_to_page").cast("long").alias("refers_to"))
    return full.unionByName(brief)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = fresh_path(spark, "warc")
    page_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    return read_pages(spark, path)
