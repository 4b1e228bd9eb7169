"""Media columns: signature sniffing with Aho-Corasick, format validators, type correction and carving.

An automaton over all magic bytes finds every place where a medium may begin; a format's validator then walks its structure
and says how long the medium is, or that there is none. What validates at offset 0 corrects the declared type; what
validates further inside is carved as embedded media. Null content is no bytes: it has no type and nothing to carve.

Validators walk from chunk to chunk, and a walk that comes to where another of its format has been takes that one's outcome;
those that look for an end mark (PDF, ZIP, JPEG) find it among all marks of the content, which are listed once. Magic bytes inside a compressed stream that validated are part of it and are passed over. So sniffing
takes time in proportion to the content, also where it is all magic bytes; only gzip headers set to inflate one another's
stored bytes cost more.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

BLOCK = 64
RATE = 8000
INFLATED = 1 << 16
WINDOW = 16
BATCH_BYTES = 16 << 20
DECLARED = ("audio/wav", "application/octet-stream", "image/png", "audio/wav", "text/plain")
#: What stands inside these is compressed, so magic bytes there mean nothing.
CLOSED_KINDS = frozenset({"application/gzip"})


class Found(NamedTuple):
    offset: int
    length: int
    kind: str


class Content(bytes):
    """Bytes that know where each end mark stands in them."""

    def places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if mark not in known:
            known[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        return known[mark]

    def inflated(self, at: int) -> tuple[int, int, int] | None:
        """Where the deflate stream that begins here ends, checksum and size of what it holds; read in parts, once for each place."""
        known = self.__dict__.setdefault("known", {}).setdefault("inflated", {})
        if at not in known:
            d, p, part, checksum, size = zlib.decompressobj(-15), at, 256, 0, 0
            known[at] = None
            try:
                while not d.eof and (d.unconsumed_tail or p < len(self)):
                    data = d.unconsumed_tail
                    if not data:
                        data, p, part = self[p : p + part], min(len(self), p + part), min(2 * part, INFLATED)
                    out = d.decompress(data, INFLATED)
                    checksum, size = zlib.crc32(out, checksum), size + len(out)
            except zlib.error:
                return None
            if d.eof:
                known[at] = p - len(d.unused_data), checksum, size & 0xFFFFFFFF
        return known[at]

    def directories(self) -> dict[int, list[int]]:
        """ZIP end records by where their archives begin: where the directory's size and offset lead back to."""
        known = self.__dict__.setdefault("known", {})
        if "zip" not in known:
            known["zip"] = {}
            for p in self.places(b"PK\x05\x06"):
                if p + 22 <= len(self):
                    size, start = struct.unpack_from("<II", self, p + 12)
                    begins = p - size - start
                    if begins >= 0 and (not size or self[p - size : p - size + 4] == b"PK\x01\x02"):
                        known["zip"].setdefault(begins, []).append(p)
        return known["zip"]

    def next_place(self, mark: bytes, at: int) -> int:
        """The first place of mark from `at` on, -1 if there is none."""
        found = self.places(mark)
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def walk(self, name: str, at: int, step: Callable[[int], int], ends: Callable[[int], int | None]) -> int:
        """Where a walk from `at` comes to: ends(p) says so where it is over, step(p) is the place after p.

        What a walk is to come to depends on the place alone. It is kept for the first place in each WINDOW bytes that a walk
        passes, so a walk that comes to where another has been takes that one's outcome, a few steps on at most.
        """
        known, passed, window = self.__dict__.setdefault("known", {}).setdefault(name, {}), [], -1
        while (outcome := ends(at)) is None:
            if at // WINDOW != window:
                window = at // WINDOW
                if at in known:
                    outcome = known[at]
                    break
                passed.append(at)
            at = step(at)
        known.update(dict.fromkeys(passed, outcome))
        return outcome

    def chunk_after(self, p: int) -> tuple[int, bool]:
        """Where the RIFF chunk after that at p begins, and whether a byte fills up between them; past all content if none can."""
        if p + 8 > len(self):
            return len(self) + 2, False
        n = int.from_bytes(self[p + 4 : p + 8], "little")
        return p + 8 + n + (n & 1), bool(n & 1)

    def riffs(self) -> dict[int, int]:
        """RIFF headers by place, with the end that they say, of those whose chunks tile what is between exactly.

        Chunks lead on to later ones, whichever header a walk began at. Headers are taken by ascending ends, and a walk leaves
        behind, where it passed, the first place not before its end: a later walk, whose end is no smaller, goes on from there.
        """
        known = self.__dict__.setdefault("known", {})
        if "riff" not in known:
            known["riff"], onward = {}, {}
            said = ((at + 8 + int.from_bytes(self[at + 4 : at + 8], "little"), at) for at in self.places(b"RIFF") if at + 12 <= len(self))
            for end, at in sorted(x for x in said if x[1] + 12 < x[0] <= len(self)):
                p, filled, passed = at + 12, False, []
                while p < end:
                    passed.append(p)
                    p, filled = onward.get(p) or self.chunk_after(p)
                onward.update(dict.fromkeys(passed, (p, filled)))
                if p == end or p == end + 1 and filled:  # the last chunk needs no byte to fill up
                    known["riff"][at] = end
        return known["riff"]

    def format_or_data(self, p: int) -> int:
        """The first chunk from p on that is a WAV's fmt or data; past all content if there is none."""
        over = lambda q: q if q + 8 > len(self) or self[q : q + 4] in (b"fmt ", b"data") else None
        return self.walk("wav", p, lambda q: self.chunk_after(q)[0], over)


def _riff(b: Content, at: int, form: bytes) -> int | None:
    """The length by the RIFF size if the form matches and its chunks tile the content exactly."""
    if b[at + 8 : at + 12] != form or at not in b.riffs():
        return None
    return b.riffs()[at] - at


def wav_length(b: Content, at: int) -> int | None:
    """RIFF chunks in any number and order, but one fmt of 16 bytes or more before one data."""
    if not (n := _riff(b, at, b"WAVE")):
        return None
    first = b.format_or_data(at + 12)
    if first >= at + n or b[first : first + 4] != b"fmt " or int.from_bytes(b[first + 4 : first + 8], "little") < 16:
        return None
    second = b.format_or_data(b.chunk_after(first)[0])
    if second >= at + n or b[second : second + 4] != b"data":
        return None
    return n if b.format_or_data(b.chunk_after(second)[0]) >= at + n else None


def webp_length(b: Content, at: int) -> int | None:
    return _riff(b, at, b"WEBP")


def png_length(b: bytes, at: int) -> int | None:
    """Chunks with right checksums, IHDR first, up to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def gif_length(b: Content, at: int) -> int | None:
    """Screen descriptor, colour tables, blocks and their sub-blocks up to the trailer."""
    if len(b) - at < 14:
        return None
    table_bytes = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    over = lambda p: p + 1 if p >= len(b) or not b[p] else None  # noqa: E731  past the empty sub-block

    def after(p: int) -> int:
        begin = p + 2 if b[p] == 0x21 else p + 11 + table_bytes(b[p + 9])
        return b.walk("gif sub-blocks", begin, lambda q: q + 1 + b[q], over)

    def ends(p: int) -> int | None:
        if p >= len(b) or b[p] not in (0x3B, 0x21, 0x2C) or b[p] == 0x2C and p + 10 > len(b):
            return 0
        return p + 1 if b[p] == 0x3B else None

    end = b.walk("gif", at + 13 + table_bytes(b[at + 10]), after, ends)
    return end - at if end else None


def jpeg_length(b: bytes, at: int) -> int | None:
    """Marker segments by their lengths, then entropy-coded data up to the end marker."""
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if marker == 0xDA:
            end = b.next_place(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else None
    return None


def bmp_length(b: bytes, at: int) -> int | None:
    if len(b) - at < 54:
        return None
    size, reserved, data, header = struct.unpack_from("<IIII", b, at + 2)
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    ok = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and 14 + header <= data <= size <= len(b) - at
    return size if ok else None


def pdf_length(b: Content, at: int) -> int | None:
    end = b.next_place(b"%%EOF", at)
    start = b.next_place(b"startxref", at)
    return end + 5 - at if end > at and at < start < end else None


def gzip_length(b: Content, at: int) -> int | None:
    """A member that inflates with right checksum and size."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, p = b[at + 3], at + 10
    if flags & 4:  # extra field
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags & flag:
            p = b.next_place(b"\0", p) + 1
            if not p:
                return None
    p += 2 if flags & 2 else 0  # checksum of the header
    if found := b.inflated(p):
        end, checksum, size = found
        return end + 8 - at if b[end : end + 8] == struct.pack("<II", checksum, size) else None
    return None


def zip_length(b: Content, at: int) -> int | None:
    """Up to the end record whose central directory begins where it says, counted from here, with as many entries as it says."""
    for p in b.directories().get(at, ()):
        comment = int.from_bytes(b[p + 20 : p + 22], "little")
        if p + 22 + comment <= len(b):
            return p + 22 + comment - at
    return None


def flac_length(b: Content, at: int) -> int | None:
    """Metadata blocks up to the last; the frames have no length, so the stream takes the rest."""
    size = lambda p: int.from_bytes(b[p + 1 : p + 4], "big")

    def ends(p: int) -> int | None:
        if p + 4 > len(b):
            return 0
        if not b[p] & 0x80:
            return None
        q = p + 4 + size(p)
        return int(q + 2 <= len(b) and b[q] == 0xFF and b[q + 1] & 0xFE == 0xF8)

    p = at + 4
    if p + 4 > len(b) or b[p] & 0x7F or size(p) != 34:
        return None
    return len(b) - at if b.walk("flac", p, lambda p: p + 4 + size(p), ends) else None


class Format(NamedTuple):
    magic: bytes
    kind: str
    length: Callable[[Content, int], int | None]


#: The magic bytes of the formats and their media types.
FORMATS = (
    Format(b"RIFF", "audio/wav", wav_length),
    Format(b"RIFF", "image/webp", webp_length),
    Format(b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    Format(b"GIF87a", "image/gif", gif_length),
    Format(b"GIF89a", "image/gif", gif_length),
    Format(b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    Format(b"BM", "image/bmp", bmp_length),
    Format(b"%PDF-", "application/pdf", pdf_length),
    Format(b"\x1f\x8b\x08", "application/gzip", gzip_length),
    Format(b"PK\x03\x04", "application/zip", zip_length),
    Format(b"fLaC", "audio/flac", flac_length),
)


@cache
def automaton() -> ahocorasick.Automaton:
    """Aho-Corasick over the magic bytes, each byte as the character of the same code."""
    by_magic: dict[str, list[Format]] = {}
    for f in FORMATS:
        by_magic.setdefault(f.magic.decode("latin-1"), []).append(f)
    built = ahocorasick.Automaton()
    for magic, formats in by_magic.items():
        built.add_word(magic, (len(magic), formats))
    built.make_automaton()
    return built


def sniff(content: bytes) -> list[Found]:
    """All media in content, outermost first; one that begins inside an already found one is embedded in it and listed too, unless that is compressed."""
    out, data, closed_to = [], Content(content), 0
    for end, (n, formats) in automaton().iter(content.decode("latin-1")):
        at = end - n + 1
        if at < closed_to:
            continue
        for f in formats:
            if length := f.length(data, at):
                out.append(Found(at, length, f.kind))
                if f.kind in CLOSED_KINDS:
                    closed_to = at + length
                break
    return sorted(out, key=lambda x: (x.offset, -x.length, x.kind))


def carved(content: bytes, found: list[Found]) -> list[dict]:
    """What was found past offset 0; bytes only of what no other of it holds, as those have the bytes of what is in them."""
    out, held_to = [], 0
    for x in found:
        if x.offset:
            whole = x.offset + x.length > held_to
            out.append({"offset": x.offset, "length": x.length, "type": x.kind, "bytes": content[x.offset : x.offset + x.length] if whole else None})
            held_to = max(held_to, x.offset + x.length)
    return out


def by_bytes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about BATCH_BYTES of a binary column."""
    for b in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if held and held + n > BATCH_BYTES:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if b.num_rows > start:
            yield b.slice(start)


def sniff_media(rows: DataFrame, key: str = "id", content: str = "content", declared: str = "declared_type") -> DataFrame:
    """rows (key, binary content, declared type) -> one row a row: key, detected_type, corrected_type, is_mismatch, embedded.

    detected_type is null where nothing validates at offset 0; corrected_type then keeps the declared one. embedded lists
    offset, length, type and bytes of each medium found past offset 0, exact copies included; bytes are null for media inside
    another one of the list, whose bytes have theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
        for b in by_bytes(batches, "content"):
            detected, fixed, wrong, inner = [], [], [], []
            for c, d in zip(b.column("content").to_pylist(), b.column("declared").to_pylist(), strict=True):
                c = c or b""
                found = sniff(c)
                top = found[0].kind if found and found[0].offset == 0 else None
                detected.append(top)
                fixed.append(top or d)
                wrong.append(top is not None and top != d)
                inner.append(carved(c, found))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(detected, pa.string()), pa.array(fixed, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inner, kind)], [key, "detected_type", "corrected_type", "is_mismatch", "embedded"])

    rows = pick(rows, key, content, declared).toDF("key", "content", "declared")
    out = f"`{key}` {dict(rows.dtypes)['key']}, detected_type string, corrected_type string, is_mismatch boolean, embedded array<struct<offset:long,length:long,type:string,bytes:binary>>"
    return rows.mapInArrow(run, out)


def wav_encode(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the 8-bit unsigned samples of a one-channel WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(content: bytes, found: list[Found]) -> bytes:
    """The data chunk of the WAV file that sniff() found at offset 0."""
    if not found or found[0].offset or found[0].kind != "audio/wav":
        raise ValueError("no valid WAV file")
    p = 12
    while content[p : p + 4] != b"data":
        n = int.from_bytes(content[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    return content[p + 8 : p + 8 + int.from_bytes(content[p + 4 : p + 8], "little")]


def wav_features(samples: bytes, rate: int = RATE) -> str:
    """Length, mean, root mean square about the mid level, peak, mid-level crossings."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256) - 128
    mean, rms = counts @ np.arange(256) / len(x), ((counts @ levels**2) / len(x)) ** 0.5
    high = x >= 128
    return f"wav rate={rate} bits=8 samples={len(x)} mean={mean:.4f} rms={rms:.4f} peak={int(x.max())} crossings={int((high[1:] != high[:-1]).sum())}"


def media_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the media of each text as a WAV file: doc_id, n_bytes, payload_bytes, media, declared_type.

    The payload is the text in UTF-8 (null: none) and bytes 0 up to a positive multiple of 64. Documents declare no media
    type; DECLARED stands in for what senders say, right and wrong, by the text's length, so equal texts declare the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "raw"):
            raw = [t or b"" for t in b.column("raw").to_pylist()]
            padded = [t + b"\0" * (-len(t) % BLOCK if t else BLOCK) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(map(len, padded), pa.int64()), pa.array([wav_encode(p) for p in padded], pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("raw"))
    made = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, payload_bytes long, media binary")
    return made.withColumn("declared_type", F.get(F.array(*map(F.lit, DECLARED)), (F.col("n_bytes") % len(DECLARED)).cast("int")))


def read_media(media: DataFrame) -> DataFrame:
    """media_documents() read back: each file is sniffed, checked and decoded; its type is corrected and what it embeds is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "media"):
            out: list[tuple] = []
            for m, declared in zip(b.column("media").to_pylist(), b.column("declared_type").to_pylist(), strict=True):
                found = sniff(m)
                samples = wav_samples(m, found)
                out.append((hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), wav_features(samples), found[0].kind, found[0].kind != declared, sum(x.offset > 0 for x in found)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            made = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected_type", "is_mismatch", "n_embedded"])

    kind = dict(media.dtypes)["doc_id"]
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected_type string, is_mismatch boolean, n_embedded long")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(media_documents(table(spark, sf_dir, "documents")))
