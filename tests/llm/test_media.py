"""Media columns: round trip, validators, carving, edges."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest

from strandworks.llm import media as me


def png(width=2):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(range(width)) for _ in range(2))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


FILES = {
    "audio/wav": me.wav_encode(b"\x80" * 64),
    "image/png": png(),
    "image/gif": gif(),
    "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\x00\x03\xff\xd9",
    "image/bmp": b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHH", 1, 1, 1, 24) + bytes(24) + bytes(4),
    "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
    "application/gzip": gzip.compress(b"some text"),
    "application/zip": archive(),
    "audio/flac": b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8rest",
}


@pytest.mark.parametrize("kind", FILES)
def test_whole_and_embedded(kind):
    data = FILES[kind]
    assert me.sniff(data)[0] == me.Found(0, len(data), kind)
    inner = [x for x in me.sniff(b"BM no RIFF here \xff\xd8\xff " + data) if x.kind == kind]
    assert [(x.offset, x.length) for x in inner] == [(20, len(data))]


@pytest.mark.parametrize("kind", [k for k in FILES if k not in ("audio/flac",)])
def test_cut_off_files_do_not_pass(kind):
    assert not [x for x in me.sniff(FILES[kind][:-1]) if x.offset == 0]


def test_sniffing_rows(spark):
    data = FILES["image/png"] + b"junk" + FILES["image/gif"]
    rows = [(1, data, "image/jpeg", "x"), (2, None, "audio/wav", "x"), (3, b"", None, "x"), (1, data, "image/jpeg", "x"), (4, b"RIFF plain words", "text/plain", "x")]
    got = me.sniff_media(spark.createDataFrame(rows, "id int, content binary, declared_type string, EMBEDDED string")).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == 5 and by[1]["corrected_type"] == "image/png" and by[1]["is_mismatch"]
    assert [(e["type"], bytes(e["bytes"])) for e in by[1]["embedded"]] == [("image/gif", FILES["image/gif"])]
    assert (by[2]["detected_type"], by[2]["corrected_type"], by[3]["corrected_type"], by[4]["corrected_type"]) == (None, "audio/wav", None, "text/plain")


def test_documents_round_trip(spark):
    texts = {1: None, 2: "", 3: "a" * 64, 4: "é" * 33, 5: "RIFF\x00 BM %PDF-" * 9, 6: "long " * 100_000}
    docs = spark.createDataFrame([*((i, t, "x") for i, t in texts.items()), (None, "a" * 64, "x")], "doc_id long, text string, media string")
    got = me.read_media(me.media_documents(docs)).collect()
    assert len(got) == 7
    for r in got:
        raw = (texts.get(r["doc_id"], "a" * 64) or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = me.wav_encode(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(padded), len(stored))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), hashlib.sha256(stored).hexdigest(), zlib.crc32(padded[-64:]))
        x = np.frombuffer(padded, np.uint8).astype(float)
        assert f"mean={x.mean():.4f} rms={np.sqrt(((x - 128) ** 2).mean()):.4f}" in r["feature"] and r["corrected_type"] == "audio/wav"
    assert me.read_media(me.media_documents(docs.limit(0))).count() == 0


def test_wav_chunks_in_other_layouts():
    chunk = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    riff = lambda *chunks: b"RIFF" + struct.pack("<I", 4 + len(b"".join(chunks))) + b"WAVE" + b"".join(chunks)
    fmt, data = (lambda n: chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8) + bytes(n - 16))), chunk(b"data", b"\x80" * 8)
    for good in (riff(fmt(18), data), riff(fmt(40), data), riff(chunk(b"JUNK", bytes(27)), fmt(16), data), riff(chunk(b"bext", bytes(602)), fmt(16), chunk(b"cue ", bytes(4)), data)):
        found = me.sniff(good)
        assert found == [me.Found(0, len(good), "audio/wav")] and me.wav_samples(good, found) == b"\x80" * 8
    for bad in (riff(data, fmt(16)), riff(fmt(16)), riff(data), riff(chunk(b"fmt ", bytes(14)), data), riff(fmt(16), data, data), riff(fmt(16), fmt(16), data)):
        assert not me.sniff(bad)


@pytest.mark.parametrize("bit", [f.magic for f in me.FORMATS] + [b"%%EOF", b"PK\x05\x06", b"PK\x03\x04PK\x05\x06", b"%PDF-startxref", b"\xff\xd8\xff\xda\x00\x02", b"\x1f\x8b\x08\x00" + bytes(6) + b"\x00"])
def test_content_of_magic_bytes_takes_linear_time(bit):
    def took(n):
        start = time.process_time()
        me.sniff(bit * (n // len(bit)))
        return time.process_time() - start

    took(1000)
    assert took(400_000) < 3 and took(800_000) < 6  # a fraction of a second; a quadratic scan takes minutes


def test_nested_media_are_carved_once():
    inner = FILES["image/gif"]
    outer = FILES["image/png"]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    nested = outer[:33] + chunk(b"teXt", inner) + outer[33:]  # a GIF in a chunk of a PNG
    data = b"head" + nested + b"gap" + inner
    got = me.carved(data, me.sniff(data))
    assert [(e["offset"], e["type"], e["bytes"]) for e in got] == [(4, "image/png", nested), (4 + nested.index(inner), "image/gif", None), (len(data) - len(inner), "image/gif", inner)]
    assert [x.kind for x in me.sniff(gzip.compress(inner * 3, 0))] == ["application/gzip"]  # not what is stored in it


def test_two_archives_one_behind_the_other():
    a = archive()
    assert [(x.offset, x.length) for x in me.sniff(a + b"gap" + a)] == [(0, len(a)), (len(a) + 3, len(a))]
    assert [(x.offset, x.length) for x in me.sniff(FILES["application/gzip"] + b"x" * 200_000)] == [(0, len(FILES["application/gzip"]))]
    big = gzip.compress(bytes(3_000_000))
    assert [(x.offset, x.length) for x in me.sniff(b"ab" + big + b"tail")] == [(2, len(big))]


def test_slices_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(me, "BATCH_BYTES", 10)
    data = [b"1234", None, b"123456", b"1", b"x" * 50, b"", b"yy"]
    got = list(me.by_bytes(iter([pa.RecordBatch.from_pydict({"c": pa.array(data, pa.binary())})]), "c"))
    assert [x for b in got for x in b.column("c").to_pylist()] == data and len(got) == 4


def test_registered_query_corrects_declared_types(spark):
    got = me.op2_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert {r["corrected_type"] for r in got} == {"audio/wav"} and {r["is_mismatch"] for r in got} == {True, False}
    assert all(r["is_mismatch"] == (me.DECLARED[r["n_bytes"] % len(me.DECLARED)] != "audio/wav") for r in got)


def plain_riff(b, at, form):
    if len(b) - at < 12 or b[at + 8 : at + 12] != form:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p, kinds = at + 12, []
    while p + 8 <= end <= len(b):
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        kinds.append((b[p : p + 4], n))
        p += 8 + n + (n & 1 if p + 8 + n < end else 0)
    if p != end or end > len(b) or end <= at + 12:
        return None
    kinds = [k for k in kinds if k[0] in (b"fmt ", b"data")]
    wav = [k for k, _ in kinds] == [b"fmt ", b"data"] and kinds[0][1] >= 16
    return end - at if form == b"WEBP" or wav else None


def plain_gif(b, at):
    if len(b) - at < 14:
        return None
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    p = at + 13 + table(b[at + 10])
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + table(b[p + 9])
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def plain_flac(b, at):
    p = at + 4
    while p + 4 <= len(b):
        n = int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 0x7F or n != 34):
            return None
        last, p = b[p] & 0x80, p + 4 + n
        if last:
            return len(b) - at if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xFE == 0xF8 else None
    return None


def every_offset(b):
    """What the walks of these formats find from each offset on its own."""
    out = []
    for at in range(len(b)):
        if b[at : at + 4] == b"RIFF":
            out += [(at, n, k) for form, k in ((b"WAVE", "audio/wav"), (b"WEBP", "image/webp")) if (n := plain_riff(b, at, form))]
        if b[at : at + 6] in (b"GIF87a", b"GIF89a") and (n := plain_gif(b, at)):
            out.append((at, n, "image/gif"))
        if b[at : at + 4] == b"fLaC" and (n := plain_flac(b, at)):
            out.append((at, n, "audio/flac"))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_every_offset_by_itself_finds_the_same(seed):
    r = np.random.default_rng(seed)
    little = lambda n: struct.pack("<I", n)
    pieces = [b"RIFF", b"WAVE", b"WEBP", b"fmt ", b"data", b"JUNK", b"GIF89a", b"GIF87a", b"fLaC", b"\x21\xf9", b"\x2c", b"\x3b", b"\0", b"\0\0\0\x22" + bytes(34), b"\x80\0\0\x22" + bytes(34), b"\xff\xf8", bytes(13), b"\x01A", b"\x03abc", gif(), FILES["audio/wav"], FILES["audio/flac"]]
    parts = []
    for _ in range(r.integers(5, 120)):
        parts.append(pieces[r.integers(len(pieces))] if r.random() < 0.7 else little(int(r.integers(0, 60))))
    b = b"".join(parts)
    b += little(0) * int(r.integers(0, 3))
    if seed % 2:  # nested headers that all say the same end, and chunks that lead from one into another
        body = b"".join(x + little(int(r.integers(0, 5))) + bytes(int(r.integers(0, 5))) for x in (b"JUNK", b"fmt ", b"data", b"JUNK") * 4)
        for k in range(6):
            body = b"RIFF" + little(4 + len(body)) + b"WAVE" + body if k % 3 else b"fmt " + little(16) + bytes(16) + b"data" + little(len(body)) + body
        b += body + (b"\0" if seed % 4 == 1 else b"")
    kinds = {"audio/wav", "image/webp", "image/gif", "audio/flac"}
    closed = [(x.offset, x.offset + x.length) for x in me.sniff(b) if x.kind in me.CLOSED_KINDS]
    assert not closed and sorted((x.offset, x.length, x.kind) for x in me.sniff(b) if x.kind in kinds) == sorted(every_offset(b))


@pytest.mark.parametrize("unit", [b"GIF89aAAAA\x01AA!A", b"fLaC\0\0\0\x22" + bytes(34), b"RIFF\x08\0\0\0WAVE", b"RIFFAAAAWAVEfmt \x10\0\0\0", b"GIF89aAAAAAAA!A\x01A\x01A"])
def test_walks_that_meet_take_linear_time(unit):
    for n in (1_000_000, 4_000_000):
        b = unit * (n // len(unit))
        start = time.process_time()
        me.sniff(b)
        assert time.process_time() - start < 8 * n / 1_000_000  # each walk on its own takes minutes


def test_nested_headers_of_one_end_take_linear_time():
    body = b"fmt \x10\0\0\0" + bytes(16) + b"data\0\0\0\0"
    heads = [b"RIFF" + struct.pack("<I", 4 + len(body) + 20 * k) + b"WAVEJUNK\0\0\0\0" for k in reversed(range(60_000))]  # each as a chunk of its own leads on
    body = b"".join(heads) + body
    start = time.process_time()
    me.sniff(body)
    assert time.process_time() - start < 10
