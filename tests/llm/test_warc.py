"""WARC archives: round trips, pushdown, revisits, edges."""

import gzip
import hashlib
import io
import re

import pytest

from strandworks.llm import warc

PAGES = "page_id long, url string, html string, URL string"


def write(spark, rows, path, schema=PAGES):
    warc.register(spark)
    warc.page_records(spark.createDataFrame(rows, schema)).write.format("warc").mode("append").save(path)
    return path


def expected(rows):
    first: dict[str, int] = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        revisit = h in first and i != first[h]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


def test_pages_round_trip(spark, tmp_path):
    long = "<p>é</p>" * 20
    rows = [(3, "http://a/1", long, "x"), (1, "http://a/2\r\nWARC-Type: x%", long, "x"), (2, None, long, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"), (6, "u", None, "x"), (7, "u", "", "x")]
    rows += [(3, "http://a/1", long, "x"), (1, "again", long, "x"), (None, "u", long, "x"), (None, "u", "alone", "x"), (8, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "x"), (9, "u", "w " * 500_000, "x")]
    path = write(spark, rows, f"file://{tmp_path}/w")
    got = [tuple(r) for r in warc.read_pages(spark, path).collect()]
    assert sorted(got, key=str) == expected(rows)
    uris = {r["target_uri"] for r in spark.read.format("warc").load(path).where("payload_digest is not null").collect()}
    assert uris == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _, _ in rows}
    records = spark.read.format("warc").load(path).collect()
    ids = [r["record_id"] for r in records]
    assert len(set(ids)) == len(rows) and all(re.fullmatch("<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    for r in records:
        assert (r["profile"] == warc.PROFILE and r["refers_to"] in ids) if r["record_type"] == "revisit" else r["profile"] is None is r["refers_to"]


def test_predicates_reach_the_reader(spark, tmp_path):
    path = write(spark, [(i, f"u{i}", "text " * 30 * (1 + i % 2), "x") for i in range(20)], f"file://{tmp_path}/w")
    frame = spark.read.format("warc").load(path).where("record_type = 'revisit' and target_uri in ('u4', 'u5', 'u0')")
    assert sorted(r["target_uri"] for r in frame.collect()) == ["u4", "u5"]
    reader = warc.WarcReader(path, True)
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("target_uri",), ("u4", None)), warc.EqualTo(("payload",), b"x")]))
    assert [type(f) for f in kept] == [warc.EqualTo] and reader.wanted == [("record_type", ("revisit",)), ("target_uri", ("u4",))]
    assert all(r["payload"] is None for r in spark.read.format("warc").option("payload", "false").load(path).collect())


def test_skipped_payloads_are_not_kept():
    data = warc.record_bytes({"record_type": "response", "record_id": "a"}, b"x" * 3_000_000) + warc.record_bytes({"record_type": "revisit", "record_id": "b"}, b"")
    for raw in (data, gzip.compress(data), gzip.compress(data[:100]) + gzip.compress(data[100:])):
        got = list(warc.records(warc.Stream(io.BytesIO(raw)), [("record_type", ("revisit",))], True))
        assert [r["record_id"] for r in got] == ["b"]
        assert [len(r["payload"]) for r in warc.records(warc.Stream(io.BytesIO(raw)), [], True)] == [3_000_000, 0]


def test_damaged_archives_are_errors():
    data = warc.record_bytes({"record_type": "response"}, b"abc")
    for whole in (data, data + data, gzip.compress(data), gzip.compress(data) * 2):
        for k in range(1, len(whole)):
            if k not in (len(data), len(gzip.compress(data))):  # between two records
                with pytest.raises(ValueError):
                    list(warc.records(warc.Stream(io.BytesIO(whole[:k])), [], True))
    with pytest.raises(ValueError):
        list(warc.records(warc.Stream(io.BytesIO(data.replace(b"Length: 3", b"Length: 2"))), [], True))
    with pytest.raises(ValueError):
        list(warc.records(warc.Stream(io.BytesIO(b"GET / HTTP/1.1\r\n\r\n")), [], True))


def test_nothing(spark, tmp_path):
    path = write(spark, [], f"file://{tmp_path}/none")
    assert warc.read_pages(spark, path).count() == 0


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    out = warc.WarcWriter(f"file://{tmp_path}/many", 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"record_id": f"r{i}", "record_type": "response", "payload": b"y"} for i in range(10)])
    done = out.write(iter([batch]))
    reader = warc.WarcReader(f"file://{tmp_path}/many", True)
    assert len(done.files) > 2 and not reader.partitions()
    out.commit([done, None])
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == sorted(f"r{i}" for i in range(10))


FOREIGN = b"".join(
    b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-00000000000" + i + b">\r\nWARC-Target-URI: http://a.com/q?x=100%25&y=a%0Ab\r\nX-Other:\tone\r\n\ttwo\r\ncontent-length:  " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    for kind, i, block in [(b"warcinfo", b"1", b"software: x\r\n"), (b"request", b"2", b"GET / HTTP/1.1\r\n\r\n"), (b"response", b"3", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n"), (b"metadata", b"4", b"")]
)


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_archives_of_others_are_unaltered(spark, tmp_path, pack):
    (tmp_path / f"crawl.warc{'' if pack(b'x') == b'x' else '.gz'}").write_bytes(pack(FOREIGN))
    warc.register(spark)
    found = spark.read.format("warc").load(f"file://{tmp_path}")
    rows = {r["record_type"]: r for r in found.collect()}
    assert set(rows) == {"warcinfo", "request", "response", "metadata"} and {r["target_uri"] for r in rows.values()} == {"http://a.com/q?x=100%25&y=a%0Ab"}
    assert bytes(rows["response"]["payload"]) == b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n" and rows["request"]["record_id"] == "<urn:uuid:00000000-0000-0000-0000-000000000002>"
    assert [r["record_type"] for r in found.where("record_type = 'response'").collect()] == ["response"]


def test_files_of_other_types_are_not_opened(spark, tmp_path):
    path = write(spark, [(i, "u", "same text " * 20, "x") for i in range(5)], f"file://{tmp_path}/w")
    reader = warc.WarcReader(path, True)
    every = len(reader.partitions())
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    assert 0 < len(reader.partitions()) < every and all(p.path.endswith(".only-revisit.warc.gz") for p in reader.partitions())


def test_sieve_has_every_key(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    rows = spark.range(50_000).selectExpr("id", "xxhash64(id) as h")
    for bits in (15, 20):
        got = warc.sieved(rows, warc.sieve(keys, bits), bits, "hit").where("hit").collect()
        assert set(range(5000)) <= {r["id"] for r in got} and len(got) < 5000 + 50_000 * 5000 / 2**bits * 1.2


@pytest.mark.parametrize("bits", [15, 4])
def test_hot_payloads_and_a_full_sieve(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(warc, "bits_for", lambda keys: bits)  # with 16 bits nearly every row is caught by chance
    hot, few = "error page " * 20, "<p>é</p>" * 20
    rows = [(i, "u", hot if i % 3 == 0 else few if i % 50 == 1 else f"page {i} " * 20, "x") for i in range(300)] + [(7, "again", "page 7 " * 20, "x")] * 3
    path = write(spark, rows, f"file://{tmp_path}/w")
    assert sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=str) == expected(rows)
    assert spark.read.format("warc").load(path).select("record_id").distinct().count() == len(rows)


def test_registered_query(spark):
    rows = [(r["page_id"], r["url"], r["html"], "") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op6_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == expected(rows)


class Counted(io.BytesIO):
    """Bytes that count how many of them are read."""

    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def made(packed, n=40, size=600_000):
    pack = {"plain": lambda d: d, "own": lambda d: warc.member(d, 0), "others": lambda d: gzip.compress(d, 0)}[packed]
    return b"".join(pack(warc.record_bytes({"record_type": "response", "record_id": f"r{i}", "page_id": i}, bytes([65 + i % 26]) * size)) for i in range(n))


@pytest.mark.parametrize("packed", ["plain", "own", "others"])
def test_what_headers_rule_out_is_not_inflated(packed):
    raw = Counted(made(packed))
    stream = warc.Stream(raw)
    got = list(warc.records(stream, [("page_id", ("7",))], True))
    assert [(r["record_id"], len(r["payload"])) for r in got] == [("r7", 600_000)]
    if packed != "others":  # those do not say where they end
        assert raw.got < 40 * 2 * warc.CHUNK + 600_000 < len(raw.getvalue()) and stream.inflated < 40 * 2 * warc.PIECE + 650_000
    whole = list(warc.records(warc.Stream(io.BytesIO(made(packed, 5, 70_000))), [], True))
    assert [r["payload"] for r in whole] == [bytes([65 + i]) * 70_000 for i in range(5)]
    assert [r["payload"] for r in warc.records(warc.Stream(io.BytesIO(made(packed, 5, 70_000))), [], False)] == [None] * 5


@pytest.mark.parametrize("packed", ["plain", "own", "others"])
def test_skipping_finds_truncated_archives(packed):
    for size in (3, 70_000):
        data = made(packed, 2, size)
        for k in {*range(1, min(len(data), 400)), *range(len(data) - 300, len(data)), len(data) // 2 - 9, len(data) // 2 + 9}:
            if 0 < k < len(data) and k != len(data) // 2:
                with pytest.raises(ValueError):
                    list(warc.records(warc.Stream(io.BytesIO(data[:k])), [("page_id", ("none",))], True))
        assert list(warc.records(warc.Stream(io.BytesIO(data)), [("page_id", ("none",))], True)) == []
    assert gzip.decompress(made("own", 2, 3)) == made("plain", 2, 3)
