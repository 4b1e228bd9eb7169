"""Fingerprints against a plain version, and their edges."""

import hashlib
import re

import pytest
import xxhash

from strandworks.llm import fingerprints as fp

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(parts):
    """Spark's xxhash64 of an array of strings or of integers: each element's hash seeds the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else (p & 0xFFFFFFFF).to_bytes(4, "little"), seed)
    return signed(seed)


def plain(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if not words:
        return ""
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    bins: dict[int, int] = {}
    for r in runs:
        h = chained([w.encode() for w in r])
        b = (h >> (64 - fp.BIN_BITS)) + fp.BINS // 2
        bins[b] = min(bins.get(b, h), h)
    values = []
    for k in range(fp.BINS):
        at = k
        if k not in bins:
            tries = [chained([k, t]) % fp.BINS for t in range(1, fp.PROBES + 1)]
            at = next((b for b in tries if b in bins), None)
            if at is None:
                at = min(bins, key=lambda b: chained([k, b]))
        values.append(bins[at] & 255)
    return "".join(f"{v:02X}" for v in values)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 2 * fp.BINS, 2)) / fp.BINS
    return max(0.0, min(1.0, (same - 1 / 256) / (1 - 1 / 256)))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, KEY string").repartition(3)
    got = fp.fingerprint_edits(docs).collect()
    order = sorted(((i if i is not None else fp.LEAST_LONG), signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t in rows)
    want = []
    for k, (i, _, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b = plain(t), plain(edited)
        want.append((None if i == fp.LEAST_LONG else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(alike(a, b), 9), round(alike(a, plain(after)), 9)))
    assert sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got) if r[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(w[:5]) for w in want)


def test_small_table(spark):
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(n))) for i, n in enumerate((1, 4, 5, 6, 30, 80, 200, 900, 40, 41))]
    check(spark, [*rows, (50, None), (51, ""), (52, "... !"), (53, "É é 𝄞 ñandú ß"), (-5, "same words here and there"), (60, "same words here and there"), (70, "x" * 100_000)])


def test_ties_nulls_and_one_row(spark):
    check(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of the same id"), (None, "no id at all here"), (2, "z y x w v u t s")])
    check(spark, [(9, "alone in the table, its own successor")])
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, docs)


def test_bias_is_corrected(spark):
    grams = lambda t: {tuple(w) for ws in [t.split()] for w in zip(*[ws[i:] for i in range(5)], strict=False)}
    pairs = []
    for k in range(40):
        a = " ".join(f"a{k}x{j}" for j in range(300))
        pairs.append((a, " ".join(f"a{k}x{j}" for j in range(k * 7, 300 + k * 7))))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select(fp.likeness(fp.fingerprint(frame["a"]), fp.fingerprint(frame["b"])).alias("s")).collect()
    off = [r["s"] - len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for r, (a, b) in zip(got, pairs, strict=True)]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.17


@pytest.mark.parametrize("starts", [[5], [1, 4, 9], list(range(0, 100, 3))])
def test_range_numbers(spark, starts):
    frame = spark.range(-3, 110).selectExpr("id", "id % 3 as tie")
    points = [(k, k % 2) for k in starts]
    for r in frame.select("id", "tie", fp.range_number(frame["id"], frame["tie"], points).alias("n")).collect():
        assert r["n"] == sum(p <= (r["id"], r["tie"]) for p in points) - 1


def test_ranges_are_cut_by_bytes_within_one_id(spark):
    rows = [(None if i % 3 else i % 7, f"text {i} " * (400 if i % 50 == 0 else 4)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("coalesce(doc_id, -1) as key", "xxhash64(text) as tie", "octet_length(text) as bytes")
    starts = fp.range_starts(docs, 4000)
    held = [r["b"] for r in docs.groupBy(fp.range_number(docs["key"], docs["tie"], starts).alias("n")).agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()]
    assert len(held) == len(starts) > 10 and max(held) < 5 * 4000 and sum(r[0] == -1 for r in starts) > 5


def test_small_ranges_give_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] % 3)).unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    key = lambda r: str(tuple(r))
    want = sorted(map(key, fp.fingerprint_edits(docs, 1 << 40).collect()))
    assert sorted(map(key, fp.fingerprint_edits(docs, 3000).collect())) == want
