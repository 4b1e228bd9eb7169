"""Chunks, calibration and normalisation."""

import statistics

import pytest
from pyspark.sql import functions as F

from strandworks.operators import assemble, infer, signal
from strandworks.params import JobParams, byte_count


def plain_offsets(n, cs, overlap):
    step = cs - overlap
    count = -(-n // step)
    return [min(step * i, n - cs) if n >= cs else step * i for i in range(count)]


@pytest.mark.parametrize(("cs", "overlap"), [(60, 10), (20, 4), (50, 30), (49, 1), (86, 10), (5, 4), (7, 3)])
def test_chunk_plan_and_padding(spark, cs, overlap):
    params = JobParams(chunk_size=cs, overlap=overlap)
    reads = spark.range(0, 220).select(F.col("id").cast("string").alias("read_id"), F.col("id").alias("len_raw_signal"), F.when(F.col("id") > 0, F.sequence(F.lit(1), F.col("id").cast("int"))).otherwise(F.array().cast("array<int>")).alias("signal"))
    got: dict[int, list] = {}
    for r in signal.chunk_signal(reads, params).collect():
        n = int(r["read_id"])
        got.setdefault(n, []).append((r["idx"], r["input_offset"]))
        part = list(range(1, n + 1))[r["input_offset"] : r["input_offset"] + cs]
        assert r["raw_chunk_size"] == len(part) and r["signal"] == [part[k % len(part)] for k in range(cs)]
    assert {n: [o for _, o in sorted(x)] for n, x in got.items()} == {n: plain_offsets(n, cs, overlap) for n in range(1, 220)}
    plan = signal.chunk_plan(reads, params).select("read_id", "idx", "input_offset", "raw_chunk_size")
    assert plan.exceptAll(signal.chunk_signal(reads, params).select(*plan.columns)).count() == 0


@pytest.mark.parametrize(("n", "offsets"), [(30, [0]), (55, [0, 50]), (60, [0, 0]), (105, [0, 45, 45]), (150, [0, 50, 90])])
def test_edges_of_the_plan(spark, n, offsets):
    got = spark.range(1).select(signal.chunk_offsets(F.lit(n).cast("long"), JobParams(chunk_size=60, overlap=10)).alias("o")).first()["o"]
    assert got == offsets


@pytest.mark.parametrize(("cs", "overlap"), [(60, 10), (20, 4), (50, 30), (49, 1), (86, 10), (9, 8)])
def test_stitched_chunks_equal_the_whole_read(spark, cs, overlap):
    params = JobParams(chunk_size=cs, overlap=overlap)
    x = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda k: ((k * 37 + F.col("id") * 11) % 101 - 40) / F.lit(400.0))
    reads = spark.range(1, 150).select(F.col("id").cast("string").alias("read_id"), F.col("id").alias("len_raw_signal"), x.alias("signal"))
    scored = infer.emit_bases(infer.score_chunks(signal.chunk_signal(reads, params).repartition(3), infer.step_caller, params), tolerate=("empty_sequence", "empty_qualities"))
    got = {r["read_id"]: (r["seq"], r["qstring"]) for r in assemble.stitch_reads(scored, params).collect()}
    import numpy as np

    call = infer.step_caller()
    for r in reads.collect():
        _, seq, q = call(np.array([r["signal"]]))[0]
        assert got[r["read_id"]] == (seq, q)


def test_batches_of_the_model(spark):
    sizes = spark.sparkContext.accumulator(0)

    def make():
        def call(x):
            assert 1 <= len(x) <= 7
            sizes.add(len(x))
            return [([1], "A", "!")] * len(x)

        return call

    chunks = spark.range(50).select(F.col("id").cast("string").alias("read_id"), F.array(F.lit(0.5), F.lit(0.1)).alias("signal"))
    assert infer.score_chunks(chunks, make, JobParams(batch_chunks=7)).count() == 50 and sizes.value >= 50


def test_calibration_and_normalisation(spark):
    rows = [("a", 10.0, 1400.0, 2.0, 7, [1, 5, 2, 8, 9, 9, 3]), ("b", 0.0, 1.0, 1.0, 4, [4, 4, 4, 4]), ("c", 0.0, 1.0, 1.0, 0, []), ("d", 0.0, 1.0, 1.0, 2, [1, 4])]
    reads = spark.createDataFrame(rows, "read_id string, offset double, range double, digitisation double, len_raw_signal long, raw_signal array<smallint>")
    pa = signal.calibrate_signal(reads)
    for r, (_, o, s, d, _, raw) in zip(pa.orderBy("read_id").collect(), rows, strict=True):
        assert r["signal"] == [(x + o) * s / d for x in raw]
    for r, p in zip(signal.normalize_signal(pa).orderBy("read_id").collect(), pa.orderBy("read_id").collect(), strict=True):
        x = p["signal"]
        if not x:
            assert r["signal"] == []
            continue
        m = statistics.median(x)
        mad = statistics.median(abs(v - m) for v in x) * signal.MAD_SCALE
        assert r["signal"] == ([pytest.approx((v - m) / mad) for v in x] if mad else [None] * len(x))
    assert signal.normalize_signal(pa, "fixed", 2.0, 4.0).orderBy("read_id").first()["signal"][0] == pytest.approx((11 * 700 - 2) / 4)
    with pytest.raises(ValueError):
        signal.normalize_signal(pa, "other")
    assert signal.drop_empty_reads(reads).count() == 3


def test_parameters():
    assert JobParams(chunk_size=1003, overlap=10, stride=5).samples == 1000 and byte_count("500M") == 500_000_000 and byte_count("12") == 12
    for wrong in ({"overlap": 0}, {"overlap": 10_000}, {"batch_chunks": 0}, {"chunk_size": 100_000, "batch_chunks": 1_000}, {"chunk_size": 12, "stride": 10, "overlap": 11}):
        with pytest.raises(ValueError):
            JobParams(**wrong)


def test_orientation_and_integrity(spark):
    reads = spark.createDataFrame([("a", "ACG", "!+5", True), ("b", "AC", "!+", False), ("c", "", "", True), ("d", "A", "!!", False), ("e", None, "!", False)], "read_id string, seq string, qstring string, rna boolean")
    got = {r["read_id"]: (r["seq"], r["qstring"]) for r in assemble.orient_reads(reads, F.col("rna")).collect()}
    assert got == {"a": ("GCA", "5+!"), "b": ("AC", "!+"), "c": ("", ""), "d": ("A", "!!"), "e": (None, "!")}
    assert {r["rule"]: r["n_reads"] for r in assemble.check_reads(reads).collect()} == {"empty_sequence": 2, "empty_qualities": 1, "lengths_differ": 2}
    with pytest.raises(Exception, match="read"):
        assemble.check_reads(reads, strict=True).collect()
    assert [r["n_reads"] for r in assemble.check_reads(reads.where("read_id in ('a', 'b')"), strict=True).collect()] == [0, 0, 0]


def test_decoder_output_is_checked(spark):
    rows = [("good", [1, 0, 1], "ACxx", "!+xx"), ("more", [1, 2, 1], "ACGT", "!!!!"), ("none", [0, 0], "", ""), ("short", [1, 1, 1], "AC", "I"), ("lost", [1], None, "!"), ("blank", [1], "A", ""), ("null", None, "A", "!")]
    scored = spark.createDataFrame(rows, "read_id string, moves array<tinyint>, seq string, qstring string")
    got = {r["read_id"]: r["broken"] for r in infer.emit_bases(scored, mode="flag").collect()}
    assert got == {"good": [], "more": ["more_bases_than_steps"], "none": ["empty_sequence", "empty_qualities"], "short": ["lengths_differ"], "lost": ["empty_sequence", "lengths_differ"], "blank": ["empty_qualities", "lengths_differ"], "null": ["empty_sequence", "empty_qualities"]}
    for bad in ("more", "none", "short", "lost", "blank", "null"):
        with pytest.raises(Exception, match="a decoder's output breaks"):
            infer.emit_bases(scored.where(F.col("read_id").isin("good", bad))).select("read_id").collect()
    only = infer.emit_bases(scored.where("read_id in ('good', 'none')"), tolerate=("empty_sequence", "empty_qualities")).orderBy("read_id").collect()
    assert [(r["num_bases"], r["seq"], r["qstring"]) for r in only] == [(2, "AC", "!+"), (0, "", "")]


def test_whole_reads_pass_unchanged(spark):
    reads = spark.createDataFrame([("a", "AC", "!+"), ("b", "A", "!!")], "read_id string, seq string, qstring string")
    assert assemble.require_whole(reads.where("read_id = 'a'")).collect() == reads.where("read_id = 'a'").collect()
    with pytest.raises(Exception, match="read b: lengths_differ"):
        assemble.require_whole(reads).select("read_id").count()
