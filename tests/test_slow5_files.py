"""SLOW5 files by byte ranges: headers, positions, samples, types; streams of them."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandworks.operators import assemble, infer, signal, summary
from strandworks.params import JobParams
from strandworks.sources import fastq, files, slow5, slow5_scan
from strandworks.streaming import ingest

KINDS = {"read_id": "char*", "read_group": "uint32_t", "digitisation": "double", "offset": "double", "range": "double", "len_raw_signal": "uint64_t", "raw_signal": "int16_t*", "read_number": "int32_t", "start_time": "uint64_t", "end_reason": "enum{no,yes}"}


def render(rows, names, end="\n", attributes=()):
    head = ["#slow5_version\t0.2.0", "#num_read_groups\t1", *("\t".join(("@" + a, *v)) for a, v in attributes), "#" + "\t".join(KINDS[n] for n in names), "#" + "\t".join(names)]
    return end.join([*head, *("\t".join(r[n] for n in names) for r in rows)]) + end


def row(k, samples):
    return {"read_id": f"r{k}", "read_group": "0", "digitisation": "2048", "offset": str(-k), "range": "748.5", "len_raw_signal": str(len(samples)), "raw_signal": ",".join(map(str, samples)), "read_number": str(k), "start_time": str(10**9 + k), "end_reason": str(k % 2)}


def made(seed, n):
    r = random.Random(seed)
    return [row(k, [r.randrange(-500, 500) for _ in range(r.choice([0, 1, 7, 60, 130]))]) for k in range(n)]


def shuffled(seed):
    names = list(KINDS)[1:]
    random.Random(seed).shuffle(names)
    return ["read_id", *names]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**15), 2**15 - 1), max_size=30))
def test_samples_are_those_of_the_text(values):
    assert slow5_scan.whole_numbers(",".join(map(str, values)).encode(), -(2**15), 2**15 - 1).tolist() == values


@pytest.mark.parametrize("text", [b",", b"1,", b",1", b"1,,2", b"-", b"1-2", b"--1", b"1 2", b"a", b"1,32768", b"-32769", b"1.5", b"9" * 40, b"+1"])
def test_other_text_is_corrupt(text):
    with pytest.raises(slow5_scan.Corrupt):
        slow5_scan.whole_numbers(text, -(2**15), 2**15 - 1)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_lose_and_double_nothing(tmp_path, end):
    rows = made(1, 25)
    text = render(rows, shuffled(3), end)
    (tmp_path / "a").write_bytes(text.encode())
    columns = {n: KINDS[n] for n in ("read_id", "raw_signal", "read_number")}
    for size in (1, 7, 100, 1000, 10**6):
        scan = slow5_scan.Scan(columns, None, False, False)
        got = [x for a in range(0, len(text), size) for x in scan.records(f"file://{tmp_path}/a", a, min(len(text), a + size))]
        assert [r["read_id"] for _, r in got] == [r["read_id"] for r in rows]
        assert all(text.encode()[p:].startswith(f"{r['read_id']}\t".encode()) for p, r in got)
        assert [",".join(map(str, r["raw_signal"].tolist())) for _, r in got] == [r["raw_signal"] for r in rows]


def test_heads_take_as_many_bytes_of_a_small_file_as_of_a_large_one(spark, tmp_path):
    taken = []
    for n in (200, 20_000):
        (tmp_path / f"{n}.slow5").write_text(render(made(2, n), list(KINDS), attributes=[("kit", ["K"])]))
        head, fetched = slow5_scan.head_of(f"file://{tmp_path}/{n}.slow5", 256)
        assert head.names.split("\t") == list(KINDS) and head.attributes == [("kit", ["K"])]
        taken.append(fetched)
    assert taken[0] == taken[1] <= 512
    found = slow5.file_heads(files.listed(spark, f"file://{tmp_path}"))
    assert {r["head_bytes"] <= slow5_scan.HEAD_BYTES for r in found.collect()} == {True}
    assert sorted((r["attr"], r["value"], r["read_group"]) for r in slow5.read_header(spark, str(tmp_path)).collect()) == [("kit", "K", 0)] * 2


def test_ranges_and_lines_give_the_same_reads(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.slow5").write_text(render([r | {"read_id": f"{k}.{r['read_id']}"} for r in made(k, 30)], shuffled(k % 2)))
    want = slow5.parse(slow5.lines(spark, str(tmp_path)))
    for size in (200, 5_000, 1 << 20):
        got = slow5.read_slow5(spark, str(tmp_path), split_bytes=size)
        assert got.count() == want.count() == 120 and got.select(*want.columns).exceptAll(want).count() == 0


def test_previews_are_in_file_order(spark, tmp_path):
    rows = [(f"{k}.slow5", r) for k in range(3) for r in made(k, 40)]
    for k in range(3):
        (tmp_path / f"{k}.slow5").write_text(render([r for f, r in rows if f == f"{k}.slow5"], shuffled(k)))
    reads = slow5.read_slow5(spark, str(tmp_path), positions=True, split_bytes=777)
    got = summary.preview_reads(reads, ("path", "position"), batches=1, batch_reads=95).select(F.element_at(F.split("path", "/"), -1).alias("f"), "read_id", "len_raw_signal").collect()
    assert [tuple(r) for r in got] == [(f, r["read_id"], int(r["len_raw_signal"])) for f, r in rows[:95]]


def test_only_what_is_asked_for_and_errors_all_the_same(spark, tmp_path):
    rows = made(5, 30)
    (tmp_path / "a.slow5").write_text(render(rows, list(KINDS)))
    some = slow5.read_slow5(spark, str(tmp_path), only=["read_id", "end_reason"])
    assert some.columns == ["path", "read_id", "end_reason"] and [r["end_reason"] for r in some.orderBy(F.substring("read_id", 2, 9).cast("int")).collect()] == ["no", "yes"] * 15
    with pytest.raises(ValueError, match="no SLOW5 header names other"):
        slow5.read_slow5(spark, str(tmp_path), only=["other"])
    for bad in ({"raw_signal": "1,2,x", "len_raw_signal": "3"}, {"raw_signal": "1,2", "len_raw_signal": "3"}, {"raw_signal": "1,40000", "len_raw_signal": "2"}, {"end_reason": "2"}, {"raw_signal": "."}, {"read_number": "1e3"}):
        (tmp_path / "a.slow5").write_text(render([*rows, row(99, [1]) | bad], list(KINDS)))
        with pytest.raises(Exception, match="not a SLOW5 record"):
            slow5.read_slow5(spark, str(tmp_path), only=["read_id"]).count()
        flagged = slow5.read_slow5(spark, str(tmp_path), "flag", only=["read_id"])
        assert [(r["read_id"], r["_corrupt"]) for r in flagged.where("_corrupt").collect()] == [(None, True)] and flagged.count() == 31


def test_types_of_auxiliary_columns(spark, tmp_path):
    kinds = {"read_id": "char*", "len_raw_signal": "uint64_t", "raw_signal": "int16_t*", "big": "uint64_t", "floats": "float*", "bytes": "uint8_t*", "longs": "uint64_t*", "small": "int8_t"}
    text = "#" + "\t".join(kinds.values()) + "\n#" + "\t".join(kinds) + "\na\t1\t-3\t18446744073709551615\t1.5,-2\t0,255\t1,18446744073709551615\t-128\nb\t0\t\t.\t.\t\t.\t.\n"
    (tmp_path / "a.slow5").write_text(text)
    got = slow5.read_slow5(spark, str(tmp_path), wide=True)
    assert dict(got.dtypes)["big"] == "decimal(20,0)" and dict(got.dtypes)["longs"] == "array<decimal(20,0)>"
    assert [tuple(r)[1:] for r in got.orderBy("read_id").collect()] == [("a", 1, [-3], 2**64 - 1, [1.5, -2.0], [0, 255], [1, 2**64 - 1], -128), ("b", 0, [], None, None, [], None, None)]
    with pytest.raises(Exception, match="not a SLOW5 record"):
        slow5.read_slow5(spark, str(tmp_path)).collect()


def test_files_without_a_header(spark, tmp_path):
    rows = made(4, 6)
    body = render(rows, list(KINDS)).split("\n")[4:]
    (tmp_path / "b.slow5").write_text("\n".join(body))
    with pytest.raises(ValueError, match="no SLOW5 header line"):
        slow5.read_slow5(spark, str(tmp_path))
    (tmp_path / "a.slow5").write_text(render(rows, list(KINDS)))
    assert slow5.read_slow5(spark, str(tmp_path)).count() == 12
    (tmp_path / "c.slow5").write_text(render(rows, shuffled(1)))
    with pytest.raises(ValueError, match="without a header"):
        slow5.read_slow5(spark, str(tmp_path))
    (tmp_path / "b.slow5").write_text(render(rows, list(KINDS)) + "#read_id\tother\n")
    with pytest.raises(Exception, match="in several ways"):
        slow5.read_slow5(spark, str(tmp_path)).count()


def test_a_stream_takes_each_files_own_columns(spark, tmp_path):
    """Two column orders, in different micro-batches and in one; a file that lacks a column; equal to the batch."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        names = shuffled(k) if k < 3 else [n for n in KINDS if n != "end_reason"]
        (tmp_path / "in" / f"{k}.slow5").write_text(render([r | {"read_id": f"{k}.{r['read_id']}"} for r in made(k, 9)], names))
    columns = dict(KINDS)
    want = slow5.read_slow5(spark, f"{tmp_path}/in").drop("path")
    for n in (1, 100):
        got = ingest.stream_reads(spark, f"{tmp_path}/in", f"file://{tmp_path}/out{n}", f"file://{tmp_path}/progress{n}", lambda reads: reads, columns, files_per_trigger=n)
        assert got.count() == 36 and got.select(*want.columns).exceptAll(want).count() == 0
    other = render(made(1, 2), list(KINDS)).replace("\tint32_t", "\tdouble", 1)
    (tmp_path / "in" / "9.slow5").write_text(other)
    with pytest.raises(Exception, match="disagree about the type of read_number"):
        ingest.stream_reads(spark, f"{tmp_path}/in", f"file://{tmp_path}/out1", f"file://{tmp_path}/progress1", lambda reads: reads, columns)


def test_signals_to_fastq_in_a_stream_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    params = JobParams(chunk_size=60, overlap=10)
    tolerate = ("empty_sequence", "empty_qualities")
    is_rna = F.col("read_number") % 2 == 1
    for k in range(3):
        (tmp_path / "in" / f"{k}.slow5").write_text(render([r | {"read_id": f"{k}.{r['read_id']}"} for r in made(k, 20)], shuffled(k)))
    args = (f"{tmp_path}/in", f"file://{tmp_path}/calls", f"file://{tmp_path}/progress", infer.step_caller, params, is_rna, tolerate)
    ingest.stream_calls(spark, *args, columns=KINDS, files_per_trigger=1)
    (tmp_path / "in" / "late.slow5").write_text(render([r | {"read_id": f"late.{r['read_id']}"} for r in made(9, 20)], shuffled(9)))
    ingest.stream_calls(spark, *args, columns=KINDS, bytes_per_trigger=2000)
    got = fastq.read_fastq(spark, f"file://{tmp_path}/calls").select("read_id", "seq", "qstring")
    reads = signal.normalize_signal(signal.calibrate_signal(signal.drop_empty_reads(slow5.read_slow5(spark, f"{tmp_path}/in"))))
    called = infer.emit_bases(infer.score_chunks(signal.chunk_signal(reads, params), infer.step_caller, params), tolerate=tolerate)
    batch = assemble.orient_reads(assemble.stitch_reads(called, params, ("read_id", "read_number")), is_rna).where("seq <> ''").select("read_id", "seq", "qstring")
    assert got.count() == batch.count() > 30 and got.exceptAll(batch).count() == 0


def test_the_chain_of_a_stream_has_no_shuffle(spark, tmp_path):
    (tmp_path / "a.slow5").write_text(render(made(1, 3), list(KINDS)))
    reads = ingest.arriving_reads(spark, str(tmp_path), KINDS)
    called = ingest.called_reads(reads, infer.step_caller, JobParams(chunk_size=60, overlap=10))
    assert called.isStreaming
    batch = ingest.called_reads(slow5.read_slow5(spark, str(tmp_path)), infer.step_caller, JobParams(chunk_size=60, overlap=10))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and plan.count("Exchange") == 1  # ranges are dealt out


def test_writes_tell_what_they_wrote(spark, tmp_path):
    rows = [(f"r{k:03}", "ACGT" * (k % 3), "IIII" * (k % 3), k) for k in range(100)]
    frame = spark.createDataFrame(rows, "read_id string, seq string, qstring string, place int").repartition(5)
    for order in ((), ("place",)):
        path = tmp_path / f"calls{len(order)}"
        told = fastq.write_fastq(frame, f"file://{path}", order)
        size = sum(p.stat().st_size for p in path.glob("part-*"))
        assert told == {"reads": 100, "reads_without_bases": 34, "records": 66, "bytes": size}
    kept = [r["read_id"] for r in fastq.read_fastq(spark, f"file://{tmp_path}/calls1", 100).orderBy("path", "position").collect()]
    assert kept == [r[0] for r in rows if r[1]]
    none = fastq.write_fastq(frame.where("place < 0"), f"file://{tmp_path}/none")
    assert none == {"reads": 0, "reads_without_bases": 0, "records": 0, "bytes": 0}


@pytest.mark.parametrize(("cs", "overlap", "stride"), [(60, 10, 1), (20, 4, 1), (50, 30, 1), (49, 1, 1), (86, 10, 1), (9, 8, 1), (60, 10, 5), (20, 7, 4)])
def test_stitching_in_arrays_equals_stitching_by_rows(spark, cs, overlap, stride):
    """Any moves, at strides above 1 too; chunks of a read may stand in any order."""
    params = JobParams(chunk_size=cs, overlap=overlap, stride=stride)
    reads = spark.range(1, 150).select(F.col("id").cast("string").alias("read_id"), F.col("id").alias("len_raw_signal"))
    plan = signal.chunk_plan(reads, params)
    steps = params.samples // stride
    draw = lambda k, n: F.pmod(F.xxhash64("read_id", "idx", k), F.lit(n))
    moves = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: draw(k, 2).cast("tinyint"))
    chunks = plan.withColumn("moves", moves).withColumn("n", F.aggregate("moves", F.lit(0), lambda a, m: a + m))
    text = lambda letters, salt: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: F.substring(F.lit(letters), F.pmod(F.xxhash64("read_id", "idx", k, F.lit(salt)), F.lit(4)).cast("int") + 1, F.lit(1))), "")
    chunks = chunks.withColumns({"seq": F.substring(text("ACGT", 1), F.lit(1), F.col("n")), "qstring": F.substring(text("!+5I", 2), F.lit(1), F.col("n"))})
    rows = {r["read_id"]: (r["seq"], r["qstring"]) for r in assemble.stitch_reads(chunks, params).collect()}
    arrays = chunks.groupBy("read_id", "len_raw_signal").agg(F.shuffle(F.collect_list(F.struct("idx", "input_offset", "moves", "seq", "qstring"))).alias("chunks"))
    assert {r["read_id"]: (r["seq"], r["qstring"]) for r in assemble.stitch_arrays(arrays, params).collect()} == rows


def test_reads_keep_their_chunks(spark):
    params = JobParams(chunk_size=20, overlap=4, batch_chunks=7)
    x = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda k: ((k * 37 + F.col("id") * 11) % 101 - 40) / F.lit(400.0))
    reads = spark.range(0, 90).select(F.col("id").cast("string").alias("read_id"), F.col("id").alias("len_raw_signal"), F.when(F.col("id") > 0, x).otherwise(F.array().cast("array<double>")).alias("signal"))
    by_row = infer.score_chunks(signal.chunk_signal(reads, params), infer.step_caller, params).select("read_id", "idx", "input_offset", "moves", "seq", "qstring")
    for parts in (1, 5):
        scored = infer.score_reads(signal.chunk_arrays(reads.repartition(parts), params), infer.step_caller, params)
        in_arrays = scored.select("read_id", F.inline("chunks"))
        assert in_arrays.count() == by_row.count() and in_arrays.exceptAll(by_row).count() == 0
    bad = scored.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["input_offset"].alias("input_offset"), c["moves"].alias("moves"), F.lit("A").alias("seq"), c["qstring"].alias("qstring"))))
    with pytest.raises(Exception, match="a decoder's output breaks"):
        infer.emit_arrays(bad, tolerate=("empty_sequence", "empty_qualities")).select("read_id").collect()
    flagged = infer.emit_arrays(bad, "flag").select("read_id", F.inline("chunks")).select("read_id", "idx", "broken")
    rows = infer.emit_bases(by_row.withColumn("seq", F.lit("A")), "flag").select("read_id", "idx", "broken")
    assert flagged.exceptAll(rows).count() == 0 and flagged.count() == rows.count()


def test_a_worker_builds_its_model_once(spark, tmp_path):
    """Many tasks, few workers: a file for each build, named by its process."""
    import os
    import uuid

    place = str(tmp_path)

    def make():
        (open(f"{place}/{os.getpid()}-{uuid.uuid4().hex}", "w")).close()
        return lambda x: [([1], "A", "!")] * len(x)

    chunks = spark.range(0, 400, 1, 40).select(F.col("id").cast("string").alias("read_id"), F.array(F.lit(0.5), F.lit(0.1)).alias("signal"))
    for _ in range(2):
        assert infer.score_chunks(chunks, make, token="one model").count() == 400
    built = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(built) == len(set(built)) <= 2 * spark.sparkContext.defaultParallelism
    assert infer.score_chunks(chunks, make).count() == 400 and len(list(tmp_path.iterdir())) > len(built)  # no token, a model of its own


def test_models_of_a_worker_are_few(monkeypatch):
    monkeypatch.setattr(infer, "_MODELS", {})
    built = []
    for token in "abcdefa":
        assert infer.worker_model(token, lambda t=token: built.append(t) or t) == token
    assert built == list("abcdefa") and len(infer._MODELS) == infer.MOST_MODELS


def test_quarantine_parts_good_from_broken(spark, tmp_path):
    rows = [("good", [1, 0, 1], "ACxx", "!+xx"), ("more", [1, 2, 1], "ACGT", "!!!!"), ("none", [0, 0], "", ""), ("short", [1, 1, 1], "AC", "I"), ("null", None, "A", "!")]
    scored = spark.createDataFrame(rows, "read_id string, moves array<tinyint>, seq string, qstring string")
    good, broken = infer.quarantine(scored, f"file://{tmp_path}/q")
    assert [(r["read_id"], r["num_bases"], r["seq"], r["qstring"]) for r in good.collect()] == [("good", 2, "AC", "!+")]
    assert {r["read_id"]: (r["broken"], r["seq"]) for r in broken.collect()} == {"more": (["more_bases_than_steps"], "ACGT"), "none": (["empty_sequence", "empty_qualities"], ""), "short": (["lengths_differ"], "AC"), "null": (["empty_sequence", "empty_qualities"], "A")}
    kept, rest = infer.quarantine(scored.where("read_id = 'none'"), tolerate=("empty_sequence", "empty_qualities"))
    assert kept.count() == 1 and rest.count() == 0
    counts = {(r["level"], r["rule"]): r["n"] for r in infer.check_calls(scored, good.select("read_id", "seq", "qstring")).collect()}
    assert len(counts) == 7 and counts["chunk", "lengths_differ"] == 1 and counts["chunk", "empty_sequence"] == 2 and counts["read", "lengths_differ"] == 0


def test_numbers_of_signals_pass_through_arrow(spark):
    assert np.isnan(infer.matrix(__import__("pyarrow").array([[1.0, None], [2.0, 3.0]]))[0, 1])
