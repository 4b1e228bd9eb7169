"""One query per operator over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import fresh_path
from ..operators import accuracy, assemble, infer, quality, signal, summary
from ..sources import fastq, paf, slow5
from ..streaming.ingest import stream_calls, stream_reads
from . import proxies as px

Query = Callable[[SparkSession, str], DataFrame]
ATTRIBUTES = {"exp_name": ["exp0", "exp1", "exp2", "exp3"], "asic_temp": ["30.5", "31.5", None, "32.5"]}


def joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def rows_of(frame: DataFrame, array: str) -> DataFrame:
    """One row a sample, rounded."""
    return frame.select("read_id", F.posexplode(array).alias("pos", "x")).select("read_id", "pos", F.round("x", 6).alias("value"))


def read_slow5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "reads")
    slow5.write_slow5(px.reads(spark, sf_dir), path)
    back = slow5.read_slow5(spark, path)
    return back.select("read_id", "read_group", "digitisation", "offset", "range", "len_raw_signal", joined("raw_signal"), "median_before")


def read_slow5_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "reads")
    slow5.write_slow5(px.reads(spark, sf_dir), path, ATTRIBUTES)
    found = slow5.attach_attributes(slow5.read_slow5(spark, path), slow5.read_header(spark, path), list(ATTRIBUTES))
    return found.select("read_id", "read_group", *ATTRIBUTES)


def read_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "runs")
    slow5.write_slow5(px.reads(spark, sf_dir).withColumn("run", F.col("read_group")), path)
    return slow5.read_runs(spark, path).groupBy("run").agg(F.count("*").alias("n_reads"), F.sum("len_raw_signal").alias("n_samples"))


def read_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "calls")
    fastq.write_fastq(px.calls(spark, sf_dir), path)
    return fastq.read_fastq(spark, path, split_bytes=1 << 20).select("read_id", "seq", "qstring")


def read_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "alignments")
    px.alignment_lines(spark, sf_dir).select("value").write.text(path)
    return paf.read_paf(spark, path)


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = fresh_path(spark, "arriving")
    slow5.write_slow5(px.reads(spark, sf_dir), source)
    found = stream_reads(spark, source, fresh_path(spark, "sink"), fresh_path(spark, "progress"), lambda reads: signal.calibrate_signal(signal.drop_empty_reads(reads)))
    return rows_of(found, "signal")


def stream_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals to FASTQ in a stream: files of two column orders arrive, every read-level step runs, calls are read back."""
    source, sink = fresh_path(spark, "arriving"), fresh_path(spark, "called")
    reads = px.some_empty(px.reads(spark, sf_dir))
    first, *others = slow5.COLUMNS  # a read's id comes first in any file
    for k, names in enumerate(([first, *others], [first, *reversed(others)])):
        columns = {n: slow5.COLUMNS[n] for n in names}
        slow5.write_slow5(reads.where(F.col("read_group") % 2 == k), f"{source}/{k}", columns=columns)
    stream_calls(spark, f"{source}/*", sink, fresh_path(spark, "progress"), infer.step_caller, px.READ_PARAMS, F.col("read_group") % 2 == 1, ("empty_sequence", "empty_qualities"), bytes_per_trigger=64 << 20)
    return fastq.read_fastq(spark, sink).select("read_id", "seq", "qstring")


def write_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastq.fastq_lines(px.calls(spark, sf_dir))


def write_fastq_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order of their documents: written by ranges, read back and numbered by file and byte."""
    path = fresh_path(spark, "calls")
    fastq.write_fastq(px.calls(spark, sf_dir), path, ("doc_id",))
    reads = fastq.read_fastq(spark, path, split_bytes=1 << 20).select("path", "position", "read_id", F.length("seq").alias("n_bases"))  # bases are not moved
    return quality.numbered(reads).select("ordinal", "read_id", "n_bases")


def write_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a FASTQ write tells of itself, without a second pass."""
    told = fastq.write_fastq(px.calls(spark, sf_dir), fresh_path(spark, "calls"))
    return spark.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in told.items()])


def drop_empty_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.drop_empty_reads(px.some_empty(px.reads(spark, sf_dir))).select("read_id", "len_raw_signal")


def calibrate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(signal.calibrate_signal(px.reads(spark, sf_dir)), "signal")


def normalize_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(signal.normalize_signal(signal.calibrate_signal(px.reads(spark, sf_dir))), "signal")


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.chunk_plan(px.reads(spark, sf_dir), px.READ_PARAMS).select("read_id", "idx", "input_offset", "raw_chunk_size")


def chunk_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = px.reads(spark, sf_dir).withColumn("signal", F.col("raw_signal"))
    return signal.chunk_signal(reads, px.READ_PARAMS).select("read_id", "idx", "input_offset", "raw_chunk_size", joined("signal"))


def orient_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.orient_reads(px.calls(spark, sf_dir), F.col("doc_id") % 2 == 1).select("read_id", "seq", "qstring")


def sample_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = px.table(spark, sf_dir, "lineitem")
    kit = F.when(F.col("l_returnflag") == "A", "dna_r10.4.1_e8.2_400bps").when(F.col("l_returnflag") == "N", "rna004_130bps").otherwise("models/dna_r9.4.1_e8")
    tier = F.get(F.array(F.lit("fast"), F.lit("hac"), F.lit("sup")), (F.col("l_linenumber") % 3).cast("int"))
    return accuracy.sample_type(items.select("l_orderkey", "l_linenumber", F.concat(kit, F.lit("_"), tier, F.lit("@v5.0.0")).alias("model")))


def check_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("doc_id") % 7 == 0, px.half(F.col("qstring"))).otherwise(F.col("qstring"))
    return assemble.check_reads(px.calls(spark, sf_dir).withColumn("qstring", cut))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.alignment_identity(paf.parse_paf(px.alignment_lines(spark, sf_dir)))


def alignment_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("qname", "tname", "matches", "block_len", F.round("identity", 6).alias("identity"))


def preview_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.preview_reads(px.reads(spark, sf_dir), ("read_id",), batch_reads=20).select("read_id", "len_raw_signal")


def preview_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reads of several files as they stand there."""
    path = fresh_path(spark, "reads")
    slow5.write_slow5(px.reads(spark, sf_dir).repartitionByRange(4, "read_id").sortWithinPartitions("read_id"), path)
    return summary.preview_reads(slow5.read_slow5(spark, path, positions=True, only=["read_id", "len_raw_signal"]), ("path", "position"), batch_reads=20).select("read_id", "len_raw_signal")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.score_chunks(signal.chunk_signal(px.vectors(spark, sf_dir), px.CHUNK_PARAMS), infer.step_caller, px.CHUNK_PARAMS)


def score_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("read_id", "idx", "input_offset", joined("moves"), "seq", "qstring")


def emit_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.emit_bases(scored(spark, sf_dir)).select("read_id", "idx", "num_bases", "seq", "qstring")


def stitch_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.stitch_reads(infer.emit_bases(scored(spark, sf_dir)), px.CHUNK_PARAMS)


def stitch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stitch_reads with a read's chunks in one row from cut to join."""
    scores = infer.score_reads(signal.chunk_arrays(px.vectors(spark, sf_dir), px.CHUNK_PARAMS), infer.step_caller, px.CHUNK_PARAMS)
    return assemble.stitch_arrays(infer.emit_arrays(scores), px.CHUNK_PARAMS).select("read_id", "seq", "qstring")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored chunks, some without qualities, some with half their bases, some with three bases for one."""
    v = F.col("read_id").cast("long")
    return scored(spark, sf_dir).withColumns(
        {
            "qstring": F.when(v % 5 == 0, "").otherwise(F.col("qstring")),
            "seq": F.when(v % 7 == 0, px.half(F.col("seq"))).otherwise(F.col("seq")),
            "moves": F.when(v % 11 == 0, F.transform("moves", lambda m: (m * 3).cast("tinyint"))).otherwise(F.col("moves")),
        }
    )


def check_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("doc_id") % 7 == 0, px.half(F.col("qstring"))).otherwise(F.col("qstring"))
    return infer.check_calls(damaged(spark, sf_dir), px.calls(spark, sf_dir).withColumn("qstring", cut))


def quarantine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of both sinks by what they break; good ones break nothing."""
    good, broken = infer.quarantine(damaged(spark, sf_dir))
    both = good.select(F.lit("").alias("broken"), "seq").unionByName(broken.select(F.array_join("broken", ",").alias("broken"), "seq"))
    return both.groupBy("broken").agg(F.count("*").alias("n_chunks"), F.sum(F.length("seq")).alias("n_bases"))


def read_qscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    printable = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-~]", "")
    docs = px.table(spark, sf_dir, "documents").select("doc_id", printable.alias("qstring"))
    return quality.read_qscore(docs).select("doc_id", F.round("qscore", 6).alias("qscore"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = px.some_empty(px.reads(spark, sf_dir)).withColumn("run", F.col("read_group"))
    return summary.run_summary(reads, F.octet_length(slow5.render(reads.drop("run"))))


def rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes])


def identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.identity_summary(alignments(spark, sf_dir), ("run",)))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.compare_runs(alignments(spark, sf_dir).withColumnRenamed("run", "model"), ("O", "F")))


def accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = spark.range(1).select(F.inline(F.array(F.struct(F.lit("A").alias("model"), F.lit(0.8).alias("threshold")), F.struct(F.lit("N").alias("model"), F.lit(0.95).alias("threshold")))))
    return rounded(accuracy.accuracy_gate(alignments(spark, sf_dir).withColumnRenamed("run", "model"), thresholds))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = px.calls(spark, sf_dir).select("read_id", "lang", "qstring")
    return quality.compare_qscores(calls, calls.withColumn("qstring", px.half(F.col("qstring"))), ("read_id", "lang"), ("lang",))


def compare_qscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compared(spark, sf_dir))


def qscore_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.qscore_gate(compared(spark, sf_dir)).withColumnRenamed("lang", "model").select("model", "mean_abs_diff", "status"))


def call_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, signals to records: every read-level step in order, from raw samples to scored FASTQ records.

    Empty reads go; signals are calibrated, normalised, cut in chunks and scored; calls are checked, stitched, oriented by
    the sample type that the model's name tells, checked again, and written as records with their score.
    """
    model = F.when(F.col("read_group") % 2 == 0, "dna_r10.4.1_e8.2_400bps_hac@v5.0.0").otherwise("rna004_130bps_hac@v5.1.0")
    reads = accuracy.sample_type(signal.drop_empty_reads(px.some_empty(px.reads(spark, sf_dir))).withColumn("model", model))
    signals = signal.normalize_signal(signal.calibrate_signal(reads)).select("read_id", "sample_type", "len_raw_signal", "signal")
    scores = infer.score_chunks(signal.chunk_signal(signals, px.READ_PARAMS), infer.step_caller, px.READ_PARAMS)
    called = infer.emit_bases(scores, tolerate=("empty_sequence", "empty_qualities"))  # step_caller finds no base in a short chunk below the median
    stitched = assemble.stitch_reads(called, px.READ_PARAMS, ("read_id", "sample_type")).where(F.length("seq") > 0)
    whole = assemble.require_whole(assemble.orient_reads(stitched, F.col("sample_type") == "rna"))
    records = quality.read_qscore(whole).withColumn("value", fastq.record_text(F.col("read_id"), F.col("seq"), F.col("qstring")))
    return records.select("read_id", "sample_type", F.length("seq").alias("n_bases"), "value", F.round("qscore", 6).alias("qscore"))


def queries() -> dict[str, Query]:
    return {
        "read_slow5": read_slow5,
        "read_slow5_header": read_slow5_header,
        "read_runs": read_runs,
        "read_fastq": read_fastq,
        "read_paf": read_paf,
        "stream_reads": stream,
        "stream_fastq": stream_fastq,
        "write_fastq": write_fastq,
        "write_fastq_ordered": write_fastq_ordered,
        "write_totals": write_totals,
        "drop_empty_reads": drop_empty_reads,
        "calibrate_signal": calibrate_signal,
        "normalize_signal": normalize_signal,
        "chunk_plan": chunk_plan,
        "chunk_signal": chunk_signal,
        "orient_reads": orient_reads,
        "sample_type": sample_type,
        "check_reads": check_reads,
        "alignment_identity": alignment_identity,
        "preview_reads": preview_reads,
        "preview_file_order": preview_file_order,
        "score_chunks": score_chunks,
        "emit_bases": emit_bases,
        "stitch_reads": stitch_reads,
        "stitch_arrays": stitch_arrays,
        "check_calls": check_calls,
        "quarantine_calls": quarantine_calls,
        "read_qscore": read_qscore,
        "run_summary": run_summary,
        "identity_summary": identity_summary,
        "compare_runs": compare_runs,
        "accuracy_gate": accuracy_gate,
        "compare_qscores": compare_qscores,
        "qscore_gate": qscore_gate,
        "call_reads": call_reads,
    }


CALIBRATED = f"""WITH {px.READS_SQL}, pa AS (SELECT read_id, unnest(range(len(raw_signal)))::INT AS pos, (unnest(raw_signal) + "offset") * "range" / digitisation AS x, "offset" FROM reads)
SELECT read_id, pos, round(x, 6) AS value FROM pa"""
SCORE = "round(-10 * log10(greatest(list_sum(list_transform(string_split({q}, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0))) / length({q}), 1e-4)), 6)"
SCORES = "score AS (SELECT *, CASE WHEN length(qstring) > 0 THEN " + SCORE.format(q="qstring").removeprefix("round(").removesuffix(", 6)") + " END AS a, CASE WHEN length(h) > 0 THEN " + SCORE.format(q="h").removeprefix("round(").removesuffix(", 6)") + " END AS b FROM (SELECT *, substring(qstring, 1, length(qstring) // 2) AS h FROM calls))"
PLANNED = f"""WITH {px.READS_SQL}, plan AS (SELECT *, unnest(range(ceil(len_raw_signal / 50.0)::BIGINT)) AS i FROM reads),
placed AS (SELECT *, CASE WHEN len_raw_signal >= 60 THEN least(i * 50, len_raw_signal - 60) ELSE i * 50 END AS start FROM plan)"""
CALLED = "string_agg(base, '' ORDER BY k) FILTER (WHERE x > 0)"
QUALITIES = "string_agg(q, '' ORDER BY k) FILTER (WHERE x > 0)"


#: What step_caller makes of whole normalised reads, those of odd read groups reversed.
WHOLE = f"""{px.READS_SQL}, pa AS (SELECT read_id, read_group, list_transform(raw_signal, lambda v: (v + "offset") * "range" / digitisation) AS s FROM reads WHERE user_id % 5 <> 0),
middle AS (SELECT *, list_aggregate(s, 'median') AS m FROM pa), spread AS (SELECT *, nullif(list_aggregate(list_transform(s, lambda v: abs(v - m)), 'median'), 0) * 1.4826 AS d FROM middle),
sample AS (SELECT read_id, read_group, unnest(range(len(s))) AS i, (unnest(s) - m) / d AS x FROM spread),
called AS (SELECT *, CASE WHEN x > 0.1 THEN 'A' WHEN x > 0.05 THEN 'C' ELSE 'G' END AS base, chr((33 + least(40, floor(abs(x) * 100)))::INT) AS q FROM sample WHERE x > 0),
whole AS (SELECT read_id, read_group % 2 = 1 AS rna, string_agg(base, '' ORDER BY CASE WHEN read_group % 2 = 1 THEN -i ELSE i END) AS seq, string_agg(q, '' ORDER BY CASE WHEN read_group % 2 = 1 THEN -i ELSE i END) AS qs FROM called GROUP BY ALL)"""
#: Chunks as damaged() leaves them, with what the rules look at.
DAMAGED = f"""{px.CHUNKS_SQL}, lettered AS (SELECT vec_id, idx, count(*) FILTER (WHERE x > 0) AS c, coalesce({CALLED}, '') AS seq, coalesce({QUALITIES}, '') AS q FROM chunks GROUP BY vec_id, idx),
hurt AS (SELECT CASE WHEN vec_id % 11 = 0 THEN 3 * c ELSE c END AS n, CASE WHEN vec_id % 7 = 0 THEN substring(seq, 1, length(seq) // 2) ELSE seq END AS seq, CASE WHEN vec_id % 5 = 0 THEN '' ELSE q END AS q FROM lettered),
ruled AS (SELECT *, n > 20 AS more, least(length(seq), n) = 0 AS noseq, least(length(q), n) = 0 AS noq, least(length(seq), n) <> n OR least(length(q), n) <> n AS differ FROM hurt)"""
READ_RULES = "SELECT 'empty_sequence' AS rule, 'read' AS level, count(*) FILTER (WHERE length(seq) = 0) AS n FROM cut UNION ALL SELECT 'empty_qualities', 'read', count(*) FILTER (WHERE length(q) = 0) FROM cut UNION ALL SELECT 'lengths_differ', 'read', count(*) FILTER (WHERE length(seq) <> length(q)) FROM cut"


def oracle_sql() -> dict[str, str]:
    names = "read_id, read_group, digitisation, \"offset\", \"range\", len_raw_signal, array_to_string(raw_signal, ',') AS raw_signal, NULL::DOUBLE AS median_before"
    return {
        "stream_fastq": f"WITH {WHOLE} SELECT read_id, seq, qs AS qstring FROM whole",
        "write_fastq_ordered": f"WITH {px.CALLS_SQL} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, read_id, length(seq)::INT AS n_bases FROM calls WHERE seq <> ''",
        "write_totals": f"WITH {px.CALLS_SQL} SELECT count(*) AS reads, count(*) FILTER (WHERE seq = '') AS reads_without_bases, count(*) FILTER (WHERE seq <> '') AS records, (sum(strlen(read_id) + strlen(seq) + strlen(qstring) + 6) FILTER (WHERE seq <> ''))::BIGINT AS bytes FROM calls",
        "preview_file_order": f"WITH {px.READS_SQL} SELECT read_id, len_raw_signal FROM reads ORDER BY read_id LIMIT 20",
        "stitch_arrays": f"WITH {px.CHUNKS_SQL} SELECT vec_id::VARCHAR AS read_id, coalesce(string_agg(base, '' ORDER BY i) FILTER (WHERE x > 0), '') AS seq, coalesce(string_agg(q, '' ORDER BY i) FILTER (WHERE x > 0), '') AS qstring FROM called GROUP BY vec_id",
        "check_calls": f"""WITH {DAMAGED}, {px.CALLS_SQL.replace("calls AS", "documents_called AS")}, cut AS (SELECT seq, CASE WHEN doc_id % 7 = 0 THEN substring(qstring, 1, length(qstring) // 2) ELSE qstring END AS q FROM documents_called)
SELECT 'more_bases_than_steps' AS rule, 'chunk' AS level, count(*) FILTER (WHERE more) AS n FROM ruled UNION ALL SELECT 'empty_sequence', 'chunk', count(*) FILTER (WHERE noseq) FROM ruled
UNION ALL SELECT 'empty_qualities', 'chunk', count(*) FILTER (WHERE noq) FROM ruled UNION ALL SELECT 'lengths_differ', 'chunk', count(*) FILTER (WHERE differ) FROM ruled UNION ALL {READ_RULES}""",
        "quarantine_calls": f"""WITH {DAMAGED}, listed AS (SELECT seq, concat_ws(',', CASE WHEN more THEN 'more_bases_than_steps' END, CASE WHEN noseq THEN 'empty_sequence' END, CASE WHEN noq THEN 'empty_qualities' END, CASE WHEN differ THEN 'lengths_differ' END) AS broken FROM ruled)
SELECT broken, count(*) AS n_chunks, sum(length(seq))::BIGINT AS n_bases FROM listed GROUP BY broken""",
        "read_slow5": f"WITH {px.READS_SQL} SELECT {names} FROM reads",
        "read_slow5_header": f"WITH {px.READS_SQL} SELECT read_id, read_group, 'exp' || read_group AS exp_name, CASE read_group WHEN 0 THEN '30.5' WHEN 1 THEN '31.5' WHEN 3 THEN '32.5' END AS asic_temp FROM reads",
        "read_runs": f"WITH {px.READS_SQL} SELECT read_group::VARCHAR AS run, count(*) AS n_reads, sum(len_raw_signal)::BIGINT AS n_samples FROM reads GROUP BY 1",
        "read_fastq": f"WITH {px.CALLS_SQL} SELECT read_id, seq, qstring FROM calls WHERE seq <> ''",
        "read_paf": f"WITH {px.ALIGNMENTS_SQL} SELECT qname, tname, matches, block_len, mapq::INT AS mapq FROM alignments",
        "stream_reads": CALIBRATED,
        "write_fastq": f"WITH {px.CALLS_SQL}, text AS (SELECT read_id, '@' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qstring AS value FROM calls WHERE seq <> '') SELECT read_id, value, strlen(value) + 1 AS n_bytes FROM text",
        "drop_empty_reads": f"WITH {px.READS_SQL} SELECT read_id, len_raw_signal FROM reads WHERE user_id % 5 <> 0",
        "calibrate_signal": CALIBRATED,
        "normalize_signal": f"""WITH {px.READS_SQL}, pa AS (SELECT read_id, list_transform(raw_signal, lambda v: (v + "offset") * "range" / digitisation) AS s FROM reads),
middle AS (SELECT *, list_aggregate(s, 'median') AS m FROM pa), spread AS (SELECT *, nullif(list_aggregate(list_transform(s, lambda v: abs(v - m)), 'median'), 0) * 1.4826 AS d FROM middle)
SELECT read_id, unnest(range(len(s)))::INT AS pos, round((unnest(s) - m) / d, 6) AS value FROM spread""",
        "chunk_plan": f"{PLANNED} SELECT read_id, i::INT AS idx, start AS input_offset, least(60, len_raw_signal - start)::INT AS raw_chunk_size FROM placed",
        "chunk_signal": f"""{PLANNED}, cut AS (SELECT *, raw_signal[start + 1 : start + 60] AS part FROM placed)
SELECT read_id, i::INT AS idx, start AS input_offset, len(part)::INT AS raw_chunk_size, array_to_string(list_transform(range(60), lambda k: part[(k % len(part)) + 1]), ',') AS signal FROM cut""",
        "orient_reads": f"WITH {px.CALLS_SQL} SELECT read_id, CASE WHEN doc_id % 2 = 1 THEN reverse(seq) ELSE seq END AS seq, CASE WHEN doc_id % 2 = 1 THEN reverse(qstring) ELSE qstring END AS qstring FROM calls",
        "sample_type": """WITH named AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'dna_r10.4.1_e8.2_400bps' WHEN 'N' THEN 'rna004_130bps' ELSE 'models/dna_r9.4.1_e8' END
  || '_' || ['fast', 'hac', 'sup'][l_linenumber % 3 + 1] || '@v5.0.0' AS model FROM lineitem), base AS (SELECT *, string_split(model, '/')[-1] AS b FROM named)
SELECT l_orderkey, l_linenumber, model, regexp_extract(b, '^(dna|rna)', 1) AS sample_type, regexp_extract(b, '_(fast|hac|sup)(@|$)', 1) AS speed_tier, regexp_extract(b, '@(v[0-9.]+)$', 1) AS version FROM base""",
        "check_reads": f"""WITH {px.CALLS_SQL}, cut AS (SELECT seq, CASE WHEN doc_id % 7 = 0 THEN substring(qstring, 1, length(qstring) // 2) ELSE qstring END AS q FROM calls)
SELECT 'empty_sequence' AS rule, count(*) FILTER (WHERE length(seq) = 0) AS n_reads FROM cut UNION ALL SELECT 'empty_qualities', count(*) FILTER (WHERE length(q) = 0) FROM cut
UNION ALL SELECT 'lengths_differ', count(*) FILTER (WHERE length(seq) <> length(q)) FROM cut""",
        "alignment_identity": f"WITH {px.ALIGNMENTS_SQL} SELECT qname, tname, matches, block_len, round(identity, 6) AS identity FROM alignments",
        "preview_reads": f"WITH {px.READS_SQL} SELECT read_id, len_raw_signal FROM reads ORDER BY read_id LIMIT 20",
        "score_chunks": f"""WITH {px.CHUNKS_SQL} SELECT vec_id::VARCHAR AS read_id, idx::INT AS idx, input_offset, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, ',' ORDER BY k) AS moves,
  coalesce({CALLED}, '') AS seq, coalesce({QUALITIES}, '') AS qstring FROM chunks GROUP BY vec_id, idx, input_offset""",
        "emit_bases": f"WITH {px.CHUNKS_SQL} SELECT vec_id::VARCHAR AS read_id, idx::INT AS idx, (count(*) FILTER (WHERE x > 0))::INT AS num_bases, coalesce({CALLED}, '') AS seq, coalesce({QUALITIES}, '') AS qstring FROM chunks GROUP BY vec_id, idx",
        "stitch_reads": f"WITH {px.CHUNKS_SQL} SELECT vec_id::VARCHAR AS read_id, coalesce(string_agg(base, '' ORDER BY i) FILTER (WHERE x > 0), '') AS seq, coalesce(string_agg(q, '' ORDER BY i) FILTER (WHERE x > 0), '') AS qstring FROM called GROUP BY vec_id",
        "read_qscore": f"WITH printable AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS q FROM documents) SELECT doc_id, CASE WHEN length(q) > 0 THEN {SCORE.format(q='q')} END AS qscore FROM printable",
        "run_summary": f"""WITH {px.READS_SQL}, lost AS (SELECT *, user_id % 5 = 0 AS gone FROM reads),
lines AS (SELECT *, concat_ws(chr(9), read_id, read_group, '2048.0', (-(user_id % 256)) || '.0', '748.58', '4000.0', CASE WHEN gone THEN 0 ELSE len_raw_signal END,
  CASE WHEN gone THEN '' ELSE array_to_string(raw_signal, ',') END, '.', '.', '.', '.', '.', '.') AS line FROM lost)
SELECT read_group AS run, count(*) AS total_reads, sum(strlen(line))::BIGINT AS total_bytes, count(*) FILTER (WHERE NOT gone) AS reads_with_signal FROM lines GROUP BY 1""",
        "identity_summary": f"""WITH {px.ALIGNMENTS_SQL} SELECT run, round(avg(identity), 6) AS mean, round(stddev_samp(identity), 6) AS sstdev, round(quantile_cont(identity, 0.25), 6) AS q1,
  round(quantile_cont(identity, 0.5), 6) AS median, round(quantile_cont(identity, 0.75), 6) AS q3, count(identity) AS n FROM alignments GROUP BY run""",
        "compare_runs": f"WITH {px.ALIGNMENTS_SQL} SELECT run AS model, "
        + ", ".join(f"round(avg(identity) FILTER (WHERE caller = '{c}'), 6) AS \"{c}_mean\", round(quantile_cont(identity, 0.5) FILTER (WHERE caller = '{c}'), 6) AS \"{c}_median\"" for c in ("O", "F"))
        + " FROM alignments GROUP BY run",
        "accuracy_gate": f"""WITH {px.ALIGNMENTS_SQL}, medians AS (SELECT run AS model, quantile_cont(identity, 0.5) AS m FROM alignments GROUP BY run), t(model, threshold) AS (VALUES ('A', 0.8::DOUBLE), ('N', 0.95::DOUBLE))
SELECT medians.model, round(m, 6) AS median, threshold, CASE WHEN threshold IS NULL THEN 'unknown_model' WHEN m >= threshold THEN 'pass' ELSE 'fail' END AS status FROM medians LEFT JOIN t ON t.model = medians.model""",
        "compare_qscores": f"""WITH {px.CALLS_SQL}, {SCORES} SELECT lang, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n, round(avg(abs(a - b)), 6) AS mean_abs_diff,
  count(*) FILTER (WHERE a <> b) AS n_diff, 0::BIGINT AS n_left_only, 0::BIGINT AS n_right_only FROM score GROUP BY lang""",
        "qscore_gate": f"WITH {px.CALLS_SQL}, {SCORES} SELECT lang AS model, round(avg(abs(a - b)), 6) AS mean_abs_diff, CASE WHEN avg(abs(a - b)) <= 0.36 THEN 'pass' ELSE 'fail' END AS status FROM score GROUP BY lang",
        "call_reads": f"""WITH {WHOLE}
SELECT read_id, CASE WHEN rna THEN 'rna' ELSE 'dna' END AS sample_type, length(seq)::INT AS n_bases, '@' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qs AS value, {SCORE.format(q='qs')} AS qscore FROM whole""",
    }
