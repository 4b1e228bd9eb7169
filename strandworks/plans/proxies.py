"""Reads, chunks, calls and alignments derived from the given tables, each with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import JobParams

READ_PARAMS = JobParams(chunk_size=60, overlap=10)
CHUNK_PARAMS = JobParams(chunk_size=20, overlap=4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A read has the events of one user among so many events at most, so no user's read grows with the table.
READ_EVENTS = 1 << 20


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read per user and block of event ids: its values in order of time, rounded down, are the raw signal."""
    block = F.floor(F.col("event_id") / READ_EVENTS).cast("long")
    events = table(spark, sf_dir, "events").select("user_id", block.alias("block"), F.struct("ts", "event_id", F.floor("value").cast("smallint").alias("v")).alias("e"))
    return (
        events.groupBy("user_id", "block")
        .agg(F.array_sort(F.collect_list("e")).alias("e"))
        .select(
            F.concat_ws(".", F.col("user_id").cast("string"), F.col("block").cast("string")).alias("read_id"),
            (F.col("user_id") % 4).alias("read_group"),
            F.lit(2048.0).alias("digitisation"),
            (-(F.col("user_id") % 256)).cast("double").alias("offset"),
            F.lit(748.58).alias("range"),
            F.lit(4000.0).alias("sampling_rate"),
            F.size("e").cast("long").alias("len_raw_signal"),
            F.col("e.v").alias("raw_signal"),
        )
    )


READS_SQL = f"""reads AS (SELECT user_id, user_id || '.' || event_id // {READ_EVENTS} AS read_id, user_id % 4 AS read_group, 2048.0::DOUBLE AS digitisation, (-(user_id % 256))::DOUBLE AS "offset", 748.58::DOUBLE AS "range",
  4000.0::DOUBLE AS sampling_rate, count(*)::BIGINT AS len_raw_signal, list(floor(value)::SMALLINT ORDER BY ts, event_id) AS raw_signal FROM events GROUP BY user_id, event_id // {READ_EVENTS})"""


def some_empty(frame: DataFrame) -> DataFrame:
    """Reads of which every fifth has lost its samples."""
    lost = F.substring_index("read_id", ".", 1).cast("long") % 5 == 0
    return frame.withColumns({"raw_signal": F.when(lost, F.array().cast("array<smallint>")).otherwise(F.col("raw_signal")), "len_raw_signal": F.when(lost, F.lit(0)).otherwise(F.col("len_raw_signal")).cast("long")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read per embedding: its numbers are the signal."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("read_id"), F.size("embedding").cast("long").alias("len_raw_signal"), F.col("embedding").alias("signal"))


#: Each sample of each chunk, with the base and quality that step_caller gives it.
CHUNKS_SQL = """samples AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
called AS (SELECT *, CASE WHEN x > 0.1 THEN 'A' WHEN x > 0.05 THEN 'C' ELSE 'G' END AS base, chr((33 + least(40, floor(abs(x) * 100)))::INT) AS q FROM samples),
plan AS (SELECT vec_id, unnest(range(ceil(len(embedding) / 16.0)::BIGINT)) AS idx, len(embedding) AS n FROM embeddings),
placed AS (SELECT vec_id, idx, CASE WHEN n >= 20 THEN least(idx * 16, n - 20) ELSE idx * 16 END AS input_offset FROM plan),
chunks AS (SELECT p.vec_id, p.idx, p.input_offset, c.i - p.input_offset AS k, c.x, c.base, c.q FROM placed p JOIN called c ON c.vec_id = p.vec_id AND c.i >= p.input_offset AND c.i < p.input_offset + 20)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A called read per document: the letters A, C, G and T of its text, each letter with a quality of its own."""
    seq = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", ""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("read_id"), "doc_id", "lang", seq.alias("seq"))
    return rows.withColumn("qstring", F.translate("seq", "ACGT", "+5?I"))


CALLS_SQL = """calls AS (SELECT doc_id, lang, doc_id::VARCHAR AS read_id, seq, translate(seq, 'ACGT', '+5?I') AS qstring
  FROM (SELECT *, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents))"""


def half(qstring: Column) -> Column:
    return F.substring(qstring, F.lit(1), F.floor(F.length(qstring) / 2).cast("int"))


def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PAF line per line item, with its run, caller and model."""
    n, m = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    zero, end = F.lit("0"), (n + m).cast("string")
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), end, zero, end, F.lit("+"), F.col("l_partkey").cast("string"), end, zero, end, n.cast("string"), end, F.lit("60"), F.lit("tp:A:P"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("caller"), line.alias("value"))


ALIGNMENTS_SQL = """alignments AS (SELECT l_orderkey::VARCHAR AS qname, l_partkey::VARCHAR AS tname, l_returnflag AS run, l_linestatus AS caller, l_quantity::BIGINT AS matches,
  l_quantity::BIGINT + l_linenumber AS block_len, 60 AS mapq, l_quantity::BIGINT::DOUBLE / (l_quantity::BIGINT + l_linenumber) AS identity FROM lineitem)"""
