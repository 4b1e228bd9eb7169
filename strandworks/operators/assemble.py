"""From chunk calls to reads: stitching, orientation, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import let
from ..params import JobParams


def stitch_reads(called: DataFrame, params: JobParams, keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """Chunk calls (keys, len_raw_signal, idx, input_offset, moves, seq, qstring) -> keys, seq, qstring.

    Neighbouring chunks are cut in the middle of their overlap, which is this library's own rule. Kept parts tile the
    signal, also where chunks coincide. At strides above 1 a cut inside a step may gain or lose that step's bases.
    """
    n, o, s = F.col("len_raw_signal"), F.col("input_offset"), params.stride
    order = Window.partitionBy(*keys).orderBy("idx")
    end = o + F.least(F.lit(params.samples), n - o)
    ended = called.withColumn("_end", end)
    cut = F.col("_end") - F.floor((F.col("_end") - F.lead("input_offset").over(order)) / 2)
    bounded = ended.withColumn("_hi", F.coalesce(cut, n))
    bounded = bounded.withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0)))
    steps = lambda x: F.greatest(F.lit(0), F.ceil((x - o) / F.lit(s))).cast("int")
    bases = lambda moves: F.aggregate(moves, F.lit(0), lambda a, m: a + m)
    part = bounded.select(*keys, "idx", "moves", "seq", "qstring", steps(F.col("_lo")).alias("_a"), steps(F.col("_hi")).alias("_b"))
    part = part.select(*keys, "idx", "seq", "qstring", bases(F.slice("moves", F.lit(1), F.col("_a"))).alias("_skip"), bases(F.slice("moves", F.col("_a") + 1, F.greatest(F.col("_b") - F.col("_a"), F.lit(0)))).alias("_take"))
    text = lambda c: F.substring(c, F.col("_skip") + 1, F.col("_take")).alias(c)
    whole = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", text("seq"), text("qstring")))).alias("c"))
    return whole.select(*keys, F.array_join("c.seq", "").alias("seq"), F.array_join("c.qstring", "").alias("qstring"))


def stitch_arrays(called: DataFrame, params: JobParams) -> DataFrame:
    """Reads (len_raw_signal, chunks: an array of idx, input_offset, moves, seq, qstring, ...) with seq and qstring in place of chunks.

    The rule of stitch_reads(), within one row: neither window nor shuffle, so streams can have it too. Chunks may stand in
    any order.
    """
    n, s = F.col("len_raw_signal"), params.stride
    ordered = F.array_sort("chunks", lambda x, y: F.when(x["idx"] < y["idx"], -1).when(x["idx"] > y["idx"], 1).otherwise(0))
    placed = called.withColumn("chunks", ordered)
    start = lambda i: F.get("chunks", i)["input_offset"]
    end = lambda o: o + F.least(F.lit(params.samples), n - o)
    cut = lambda o, following: end(o) - F.floor((end(o) - following) / 2)
    bases = lambda moves: F.aggregate(moves, F.lit(0), lambda a, m: a + m)

    def kept(c: Column, i: Column) -> Column:
        o = c["input_offset"]
        step = lambda x: F.greatest(F.lit(0), F.ceil((x - o) / F.lit(s))).cast("int")
        lo, hi = F.when(i == 0, F.lit(0)).otherwise(cut(start(i - 1), o)), F.coalesce(cut(o, start(i + 1)), n)
        skip, take = bases(F.slice(c["moves"], F.lit(1), step(lo))), bases(F.slice(c["moves"], step(lo) + 1, F.greatest(step(hi) - step(lo), F.lit(0))))
        return let(F.struct(skip.alias("skip"), take.alias("take")), lambda p: F.struct(*[F.substring(c[t], p["skip"] + 1, p["take"]).alias(t) for t in ("seq", "qstring")]))

    parts = placed.withColumn("chunks", F.transform("chunks", kept))
    return parts.withColumns({t: F.array_join(F.col(f"chunks.{t}"), "") for t in ("seq", "qstring")}).drop("chunks")


def orient_reads(reads: DataFrame, is_rna: Column) -> DataFrame:
    """reads with bases and qualities reversed where is_rna; not complemented."""
    return reads.withColumns({c: F.when(is_rna, F.reverse(c)).otherwise(F.col(c)) for c in ("seq", "qstring")})


def integrity_rules(reads: DataFrame) -> dict[str, Column]:
    """Rules by name, true where broken."""
    rules = {
        "empty_sequence": F.coalesce(F.length("seq"), F.lit(0)) == 0,
        "empty_qualities": F.coalesce(F.length("qstring"), F.lit(0)) == 0,
        "lengths_differ": ~F.length("seq").eqNullSafe(F.length("qstring")),
    }
    if {"raw_signal", "len_raw_signal"} <= set(reads.columns):
        rules["signal_length_differs"] = ~F.size("raw_signal").eqNullSafe(F.col("len_raw_signal"))
    return rules


def broken_rules(reads: DataFrame) -> Column:
    """Names of the rules that a read breaks, comma-joined."""
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in integrity_rules(reads).items()])


def require_whole(reads: DataFrame) -> DataFrame:
    """reads as they are; one that breaks a rule ends the job, whichever columns are asked for."""
    error = F.raise_error(F.concat(F.lit("read "), F.coalesce("read_id", F.lit("?")), F.lit(": "), broken_rules(reads))).cast("boolean")
    return reads.where(F.when(broken_rules(reads) != "", error).otherwise(F.lit(True)))


def rule_counts(frame: DataFrame, rules: dict[str, Column], count: str) -> DataFrame:
    """How many rows break each rule (rule, count), rules that none breaks included."""
    counts = frame.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias(count)) for n in rules])))


def check_reads(reads: DataFrame, strict: bool = False) -> DataFrame:
    """How many reads break each rule (rule, n_reads), rules that none breaks included; strict: the first one ends the job."""
    rules = integrity_rules(reads)
    if strict:
        reads = require_whole(reads)
    return rule_counts(reads, rules, "n_reads")
