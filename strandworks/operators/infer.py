"""Scoring chunks with a model of the user's, and taking bases from what it returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import fresh_path
from ..params import JobParams
from .assemble import integrity_rules, rule_counts

Called = tuple[list[int], str, str]
Model = Callable[[np.ndarray], list[Called]]


#: A Python worker keeps so many models; the one built first goes first.
MOST_MODELS = 4
_MODELS: dict[str, Model] = {}


def worker_model(token: str, make_model: Callable[[], Model]) -> Model:
    """The model of this token in this Python worker, built when the worker first asks for it.

    Spark hands tasks to workers that live on, so a worker's tasks share what one of them has built.
    """
    if token not in _MODELS:
        while len(_MODELS) >= MOST_MODELS:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[token] = make_model()
    return _MODELS[token]


def matrix(signals: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as rows."""
    return np.asarray(signals.flatten()).reshape(len(signals), -1)


def score_chunks(chunks: DataFrame, make_model: Callable[[], Model], params: JobParams | None = None, token: str | None = None) -> DataFrame:
    """chunks (…, signal) -> the other columns, moves, seq, qstring.

    make_model() runs once a Python worker; what it returns gets batches of at most params.batch_chunks chunks, N x samples,
    and returns moves, bases and qualities of each. The last batch of a task is as short as it is. Queries that name the same
    token share a worker's model; without one, each has its own. Large weights go to the workers as files
    (SparkContext.addFile) that make_model() opens.
    """
    batch, token = (params or JobParams()).batch_chunks, token or uuid.uuid4().hex
    kept = [f for f in chunks.schema.fields if f.name != "signal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(token, make_model)
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                called = model(matrix(b.column("signal")))
                made = [pa.array([m for m, _, _ in called], pa.list_(pa.int8())), pa.array([s for _, s, _ in called]), pa.array([q for _, _, q in called])]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *made], [*(f.name for f in kept), "moves", "seq", "qstring"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return chunks.mapInArrow(run, f"{out}, moves array<tinyint>, seq string, qstring string")


SCORED = "array<struct<idx:int,input_offset:bigint,moves:array<tinyint>,seq:string,qstring:string>>"
_SCORED = pa.list_(pa.struct([("idx", pa.int32()), ("input_offset", pa.int64()), ("moves", pa.list_(pa.int8())), ("seq", pa.string()), ("qstring", pa.string())]))


def score_reads(reads: DataFrame, make_model: Callable[[], Model], params: JobParams | None = None, token: str | None = None) -> DataFrame:
    """reads (…, chunks as chunk_arrays() makes them) -> the other columns, chunks of idx, input_offset, moves, seq, qstring.

    As score_chunks(), but a read stays one row; chunks of several reads share a batch of the model.
    """
    batch, token = (params or JobParams()).batch_chunks, token or uuid.uuid4().hex
    kept = [f for f in reads.schema.fields if f.name != "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(token, make_model)
        for b in batches:
            chunks = b.column("chunks")
            flat = chunks.flatten()
            called: list[Called] = []
            for i in range(0, len(flat), batch):
                called += model(matrix(pc.struct_field(flat.slice(i, batch), "signal")))
            made = [pc.struct_field(flat, "idx"), pc.struct_field(flat, "input_offset"), pa.array([m for m, _, _ in called], pa.list_(pa.int8())), pa.array([s for _, s, _ in called], pa.string()), pa.array([q for _, _, q in called], pa.string())]
            offsets = pa.array(np.r_[0, np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))], pa.int32())
            scored = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, fields=list(_SCORED.value_type)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), scored], [*(f.name for f in kept), "chunks"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return reads.mapInArrow(run, f"{out}, chunks {SCORED}")


def step_caller() -> Model:
    """A model without weights, for tests: a base at each sample above 0, its letter and quality by its size."""

    def call(signals: np.ndarray) -> list[Called]:
        x = signals.astype(np.float64)
        letters = np.where(x > 0.1, "A", np.where(x > 0.05, "C", "G"))
        quality = 33 + np.minimum(40, np.floor(np.abs(x) * 100)).astype(int)
        out = []
        for row in range(len(x)):
            hit = np.flatnonzero(x[row] > 0)
            out.append(((x[row] > 0).astype(int).tolist(), "".join(letters[row, hit]), "".join(map(chr, quality[row, hit]))))
        return out

    return call


def rules_of_call(moves: Column, seq: Column, qstring: Column) -> dict[str, Column]:
    """What a decoder may not return of a chunk, by name, true where broken."""
    count = F.coalesce(moved(moves), F.lit(0))
    bases, qualities = (F.least(F.coalesce(F.length(c), F.lit(0)), count) for c in (seq, qstring))
    return {
        "more_bases_than_steps": count > F.coalesce(F.size(moves), F.lit(0)),
        "empty_sequence": bases == 0,
        "empty_qualities": qualities == 0,
        "lengths_differ": (bases != count) | (qualities != count),
    }


def call_rules(scored: DataFrame) -> dict[str, Column]:
    """rules_of_call() of the rows that score_chunks() gives."""
    return rules_of_call(F.col("moves"), F.col("seq"), F.col("qstring"))


def moved(moves: Column) -> Column:
    return F.aggregate(moves, F.lit(0), lambda a, m: a + m)


def broken_by(rules: dict[str, Column], tolerate: tuple[str, ...] = ()) -> Column:
    """Names of the rules that are broken, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items() if n not in tolerate]))


def emit_bases(scored: DataFrame, mode: str = "failfast", tolerate: tuple[str, ...] = ()) -> DataFrame:
    """scored chunks with num_bases = sum(moves), and seq and qstring cut to that many characters.

    A chunk that breaks one of call_rules() ends the job; mode flag keeps it and lists what it breaks in a column broken.
    Rules in tolerate are not looked at: a model that finds no base in noise needs that of empty sequences and qualities.
    """
    checked = scored.withColumn("broken", broken_by(call_rules(scored), tolerate))
    if mode == "failfast":
        error = F.raise_error(F.concat(F.lit("a decoder's output breaks: "), F.array_join("broken", ", "))).cast("boolean")
        checked = checked.where(F.when(F.size("broken") > 0, error).otherwise(F.lit(True))).drop("broken")  # in a filter, so that no plan prunes it
    return checked.withColumn("num_bases", moved(F.col("moves"))).withColumns({c: F.substring(c, F.lit(1), F.col("num_bases")) for c in ("seq", "qstring")})


def emit_arrays(scored: DataFrame, mode: str = "failfast", tolerate: tuple[str, ...] = ()) -> DataFrame:
    """As emit_bases(), of the arrays that score_reads() gives: num_bases, and broken in mode flag, are fields of each chunk."""
    count = lambda c: F.coalesce(moved(c["moves"]), F.lit(0))
    cut = lambda c, n: [F.substring(c[t], F.lit(1), n).alias(t) for t in ("seq", "qstring")]
    broken = lambda c: broken_by(rules_of_call(c["moves"], c["seq"], c["qstring"]), tolerate)
    last = lambda c: [broken(c).alias("broken")] if mode == "flag" else []
    if mode == "failfast":
        found = F.array_distinct(F.flatten(F.transform("chunks", broken)))
        error = lambda x: F.raise_error(F.concat(F.lit("a decoder's output breaks: "), F.array_join(x, ", "))).cast("boolean")
        scored = scored.where(F.when(F.size(found) > 0, error(found)).otherwise(F.lit(True)))
    return scored.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["input_offset"].alias("input_offset"), c["moves"].alias("moves"), count(c).alias("num_bases"), *cut(c, count(c)), *last(c))))


def quarantine(scored: DataFrame, path: str | None = None, tolerate: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """scored chunks -> those that break no rule, as emit_bases() gives them, and those that do, with what they break.

    Both are written in one pass, in folders of their own below path, so a model runs once for the two; path is a new folder
    of the shared one unless given. A broken chunk is kept as the decoder returned it.
    """
    path = path or fresh_path(scored.sparkSession, "quarantine")
    flagged = scored.withColumn("broken", broken_by(call_rules(scored), tolerate))
    flagged.withColumn("state", F.when(F.size("broken") > 0, "broken").otherwise("good")).write.partitionBy("state").parquet(path)
    back = scored.sparkSession.read.schema(flagged.schema.add("state", "string")).parquet(path)
    good = back.where("state = 'good'").drop("state", "broken")
    good = good.withColumn("num_bases", moved(F.col("moves"))).withColumns({c: F.substring(c, F.lit(1), F.col("num_bases")) for c in ("seq", "qstring")})
    return good, back.where("state = 'broken'").drop("state")


def check_calls(scored: DataFrame, reads: DataFrame) -> DataFrame:
    """How many chunks break each rule of a decoder's output, and how many of the reads made of them each rule of reads.

    rule, level (chunk or read), n; rules that none breaks are listed.
    """
    chunks = rule_counts(scored, call_rules(scored), "n").withColumn("level", F.lit("chunk"))
    whole = rule_counts(reads, integrity_rules(reads), "n").withColumn("level", F.lit("read"))
    return chunks.unionByName(whole).select("rule", "level", "n")
