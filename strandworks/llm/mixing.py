"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, in DataFrame functions only.

Documents fall in cells by source, language and topic. Cells' token counts are raked: each sweep scales them to the source
targets, then to the language targets, then to the topic targets, until all margins are met. A cell's fitted share over its
own tokens is the weight of its documents; times the fraction of the corpus it is how often a document is wanted.

The sample has no document twice, and its expected tokens have the target mix: every probability is the weight times one
factor, the fraction asked for or, where that would make the scarcest cell's probability more than 1, the largest that does
not. So scarce cells bound the size of the sample, never its mix. Who wants the fraction in any case takes `copies`: weight
times fraction, rounded up or down by a hash of doc_id, which repeats the documents of scarce cells; repeated_sample() does.
`reached` is that factor, the share of all tokens that the sample is expected to have; reached_margins() tells the shares of
values in both.

Targets are shares by value; a value without a given target gets the tempered share of its tokens (tokens^temperature, over
what the given targets leave). All three are tempered by default: sources and languages by the root, topics, which are
forms of text here as the tables name none, by a little only, as the scarcest form bounds the sample. Null sources and languages are values of their own (shown as null); null text has no
tokens and counts as one, so that it can be sampled. Repeated rows of a doc_id share their fate. Targets that no weights meet,
as of values that never meet, are approached until MOST_SWEEPS. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCUMENT_COLUMNS, pick, table, written

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.5, "lang": 0.5, "topic": 0.95}
FRACTION = 0.5
#: Raking ends when no margin is off by more than TOLERANCE, or after MOST_SWEEPS.
TOLERANCE = 1e-13
MOST_SWEEPS = 40
#: Cell tables up to this size are raked in one partition and broadcast; larger ones are dealt out and joined by shuffle. The
#: result is the same.
SMALL_CELLS = 20_000
PLAN_SWEEPS = 8


def tokens(text: Column) -> Column:
    """Words divided by white space, at least 1."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)), F.lit(1)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: tabular, marked-up, shouted, brief or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(n, F.lit(1))
    return (
        F.when(n < 200, "brief")
        .when(share("[|]") > 0.02, "table")
        .when(share("[#$%&*<>{}]") > 0.05, "markup")
        .when(share("[A-Z]") > 0.3, "shout")
        .otherwise("prose")
    )


def targets(cells: DataFrame, dimension: str, given: dict[str, float], temperature: float) -> DataFrame:
    """cells with target_<dimension>, the wanted share of the cell's value."""
    own = Window.partitionBy(dimension)
    fixed = F.lit(None).cast("double")
    for value, share in given.items():
        fixed = F.when(F.col(dimension) == value, float(share)).otherwise(fixed)
    out = cells.withColumns({"_fixed": fixed, "_tempered": F.pow(F.sum("n").over(own).cast("double"), F.lit(temperature)), "_cells": F.count("*").over(own)})
    free = out.where("_fixed is null").agg(F.sum(F.col("_tempered") / F.col("_cells"))).first()[0] or 1.0
    left = max(0.0, 1 - sum(given.values()))
    return out.withColumn(f"target_{dimension}", F.coalesce("_fixed", F.lit(left) * F.col("_tempered") / F.lit(free))).drop("_fixed", "_tempered", "_cells")


def rake(cells: DataFrame, sweeps: int) -> DataFrame:
    """cells (dimensions, share, target_*) with share fitted to each dimension's targets in turn, `sweeps` times, and how far a margin of the cell is off."""
    margin = lambda d: F.sum("share").over(Window.partitionBy(d))
    for _ in range(sweeps):
        for d in DIMENSIONS:
            cells = cells.withColumn("share", F.coalesce(F.try_divide(F.col("share") * F.col(f"target_{d}"), margin(d)), F.lit(0.0)))
    return cells.withColumn("off", F.greatest(*[F.abs(margin(d) - F.col(f"target_{d}")) for d in DIMENSIONS]))


def probabilities(cells: DataFrame, fraction: float) -> DataFrame:
    """cells (n, share) with weight, how much more of the cell is wanted than there is, probability and reached.

    probability is weight times reached, the largest factor, up to fraction, that keeps it at 1.
    """
    total, most = cells.agg(F.sum("n"), F.max(F.col("share") / F.col("n"))).first()
    weight = F.col("share") * F.lit(float(total or 0)) / F.col("n")
    factor = min(fraction, 1 / (most * total)) if most else fraction
    return cells.withColumn("weight", weight).withColumn("probability", F.least(F.lit(1.0), F.lit(factor) * F.col("weight"))).withColumn("reached", F.lit(factor))


def uniform(doc_id: Column) -> Column:
    """0 to 1 by a hash of doc_id as text; SQL engines that have md5 give the same."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def fitted_cells(rows: DataFrame, given: dict[str, dict[str, float]], fraction: float, temperatures: dict[str, float], most_sweeps: int) -> tuple[DataFrame, bool]:
    """rows (dimensions, tokens) -> cells (dimensions, n, weight, probability), and whether they are few.

    Few cells are raked in one partition, without exchanges, PLAN_SWEEPS sweeps a written table. Many are dealt out by window,
    one sweep a written table. So no plan grows with the sweeps.
    """
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("n")), "cells")
    small = cells.count() <= SMALL_CELLS
    if small:
        cells = cells.coalesce(1)
    for d in DIMENSIONS:
        cells = targets(cells, d, given.get(d, {}), temperatures[d])
    cells = cells.withColumn("share", F.col("n").cast("double"))
    at_once = PLAN_SWEEPS if small else 1
    for done in range(0, most_sweeps, at_once):
        cells = written(rake(cells.coalesce(1) if small else cells, min(at_once, most_sweeps - done)), "raked")
        if (cells.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    whole = cells.agg(F.sum("share")).first()[0] or 1.0
    return probabilities(cells.withColumn("share", F.col("share") / F.lit(whole)), fraction), small


def mix_documents(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, temperatures: dict[str, float] | None = None, most_sweeps: int = MOST_SWEEPS) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) -> the same columns, tokens, topic, weight, probability, reached, sampled, copies: all rows.

    weight is the fitted share of the document's cell over its tokens, times all tokens: 1 where the mix is as wanted.
    copies is weight times fraction, rounded up if a hash of doc_id is below what is left of it, else down.
    """
    rows = pick(docs, *DOCUMENT_COLUMNS).withColumns({"tokens": tokens(F.col("text")), "topic": topic(F.col("text"))})
    cells, small = fitted_cells(rows.select(*DIMENSIONS, "tokens"), given or {}, fraction, TEMPERATURES | (temperatures or {}), most_sweeps)
    own = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "probability", "reached")
    met = rows.join(F.broadcast(own) if small else written(own, "fitted"), F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("topic") == F.col("_topic")))
    return met.drop(*[f"_{d}" for d in DIMENSIONS]).withColumn("sampled", uniform(F.col("doc_id")) < F.col("probability")).withColumn("copies", copies(F.col("doc_id"), F.lit(fraction) * F.col("weight")))


def copies(doc_id: Column, rate: Column) -> Column:
    """How often a document stands in the sample that may repeat it: rate in the mean."""
    return (F.floor(rate) + (uniform(doc_id) < rate - F.floor(rate)).cast("long")).cast("long")


def repeated_sample(docs: DataFrame, **options) -> DataFrame:
    """The sample of the wanted fraction: each document `copies` times, columns of documents; options of mix_documents()."""
    mixed = mix_documents(docs, **options).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*DOCUMENT_COLUMNS)


def reached_margins(mixed: DataFrame) -> DataFrame:
    """mix_documents() -> dimension, value and its shares of tokens: plain, wanted, expected, drawn, repeated.

    wanted is the fitted mix; expected and drawn are of `sampled`, before and after the draw; repeated is of repeated_sample().
    """
    shares = {"plain": F.lit(1.0), "wanted": F.col("weight"), "expected": F.col("probability"), "drawn": F.col("sampled").cast("double"), "repeated": F.col("copies").cast("double")}
    sums = written(mixed.groupBy(*DIMENSIONS).agg(*[F.sum(F.col("tokens") * c).alias(k) for k, c in shares.items()]), "margins")
    whole = sums.agg(*[F.sum(k).alias(f"_{k}") for k in shares])
    out = None
    for d in DIMENSIONS:
        one = sums.groupBy(F.col(d).alias("value")).agg(*[F.sum(k).alias(k) for k in shares]).crossJoin(F.broadcast(whole))
        one = one.select(F.lit(d).alias("dimension"), "value", *[F.try_divide(k, f"_{k}").alias(k) for k in shares])
        out = one if out is None else out.unionByName(one)
    return out


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their calibrated probability and whether they are in the sample."""
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled", F.round("reached", 6).alias("reached"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, columns of documents."""
    return mix_documents(docs).where("sampled").select(*DOCUMENT_COLUMNS)


def op10_sql(fraction: float = FRACTION, temperatures: dict[str, float] = TEMPERATURES, sweeps: int = MOST_SWEEPS) -> str:
    """The rows of op10_mixing in SQL: one common table expression a raking step."""
    share = lambda chars: f"(length(t) - length(translate(t, '{chars}', ''))) / greatest(length(t), 1)"
    steps = [
        f"""docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, greatest(len(regexp_extract_all(coalesce(text, 'x'), '\\S+')), 1) AS tokens FROM documents),
formed AS (SELECT doc_id, source, lang, tokens, CASE WHEN length(t) < 200 THEN 'brief' WHEN {share("|")} > 0.02 THEN 'table' WHEN {share("#$%&*<>{}")} > 0.05 THEN 'markup'
  WHEN {share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} > 0.3 THEN 'shout' ELSE 'prose' END AS topic FROM docs),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM formed GROUP BY ALL)"""
    ]
    wanted = ", ".join(f"(SELECT pow(sum(n), {temperatures[d]}) FROM cells x WHERE x.{d} IS NOT DISTINCT FROM c.{d}) / (SELECT sum(p) FROM (SELECT pow(sum(n), {temperatures[d]}) AS p FROM cells GROUP BY {d})) AS target_{d}" for d in DIMENSIONS)
    steps.append(f"s0 AS MATERIALIZED (SELECT *, n AS share, {wanted} FROM cells c)")
    k = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            steps.append(f"s{k + 1} AS MATERIALIZED (SELECT * REPLACE (share * target_{d} / sum(share) OVER (PARTITION BY {d}) AS share) FROM s{k})")
            k += 1
    steps.append(f"whole AS MATERIALIZED (SELECT * REPLACE (share / sum(share) OVER () AS share), sum(n) OVER () AS total FROM s{k})")
    steps.append(f"scaled AS (SELECT *, share * total / n AS weight, least({fraction}, 1 / (max(share / n) OVER () * total)) AS reached FROM whole)")
    steps.append("final AS (SELECT source, lang, topic, weight, least(1, reached * weight) AS probability, reached FROM scaled)")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT doc_id, d.source, d.lang, d.topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,"
        " ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296 < probability AS sampled, round(reached, 6) AS reached"
        " FROM formed d JOIN final f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic"
    )
