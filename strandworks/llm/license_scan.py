"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are sets of words; a block meets one if it has at least `least` of the template's words. Words are ordered by how
many documents have them, rarest first. A template whose overlap must be at least `need` words is filed under its first
size - need + 1 words only (prefix filter), a block must have `need` words of the templates' vocabulary (length filter), and
from where the first common word stands in both, enough words must still follow (positional filter). What remains is
verified by counting. Phrases are templates of the whole text that must be met in full; they are then checked word by word.

A template's deciding words (apache, mit, the 3 of a version) must all be there, as sibling licenses share most others.

Words are runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. Blocks are the whole text, and
overlapping windows of words, twice as wide as the longest notice and one such width apart: so a notice stands in one of them
whole, however it is wrapped. Null text is empty text: no words, no labels, score 0. Texts are scanned whole, equal texts once;
every row gets its result. An empty table gives an empty result.

All texts are cut into words once. That look leaves what the corpus-wide counts need, and the few texts that have enough words
of some template; only these are kept, dealt out and scanned.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from .common import lower_ascii, pick, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    scope: str  # "window", or "text" for a phrase
    least: float  # share of the template's distinct words
    must: str = ""  # words of it that must be there


#: The phrases and labels that the task gives.
PHRASES = (
    Template("cc-by", "cc by", "text", 1.0),
    Template("gpl", "general public license", "text", 1.0),
    Template("reserved", "all rights reserved", "text", 1.0),
)
#: How licenses announce themselves.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "window", 0.8, "apache 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "window", 0.8, "redistribution permitted"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "window", 0.9, "nc"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "window", 0.9, "sa"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "window", 0.8, "gnu 3"),
    Template("mit", "released under the mit license", "window", 0.8, "mit"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "window", 0.8, "permission granted free"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "window", 0.8, "mozilla"),
    Template("public-domain", "this work has been dedicated to the public domain", "window", 0.9, "public domain"),
)


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def needed(template: Template) -> int:
    """How many of the template's distinct words a block must have."""
    return max(1, math.ceil(template.least * len(set(plain_words(template.text))) - 1e-9))


def step_of(templates: tuple[Template, ...]) -> int:
    """How far windows are apart: as many words as the longest notice has. They are twice as wide."""
    return max([1, *(len(plain_words(t.text)) for t in templates if t.scope == "window")])


class Plan(NamedTuple):
    order: list[str]  # all template words, rarest first
    index: list[tuple[str, int, int, int, int]]  # word, template, its position there, template size, words needed
    sets: list[list[str]]  # each template's words in that order


def plan_templates(templates: tuple[Template, ...], frequency: dict[str, int]) -> Plan:
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted(set(plain_words(t.text)), key=rank.__getitem__) for t in templates]
    need = [needed(t) for t in templates]
    index = [(w, k, i, len(s), n) for k, (s, n) in enumerate(zip(sets, need, strict=True)) for i, w in enumerate(s[: len(s) - n + 1])]
    return Plan(order, index, sets)


def scan(texts: DataFrame, templates: tuple[Template, ...], plan: Plan) -> DataFrame:
    """texts (key, text) -> one row a block and template met: key, label, phrase, window, score, places.

    window is the first word of the block, null for the whole text; places has the starts (in words) of a phrase. As found,
    none capped.
    """
    step = step_of(templates)
    whole = texts.select("key", F.lit("text").alias("scope"), F.lit(None).cast("int").alias("window"), words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    windows = whole.select("key", F.lit("window").alias("scope"), F.explode(F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, F.lit(2 * step)).alias("w")))).alias("b")).select("key", "scope", F.col("b.s").alias("window"), F.col("b.w").alias("words"))
    # in the order of the vocabulary, whose own order is rarest first
    blocks = whole.unionByName(windows).withColumn("known", F.array_intersect(strings(plan.order), "words"))
    probe = blocks.select("*", F.posexplode("known").alias("j", "w"))
    index = F.inline(F.array(*[F.struct(F.lit(w).alias("_w"), F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("size"), F.lit(need).alias("need"), F.lit(templates[k].scope).alias("_scope")) for w, k, i, n, need in plan.index]))
    filed = F.broadcast(texts.sparkSession.range(1).select(index))  # as large as the given templates
    met = probe.join(filed, (F.col("w") == F.col("_w")) & (F.col("scope") == F.col("_scope")) & (F.size("known") >= F.col("need")))
    # only the first common word of a pair bounds what may follow
    first = met.groupBy("key", "scope", "window", "k").agg(F.min(F.struct("i", "j")).alias("at"), F.first("need").alias("need"), F.first("size").alias("size"), F.first("known").alias("known"), F.first("words").alias("words"))
    first = first.where(1 + F.least(F.col("size") - F.col("at.i") - 1, F.size("known") - F.col("at.j") - 1) >= F.col("need"))
    sets, must = F.array(*[strings(s) for s in plan.sets]), F.array(*[strings(plain_words(t.must)) for t in templates])
    overlap = F.size(F.array_intersect("known", F.get(sets, F.col("k"))))
    good = first.withColumn("overlap", overlap).where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except(F.get(must, F.col("k")), "known")) == 0))
    phrases = F.array(*[strings(plain_words(t.text)) for t in templates])
    phrase = F.get(phrases, F.col("k"))
    starts = F.sequence(F.lit(0), F.size("words") - F.size(phrase))
    places = F.when((F.col("scope") == "text") & (F.size("words") >= F.size(phrase)), F.filter(starts, lambda p: F.slice("words", p + 1, F.size(phrase)) == phrase))
    found = good.select("key", F.get(strings([t.label for t in templates]), F.col("k")).alias("label"), (F.col("scope") == "text").alias("phrase"), "window", (F.col("overlap") / F.col("size")).alias("score"), places.alias("places"))
    return found.where(~F.col("phrase") | (F.size("places") > 0))


def noted_texts(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, known (words of the templates), text and its key where it may meet one: a written table."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    vocabulary = strings(sorted({w for t in templates for w in plain_words(t.text)}))
    noted = rows.withColumn("_", let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.array_intersect(vocabulary, w).alias("known"))))
    # the length filter, and the deciding words, for the whole text
    enough = lambda t: (F.size(F.array_intersect("known", strings(sorted(set(plain_words(t.text)))))) >= needed(t)) & (F.size(F.array_except(strings(plain_words(t.must)), F.col("known"))) == 0)
    able = F.lit(False)
    for t in templates:
        able = able | enough(t)
    noted = noted.select("doc_id", "text", F.col("_.n_words").alias("n_words"), F.col("_.known").alias("known")).withColumn("able", able)
    return written(noted.select("doc_id", "n_words", "known", "able", F.when(F.col("able"), F.sha2(F.col("text").cast("binary"), 256)).alias("key"), F.when(F.col("able"), F.col("text")).alias("text")), "noted-texts")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, key, n_words) of every row, key null where no template can be met, and what scan() finds for the distinct texts by key."""
    noted = noted_texts(docs, templates)
    counts = noted.select(F.explode("known").alias("w")).groupBy("w").count().collect()  # as many as the templates have words
    frequency = dict.fromkeys({w for t in templates for w in plain_words(t.text)}, 0) | {r["w"]: r["count"] for r in counts}
    able = noted.where("able").select("key", "text").dropDuplicates(["key"])
    return noted.select("doc_id", "key", "n_words"), scan(able, templates, plan_templates(templates, frequency))


def license_documents(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a row."""
    rows, found = scan_licenses(docs, templates)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = found.groupBy("key").agg(
        F.sum(F.when(F.col("phrase"), F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    # written before it is joined, as only then can the rows of a hot text be split; rows without a key stay where they are
    met = rows.where("key is not null").join(written(by_text.withColumnRenamed("key", "_key"), "scanned-texts"), F.col("key") == F.col("_key"), "left")
    other = rows.where("key is null").select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in by_text.dtypes if c != "key"])
    return met.select(*other.columns).union(other).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_documents(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op1_sql(phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> str:
    """The rows of op1_license_scan in SQL, without any filter: every window against every notice."""
    word = "'" + WORD + "'"
    lower = lambda t: f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    step = step_of(phrases + notices)
    phrase_rows = ", ".join(f"('{t.label}', {listed(plain_words(t.text))})" for t in phrases)
    notice_rows = ", ".join(f"('{t.label}', {listed(sorted(set(plain_words(t.text))))}, {needed(t)}, {listed(plain_words(t.must))})" for t in notices)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {lower("coalesce(text, '')")} AS t FROM documents),
worded AS (SELECT r, doc_id, regexp_extract_all(t, {word}) AS w FROM docs),
phrases(label, p) AS (VALUES {phrase_rows}),
notices(label, s, need, must) AS (VALUES {notice_rows}),
places AS (SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS pos FROM worded, phrases),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
windows AS (SELECT r, unnest(list_transform(range(0, greatest(len(w), 1), {step}), lambda i: list_distinct(w[i + 1 : i + {2 * step}]))) AS lw FROM worded),
met AS (SELECT r, label, len(list_intersect(s, lw)) / len(s) AS score FROM windows, notices WHERE len(list_intersect(s, lw)) >= need AND list_has_all(lw, must)
  UNION ALL SELECT r, label, 1.0 FROM places),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0)::DOUBLE, 6) AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""
