"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit values, in DataFrame functions only.

A document's shingles are runs of five words (fewer words make one shingle). Each is hashed once; the top bits of the hash
name one of BINS bins, and a bin keeps its smallest hash. An empty bin takes the value of an occupied one, found by probing
bins in an order that depends on the empty bin alone; so two documents with the same occupied bins fill alike. A fingerprint
stores the low BITS bits of each bin as two hex digits. Values agree by chance with probability 2^-BITS, which likeness()
corrects.

Null text is empty text. A text without words has the empty fingerprint: alike (1.0) to another such, unlike (0.0) to all
others. Rows are ordered by doc_id, null first, ties by text hash; the row after the last is the first, so a single row is
its own successor. An empty table gives an empty result.

Successors are found in ranges of that order. Ranges are cut by bytes of text, at points (doc_id, text hash), so long texts and
a doc_id of many rows, null among them, make more ranges and no larger ones; equal rows alone stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import let
from .common import pick, table

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
PROBES = 6
LEAST_LONG = -(1 << 63)
RANGE_BYTES = 8 << 20
POINTS = 8
#: Ranges there are at most, whatever the table: the driver cuts so many, and the plan names their beginnings.
MOST_RANGES = 16_384


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(found: Column) -> Column:
    """Hashes of the runs of SHINGLE words; one hash of all words where there are fewer, none where there are none."""
    n = F.size(found)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + j) for j in range(SHINGLE)]))  # no word, no part of the hash


def bin_of(h: Column) -> Column:
    """0 to BINS - 1, in the order of signed hashes."""
    return F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each occupied bin, in the order of bins: sorted hashes have bins together, smallest first."""
    return let(F.sort_array(hashes), lambda h: F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BIN_BITS) != F.shiftright(F.get(h, i - 1), 64 - BIN_BITS))))


def scattered(values: Column, bins: Column) -> Column:
    """An array of BINS elements with values[i] at bins[i], ascending, and null elsewhere, made in one pass."""
    gap = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
    runs = F.transform(values, lambda v, i: F.concat(gap(F.get(bins, i) - F.coalesce(F.get(bins, i - 1), F.lit(-1)) - 1), F.array(v)))
    return F.flatten(F.concat(runs, F.array(gap(F.lit(BINS - 1) - F.get(bins, F.size(bins) - 1)))))


def densified(minima: Column) -> Column:
    """The low bits of each bin's value as hex digits, empty bins filled.

    Empty bin k tries bins hash(k, 1), hash(k, 2), ... and takes the first occupied one; after PROBES misses, the occupied bin
    that comes first in an order of all bins drawn for k.
    """
    low = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0")
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    probe = lambda d, k, t: F.get(d, F.pmod(F.xxhash64(k, F.lit(t)), F.lit(BINS)).cast("int"))
    last = lambda k: low(F.array_min(F.transform(minima, lambda x: F.struct(F.xxhash64(k, bin_of(x)).alias("r"), x.alias("x"))))["x"])
    fill = lambda d: F.transform(every, lambda k: F.coalesce(F.get(d, k), *[probe(d, k, t) for t in range(1, PROBES + 1)], last(k)))
    filled = let(let(F.transform(minima, bin_of), lambda bins: scattered(F.transform(minima, low), bins)), fill)
    return F.when(F.size(minima) == BINS, F.transform(minima, low)).when(F.size(minima) == 0, F.array().cast("array<string>")).otherwise(filled)


def fingerprint(text: Column) -> Column:
    values = let(words(F.coalesce(text, F.lit(""))), lambda w: let(bin_minima(shingle_hashes(w)), densified))
    return F.array_join(values, "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    width, chance = BITS // 4, 2.0**-BITS
    at = F.sequence(F.lit(0), F.lit(BINS - 1))
    agree = F.size(F.filter(at, lambda k: F.substring(a, k * width + 1, F.lit(width)) == F.substring(b, k * width + 1, F.lit(width))))
    estimate = (agree / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def range_starts(rows: DataFrame, range_bytes: int) -> list[tuple[int, int]]:
    """Where ranges of about range_bytes of text begin, ascending (key, tie); the first row of all is the first.

    Rows are drawn by a hash with a probability in proportion to their bytes, POINTS for each range, so as many points as
    make a range stand for range_bytes. The driver gets 16 bytes for each point, which are about POINTS * MOST_RANGES (2 MB)
    at most: beyond MOST_RANGES * range_bytes of text, ranges are larger and not more.
    """
    range_bytes = max(range_bytes, -(-(rows.agg(F.sum("bytes")).first()[0] or 0) // MOST_RANGES))
    uniform = F.pmod(F.xxhash64("key", "tie", F.lit("range")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(uniform < F.col("bytes") * F.lit(POINTS / range_bytes)).select("key", "tie").distinct()
    points = drawn.toArrow().sort_by([("key", "ascending"), ("tie", "ascending")])
    first = rows.agg(F.min(F.struct("key", "tie")).alias("f")).first()["f"]
    if first is None:
        return []
    keys, ties = (points.column(c).to_pylist()[POINTS::POINTS] for c in ("key", "tie"))
    return [(first["key"], first["tie"]), *(p for p in zip(keys, ties, strict=True) if p != tuple(first))]


def longs(values: list[int]) -> Column:
    """One literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_number(key: Column, tie: Column, starts: list[tuple[int, int]]) -> Column:
    """Index of the last start not above (key, tie), by a search in two levels; -1 if all are above."""
    n, step = len(starts), max(1, int(len(starts) ** 0.5))
    keys, ties = longs([k for k, _ in starts]), longs([t for _, t in starts])
    reached = lambda i: (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(ties, i) <= tie))
    up_to = lambda at: F.size(F.filter(at, reached))
    block = F.greatest(up_to(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step))) - 1, F.lit(0))
    return let(block * step, lambda b: b + up_to(F.sequence(b, F.least(b + (step - 1), F.lit(n - 1)))) - 1)


def with_next(rows: DataFrame, take: dict[str, str], range_bytes: int) -> DataFrame:
    """rows (key, tie, bytes, ...) with the columns of take (name: new name) of the row after it in the order of key and tie; after the last comes the first.

    Rows are dealt to ranges, so one shuffle brings neighbours together and no task has more than ranges. The rows that a
    range begins with are also sent, marked, to the end of the range before, where the last row finds them.
    """
    starts = range_starts(rows, range_bytes)
    if not starts:
        return rows.select("*", *[F.col(c).alias(n) for c, n in take.items()])
    own = rows.withColumn("_range", range_number(F.col("key"), F.col("tie"), starts))
    first = (F.get(longs([k for k, _ in starts]), F.col("_range")) == F.col("key")) & (F.get(longs([t for _, t in starts]), F.col("_range")) == F.col("tie"))
    here = F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))
    there = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(starts))).alias("r"), F.lit(True).alias("guest"))
    dealt = own.withColumn("_at", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select(*rows.columns, F.col("_at.r").alias("_range"), F.col("_at.guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", "key", "tie")
    return dealt.select("*", *[F.lead(c).over(order).alias(n) for c, n in take.items()]).where(~F.col("_guest")).drop("_range", "_guest")


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text, of its edited text, and their likenesses (see op9)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)), "tie": F.xxhash64("text"), "bytes": F.octet_length("text"), "fingerprint": fingerprint(F.col("text"))})
    near = with_next(rows, {"text": "next_text", "fingerprint": "next_fingerprint"}, range_bytes)
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = near.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"))
    marked = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
