"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces are dealt by a hash to blocks of bounded size, each packed
on its own by variable-capacity best fit: longest pieces first, into the open bin that is left fullest. Where none has room, a
bin is opened: for every permitted length, the pieces still to come are laid in by size, and the length that costs least for
each token it would come to hold is taken. After the last piece every bin shrinks to the shortest permitted length that holds
its contents. As that choice looks at one bin only, a block is packed once for each permitted length as the least that may be
opened, up to one length for all, and the packing that costs least in all is kept.

The cost of a sequence of length c is overhead + c + c^2 / attention: a fixed price, its slots, and the square of its length.
Null and empty texts have no tokens: they get one row without a bin. Repeated rows are packed as often as they occur; they are
counted first and numbered, so they too are dealt over all blocks. There is no cap on bins; a document longer than any sequence fills whole bins of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64.0
ATTENTION = 16384.0
BLOCK_PIECES = 20_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + length + length * length / attention


class Rest:
    """The pieces still to come, by size."""

    def __init__(self, sizes: list[int]) -> None:
        self.counts = Counter(sizes)
        self.present = 0  # bit s is set if there are pieces of size s
        for s in self.counts:
            self.present |= 1 << s

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.present &= ~(1 << size)

    def filling(self, room: int) -> int:
        """How many tokens of room the pieces would fill, largest first, each that still fits."""
        left, sizes = room, self.present
        while sizes := sizes & ((1 << left + 1) - 1):
            size = sizes.bit_length() - 1
            left -= size * min(self.counts[size], left // size)
            sizes &= ~(1 << size)
        return room - left


def least_cost(size: int, rest: Rest, capacities: tuple[int, ...]) -> int:
    """The length to open for a piece of this size: least cost a token that it would come to hold; equal costs go to the shorter."""
    return min((c for c in capacities if c >= size), key=lambda c: (cost(c) / (size + rest.filling(c - size)), c))


Packing = tuple[np.ndarray, np.ndarray, np.ndarray]


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> Packing:
    """sizes, descending -> bin and offset of each piece, and the final length of each bin: the cheapest of the packings by least opened length, ties to the shorter."""
    return min((pack_once(sizes, capacities, capacities[k:]) for k in range(len(capacities))), key=lambda p: round(sum(cost(int(n)) * int(m) for n, m in zip(*np.unique(p[2], return_counts=True), strict=True)), 6))


def pack_once(sizes: np.ndarray, capacities: tuple[int, ...], opened: tuple[int, ...]) -> Packing:
    """Best fit into bins of the lengths `opened`, which then shrink to any of capacities."""
    rest = Rest(sizes.tolist())
    room: dict[int, list[int]] = {}  # bins by what is left in them
    free = 0  # bit r is set if a bin has r left
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        rest.take(size)
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            b, left = len(used), least_cost(size, rest, opened)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left > size:
            room.setdefault(left - size, []).append(b)
            free |= 1 << (left - size)
    lengths = [capacities[bisect_left(capacities, u)] for u in used]
    return bins, offsets, np.array(lengths, np.int64)


def numbered(pieces: DataFrame, at_once: int) -> DataFrame:
    """pieces (copies, ...) -> one row a copy, with its number in `copy`; a piece of very many copies is dealt out before it is multiplied."""
    kept = [c for c in pieces.columns if c != "copies"]
    few = pieces.where(F.col("copies") <= at_once).withColumn("_from", F.lit(0).cast("long"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(at_once).cast("long")))
    many = pieces.where(F.col("copies") > at_once).withColumn("_from", starts).repartition("_from")
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + at_once, F.col("copies")) - 1))
    return few.unionByName(many).select(*kept, copy.alias("copy"))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, first_token, n_tokens, block, bin, bin_length, bin_offset: one row a piece.

    (block, bin) names a sequence; tokens first_token .. first_token + n_tokens - 1 of the document stand at bin_offset.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    rows = pick(docs, "doc_id", "text").select("doc_id", tokens(F.col("text")).alias("n"), F.xxhash64("text").alias("tie"))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int"))))
    cut = cut.select("doc_id", "tie", "piece", (F.col("piece") * largest).cast("long").alias("first_token"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens"))
    cut = written(cut.groupBy("doc_id", "tie", "piece", "first_token", "n_tokens").agg(F.count("*").alias("copies")), "pieces")
    blocks = max(1, -(-(cut.agg(F.sum("copies")).first()[0] or 0) // block_pieces))
    each = numbered(cut, block_pieces)
    empty = each.where("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", *[F.lit(None).cast("long").alias(c) for c in ("block", "bin", "bin_length", "bin_offset")])
    dealt = each.where("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", "piece", "copy", F.lit("block")), F.lit(blocks)))

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_tokens", "doc_id", "tie", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        bins, offsets, lengths = best_fit(pieces["n_tokens"].to_numpy(), capacities)
        return pieces[["doc_id", "piece", "first_token", "n_tokens", "block"]].assign(bin=bins, bin_length=lengths[bins], bin_offset=offsets)

    kind = dict(rows.dtypes)["doc_id"]
    nullable = dealt.withColumn("doc_id", F.col("doc_id").cast("string")) if kind != "string" else dealt  # integers with nulls survive as text
    packed = nullable.groupBy("block").applyInPandas(run, "doc_id string, piece int, first_token long, n_tokens long, block long, bin long, bin_length long, bin_offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(empty)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
