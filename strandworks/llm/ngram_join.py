"""Jaccard join of word n-gram sets by vertical partitioning: documents that share at least 85 % of their 4-word shingles.

Words are runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased. A document's set has its distinct shingles
of four words; fewer words make one shingle, none an empty set. Documents of one set are one node. The steps:

1. Shingles are cut in fragments by ranges of their hash. A fragment counts in how many nodes each of its shingles stands, so
   no task has more than a fragment. A shingle of one node is in no overlap: nodes of which more than 15 % are such have no
   link and go, which leaves few. What stands in many nodes of a batch is counted there and not sent node by node.
2. The shingles left have a global order: those of few nodes first, by powers of two, then by hash. Two linked sets share one
   of the first places of that order (prefix), have like sizes (length), and enough shingles from there on (position).
3. That order is cut in pieces, each of about as many shingles. Each piece counts the overlaps of its part of the candidate
   pairs on its own, and the counts are summed for each pair. Their sum decides.
4. Candidates are found in two rounds, so that a group of near copies never gives all its pairs. First each shingle's nodes
   meet one of them only, that with the largest share of shingles which others have too; links make components. Then nodes
   that still are in different components meet, except those of the shingle's largest component among themselves.

A link inside a component changes nothing, so none is lost. Shingles are told apart by 48 bits and sets by 64 bits of their
hashes: two sets of 20,000 shingles take one more for common with a probability of 1.4e-6.

Null text is empty. Documents without words link with nothing and are their own component. Null and repeated doc_ids are allowed:
every row gets its component, whose id is the smallest doc_id, null if it has none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written
from .near_dedup import components, mix
from .wordhash import WordHasher

SPACES = b" \t\n\x0b\x0c\r"
SHINGLE = 4
#: A link: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (85, 100)
TOKEN_BITS = 48
#: Text of a fragment, shingles of a batch, and nodes of a batch from which on a shingle is counted there.
FRAGMENT_BYTES = 8 << 20
BATCH = 500_000
COMMON = 64
#: At most so many nodes have so many copies that only one of them is cut; and tables of at most so many rows are broadcast.
HOT_NODES = 100_000
FEW_ROWS = 200_000
PIECES = 16
_POWERS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(SHINGLE)]


def sets_of(hasher: WordHasher, texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, words, counts in hasher(texts):
        n = max(0, len(words) - SHINGLE + 1)
        whole = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            whole += mix(words[j : j + n] + np.uint64(j)) * _POWERS[j]
        whole = mix(whole)
        at = 0
        for k in counts.tolist():
            if k >= SHINGLE:
                yield np.unique(whole[at : at + k - SHINGLE + 1])
            elif k:
                short = sum((mix(words[at + j : at + j + 1] + np.uint64(j)) * _POWERS[j] for j in range(k)), np.zeros(1, np.uint64))
                yield mix(short)
            else:
                yield np.zeros(0, np.uint64)
            at += k


def node_of(found: np.ndarray) -> int:
    """64 bits of a set, signed."""
    h = xxhash.xxh3_64_intdigest(found.tobytes())
    return h - (1 << 64) if h >> 63 else h


def nodes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, node (null without words), size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SPACES)
        for b in batches:
            found = [(node_of(s) if len(s) else None, len(s)) for s in sets_of(hasher, b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "node", "size"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, node long, size long")


def hot_nodes(docs: DataFrame) -> dict[int, int | None]:
    """Nodes of very many documents and the smallest doc_id of each; by the threshold there are at most HOT_NODES."""
    most = max(1000, -(-docs.count() // HOT_NODES))
    found = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= most)
    return {r["node"]: r["first"] for r in found.select("node", "first").collect()}


def packed(tokens: np.ndarray) -> bytes:
    """48 bits each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8").astype(np.int64)


ROW = "key long, nodes array<long>, sizes array<long>, counts array<int>, tokens binary, common binary, common_counts array<int>"
_ROW = pa.schema([("key", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("tokens", pa.binary()), ("common", pa.binary()), ("common_counts", pa.list_(pa.int32()))])


def fragment_rows(sets: dict[int, tuple[int, np.ndarray]], fragments: int, common: int = COMMON) -> pa.RecordBatch:
    """A batch's sets (node: size, tokens) cut by fragment: nodes, how many tokens each has there, the tokens; those of many nodes apart, with key < 0."""
    names = np.array(list(sets), np.int64)
    sizes = np.array([n for n, _ in sets.values()], np.int64)
    tokens = np.concatenate([t for _, t in sets.values()])
    own = np.repeat(np.arange(len(names)), [len(t) for _, t in sets.values()])
    known, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
    often = df >= common
    fragment = lambda t: ((t >> (TOKEN_BITS - 32)) * fragments) >> 32
    marks, mark_counts, mark_at = known[often], df[often], fragment(known[often])
    rows = []

    def row(key: int, at: np.ndarray, marked: np.ndarray) -> None:
        who, counts = np.unique(own[at], return_counts=True)
        rows.append((key, names[who].tolist(), sizes[who].tolist(), counts.tolist(), packed(tokens[at]), packed(marks[marked]), mark_counts[marked].tolist()))

    apart = often[inverse]
    if apart.any():
        row(-1 - (int(names[0]) & 0x7FFFFFFF), np.flatnonzero(apart), np.zeros(0, np.int64))
    at = np.flatnonzero(~apart)
    where = fragment(tokens[at])
    order = np.argsort(where, kind="stable")  # the tokens of a node stay together
    at, where = at[order], where[order]
    for f in np.union1d(where, mark_at).tolist():
        lo, hi = np.searchsorted(where, [f, f + 1])
        row(f, at[lo:hi], np.flatnonzero(mark_at == f))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


FOUND = "kind int, node long, size long, token long"


def found_rows(kind: int, node: np.ndarray | None, size: np.ndarray | None, token: np.ndarray) -> pa.Table:
    n = len(token)
    column = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), "node": column(node), "size": column(size), "token": column(token)})


def shared_tokens(rows: pa.Table) -> pa.Table:
    """The rows of one key -> what its shingles' nodes share.

    kind 1: node, its size, and a token that others have, in the global order (power of two of its nodes, then hash);
    kind 2: the same of a token that many nodes of a batch have, its place in the order left open; kind 3: that place (size).
    """
    rows = rows.combine_chunks()
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
    tokens, counts = unpacked(rows.column("tokens").to_pylist()), flat("counts")
    node, size = np.repeat(flat("nodes"), counts), np.repeat(flat("sizes"), counts)
    if rows.column("key")[0].as_py() < 0:
        return found_rows(2, node, size, tokens)
    order = np.lexsort((node, tokens))
    t, n, s = tokens[order], node[order], size[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])  # copies of a set in several batches
    t, n, s = t[new], n[new], s[new]
    known, df = np.unique(t, return_counts=True)
    marks, inverse = np.unique(unpacked(rows.column("common").to_pylist()), return_inverse=True)
    marked = np.bincount(inverse, flat("common_counts"), len(marks)).astype(np.int64)
    place = np.searchsorted(known, marks)
    here = (place < len(known)) & (known[np.minimum(place, max(0, len(known) - 1))] == marks) if len(known) else np.zeros(len(marks), bool)
    marked[here] += df[place[here]]
    each = df.copy()
    each[place[here]] = marked[here]
    each = np.repeat(each, df)
    level = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    keep = each >= 2
    return pa.concat_tables([found_rows(1, n[keep], s[keep], (level(each[keep]) << TOKEN_BITS) | t[keep]), found_rows(3, None, level(marked), marks)])


def cut(docs: DataFrame, fragments: int, hot: dict[int, int | None], batch: int = BATCH, common: int = COMMON) -> DataFrame:
    """docs (doc_id, text) -> FOUND of every fragment. A node in hot is cut from the document of its doc_id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sets, held = WordHasher(SPACES), {}, 0
        for b in batches:
            for doc_id, found in zip(b.column("doc_id").to_pylist(), sets_of(hasher, b.column("text")), strict=True):
                node = node_of(found)
                if not len(found) or node in sets or (node in hot and hot[node] != doc_id):
                    continue
                sets[node] = (len(found), np.unique(found >> np.uint64(64 - TOKEN_BITS)).astype(np.int64))
                held += len(found)
                if held >= batch:
                    yield fragment_rows(sets, fragments, common)
                    sets, held = {}, 0
        if sets:
            yield fragment_rows(sets, fragments, common)

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ROW).groupBy("key").applyInArrow(shared_tokens, FOUND)


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few; a written table."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def unsent(rows: DataFrame) -> DataFrame:
    """rows, never broadcast: Spark takes exploded rows for as many as before, and rows that Parquet packs well for few bytes, so these would go through the driver."""
    return rows.hint("merge")


def enough(inter: Column, a: Column, b: Column, share: tuple[int, int]) -> Column:
    """Whether sets of sizes a and b with this intersection are linked."""
    return inter * share[1] >= (a + b - inter) * share[0]


def live_nodes(found: DataFrame, share: tuple[int, int]) -> DataFrame:
    """cut() -> node, size, tokens: nodes of which enough shingles stand in other nodes too, these in the global order."""
    rows = found.where("kind < 3").select("kind", "node", "size", "token")
    # a copy of a set in two batches may count twice, so this keeps too many at times, never too few
    some = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.col("n") * share[1] >= F.col("size") * share[0])
    some = small(written(some.select(F.col("node").alias("_node")), "some-nodes"))
    rows = written(rows.join(some, F.col("node") == F.col("_node")).drop("_node"), "some-tokens")
    places = small(written(found.where("kind = 3").groupBy("token").agg(F.max("size").alias("level")).withColumnRenamed("token", "_token"), "places"))
    apart = rows.where("kind = 2").join(places, F.col("token") == F.col("_token"))
    apart = apart.select("node", "size", (F.shiftleft(F.col("level"), TOKEN_BITS).bitwiseOR(F.col("token"))).alias("token"))
    rows = rows.where("kind = 1").select("node", "size", "token").unionByName(apart)
    live = rows.groupBy("node").agg(F.max("size").alias("size"), F.sort_array(F.collect_set("token")).alias("tokens"))
    return live.where(F.size("tokens") * share[1] >= F.col("size") * share[0])


def prefixes(live: DataFrame, share: tuple[int, int]) -> DataFrame:
    """live -> token, node, size, pos, own (the share of its shingles that no other node has): the first places of each set.

    Shingles of one node only come first in the order and are no entries, but they take places.
    """
    lone = F.col("size") - F.size("tokens")
    places = F.col("size") - F.ceil(F.col("size") * share[0] / F.lit(share[1])).cast("long") + 1
    first = F.slice("tokens", F.lit(1), F.greatest(places - lone, F.lit(0)).cast("int"))
    rows = live.select("node", "size", lone.alias("lone"), F.posexplode(first).alias("i", "token"))
    return rows.select("token", "node", "size", (F.col("lone") + F.col("i")).alias("pos"), (F.col("lone") / F.col("size")).alias("own"))


def may_link(a: str, b: str, share: tuple[int, int]) -> Column:
    """Length and position filter of two entries of one token, with columns size<a>, pos<a>, size<b>, pos<b>."""
    sa, sb = F.col(f"size{a}"), F.col(f"size{b}")
    rest = F.least(sa - F.col(f"pos{a}"), sb - F.col(f"pos{b}"))
    return (F.least(sa, sb) * share[1] >= F.greatest(sa, sb) * share[0]) & enough(rest, sa, sb, share)


def hub_pairs(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct a, b, size_a, size_b: each token's nodes with the one of them that has least of its own."""
    hub = F.min(F.struct("own", "node", "size", "pos")).alias("h")
    hubs = unsent(written(entries.groupBy("token").agg(hub, F.count("*").alias("n")).where("n > 1").select(F.col("token").alias("_token"), F.col("h.node").alias("a"), F.col("h.size").alias("size_a"), F.col("h.pos").alias("pos_a")), "hubs"))
    met = entries.select("token", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b")).join(hubs, F.col("token") == F.col("_token"))
    return met.where((F.col("a") != F.col("b")) & may_link("_a", "_b", share)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(F.col("a") < F.col("b"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_b")).distinct()


def cross_pairs(entries: DataFrame, labels: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct a, b, size_a, size_b across components that the filters leave; nodes of like sizes meet only."""
    rows = entries.join(labels.toDF("_node", "label"), F.col("node") == F.col("_node"), "left").select("token", "node", "size", "pos", F.coalesce("label", "node").alias("label"))
    mixed = written(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select(F.col("token").alias("_token")), "mixed")
    rows = written(rows.join(mixed, F.col("token") == F.col("_token")).drop("_token"), "members")
    most = rows.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("most"))
    rows = rows.join(written(most.withColumnRenamed("token", "_token"), "largest"), F.col("token") == F.col("_token"))
    width = float(np.log(share[1] / share[0])) + 1e-9  # linked sizes are in one class or the next
    rows = rows.select("token", "node", "size", "pos", "label", (F.col("label") == F.col("most")).alias("main"), F.floor(F.log(F.col("size")) / width).cast("int").alias("class"))
    rows = written(rows, "members")
    one = rows.where(~F.col("main")).select("token", "class", *[F.col(c).alias(f"{c}_a") for c in ("node", "size", "pos", "label")])
    two = rows.select(F.col("token").alias("_token"), F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("_class"), "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "pos", "label")])
    once = F.col("main") | (F.col("node_a") < F.col("node_b"))
    met = one.join(unsent(two), (F.col("token") == F.col("_token")) & (F.col("class") == F.col("_class")) & (F.col("label_a") != F.col("label_b")) & once & may_link("_a", "_b", share))
    swap = F.col("node_a") > F.col("node_b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(either("node_a", "node_b").alias("a"), either("node_b", "node_a").alias("b"), either("size_a", "size_b").alias("size_a"), either("size_b", "size_a").alias("size_b")).distinct()


def piece_starts(live: DataFrame, pieces: int) -> list[int]:
    """Where the pieces of the global order begin: each level is cut in ranges of its hashes, as many as its shingles call for."""
    counts = {r["level"]: r["n"] for r in live.select(F.explode("tokens").alias("t")).groupBy(F.shiftright("t", TOKEN_BITS).alias("level")).agg(F.count("*").alias("n")).collect()}  # a row a power of two
    total = sum(counts.values())
    starts = []
    for level in sorted(counts):
        k = max(1, round(pieces * counts[level] / total))
        starts += [(level << TOKEN_BITS) + ((i << TOKEN_BITS) // k) for i in range(k)]
    return starts


def segments(live: DataFrame, starts: list[int]) -> DataFrame:
    """live -> node, piece, part: each set's tokens cut by piece."""
    edges = np.array(starts[1:], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, tokens in zip(b.column("node").to_pylist(), b.column("tokens"), strict=True):
                t = tokens.values.to_numpy()
                at = [0, *np.searchsorted(t, edges).tolist(), len(t)]
                out += [(node, k, t[lo:hi]) for k, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["node", "piece", "part"])

    return live.select("node", "tokens").mapInArrow(run, "node long, piece int, part array<long>")


def linked(pairs: DataFrame, parts: DataFrame, n_pieces: int, share: tuple[int, int]) -> DataFrame:
    """pairs (a, b, size_a, size_b) -> a, b of those linked: overlaps are counted in each piece and summed for each pair."""
    dealt = pairs.select("a", "b", "size_a", "size_b", F.explode(F.sequence(F.lit(0), F.lit(n_pieces - 1))).alias("piece"))
    left = parts.select(F.col("node").alias("_a"), F.col("piece").alias("_pa"), F.col("part").alias("x"))
    right = parts.select(F.col("node").alias("_b"), F.col("piece").alias("_pb"), F.col("part").alias("y"))
    met = unsent(dealt).join(left, (F.col("a") == F.col("_a")) & (F.col("piece") == F.col("_pa"))).join(right, (F.col("b") == F.col("_b")) & (F.col("piece") == F.col("_pb")))
    partial = written(met.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("x", "y")).alias("n")), "overlaps")
    whole = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return whole.where(enough(F.col("n"), F.col("size_a"), F.col("size_b"), share)).select("a", "b")


def link_labels(found: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """cut() -> node, label of the nodes that are linked to others: the smallest node of the component."""
    live = written(live_nodes(found, share), "live")
    entries = written(prefixes(live, share), "prefixes")
    starts = piece_starts(live, PIECES)
    parts = written(segments(live, starts), "segments")
    labels = components(written(linked(written(hub_pairs(entries, share), "pairs"), parts, len(starts), share), "links"))
    more = linked(written(cross_pairs(entries, labels, share), "pairs"), parts, len(starts), share)
    own, other = labels.toDF("_a", "la"), labels.toDF("_b", "lb")
    between = more.join(own, F.col("a") == F.col("_a"), "left").join(other, F.col("b") == F.col("_b"), "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(written(between, "links"))
    moved = labels.join(joined.toDF("_node", "_to"), F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    return written(moved.unionByName(joined.join(labels.select(F.col("node").alias("_known")), F.col("node") == F.col("_known"), "left_anti")), "labels")


def ngram_components(docs: DataFrame, share: tuple[int, int] = SHARE, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = written(nodes(docs), "nodes")
    n_bytes = pick(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(-(-n_bytes // fragment_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    labels = link_labels(written(cut(docs, fragments, hot_nodes(rows)), "shared"), share)
    labelled = rows.join(labels.toDF("_node", "label"), F.col("node") == F.col("_node"), "left").select("doc_id", "node", "size", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "labelled")
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("label", "_label")
    out = labelled.join(written(least, "components"), F.col("label") == F.col("_label"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
