"""Near-duplicates by ProbMinHash: word shingles, early-stopped Poisson arrivals, banding, exact verification.

A document's shingles are runs of five words (fewer than five words make one shingle). Every shingle is a Poisson process
whose rate is its weight; each arrival falls on one of M components, and a component keeps the shingle that arrived there
first. Two documents agree on a component with probability J_P, the probability Jaccard similarity of their weighted
shingles. As links are decided by sets, every weight is 1, however often a shingle is repeated: J_P is then the Jaccard
similarity itself, so what steers the candidates is what decides. Arrivals past the latest of a document's first arrivals cannot change anything, so
generation stops there.

Equal texts are one node. Nodes that agree on a whole band share a bucket. Links are found in two steps, so that a group of
thousands of near copies never becomes all its pairs:

1. in each bucket every node is verified against one hub only, the node with most copies; links give components;
2. buckets whose nodes are still in different components are split by size, as texts whose shingle sets differ by more than
   the threshold in size have no link: a class of sizes meets itself and the next one. Within these, blocks of nodes meet,
   signature against signature, but not blocks of one component; only pairs across components that may reach the threshold
   are verified.

A pair already in one component needs no verification, as its link would change nothing. A link is an exact Jaccard
similarity of at least 0.8 of the shingle sets. With 32 bands of 6 a pair at 0.8 shares a bucket with probability 0.9999. What
step 2 compares is lossless, so texts that are alike by the hundred thousand but not linked cost their pairs of signatures;
these are bytes in blocks that no task holds together.

Null text is empty text. Texts without words have no shingles: they group with exact copies only. Null and repeated doc_ids
are allowed: every row gets its class. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, fresh_path, pick, table, written

SHINGLE = 5
BANDS, ROWS = 32, 6
BANDED = BANDS * ROWS
M = 2 * BANDED  # the second half only sharpens estimates
THRESHOLD = 0.8
#: Signatures of a pair at the threshold agree on less than this share with a probability below 0.0005 (3.3 standard errors).
LEAST_ESTIMATE = THRESHOLD - 3.3 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5
BLOCK = 512
PART_PAIRS = 200
_WORD = re.compile(r"[^\W_]+")
_POWERS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(SHINGLE)], np.uint64)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) for w in found]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = known[found[i]] = xxhash.xxh3_64_intdigest(found[i])
        return np.array(out, np.uint64)


def shingles(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    found = words(text or "")
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hasher(found)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        total += mix(h[j : j + n] + np.uint64(j)) * _POWERS[j]
    return np.unique(mix(total), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """ProbMinHash of each (hashes, weights): one row of m 32-bit element marks; all 0 for an empty set."""
    sizes = [len(h) for h, _ in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = np.concatenate([x for x, _ in sets]) if sets else np.zeros(0, np.uint64)
    w = np.concatenate([x for _, x in sets]) if sets else np.zeros(0)
    times = np.full(len(sets) * m, np.inf)
    marks = np.zeros(len(sets) * m, np.uint32)
    t, step = np.zeros(len(h)), 0
    while len(h):
        u = mix(h + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % 2**64))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        at = owner * m + ((mix(u ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        better = t < times[at]
        if better.any():
            where, when = at[better], t[better]
            np.minimum.at(times, where, when)
            first = when == times[where]
            marks[where[first]] = (mix(h[better][first]) >> np.uint64(32)).astype(np.uint32)
        latest = times.reshape(-1, m).max(1)
        alive = t < latest[owner]
        h, w, t, owner, step = h[alive], w[alive], t[alive], owner[alive], step + 1
    return marks.reshape(-1, m)


def band_keys(marks: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row, the number of the band mixed in."""
    parts = marks[:, :BANDED].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty sets have 0."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (hashes, weights), exactly: what agreeing components estimate."""
    keys = np.union1d(a[0], b[0])
    v, w = np.zeros(len(keys)), np.zeros(len(keys))
    v[np.searchsorted(keys, a[0])], w[np.searchsorted(keys, b[0])] = a[1], b[1]
    both = (v > 0) & (w > 0)
    return float(sum(1 / np.maximum(v / x, w / y).sum() for x, y in zip(v[both], w[both], strict=True)))


def digest(text: Column) -> Column:
    """The node of a text: half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """rows (node, text) -> node, text, copies; a table bucketed by node, so that joins by node need not move texts again."""
    spark = rows.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, "texts")
    name = "near_texts_" + path.rsplit("-", 1)[1]
    once = rows.groupBy("node").agg(F.first("text", ignorenulls=True).alias("text"), F.count("*").alias("copies"))
    once.write.bucketBy(n, "node").option("path", path).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    found.schema, spark.sql(f"DROP TABLE {name}")  # the name was for the buckets only; the files, which are not the catalogue's, stay
    return found


def sign(texts: DataFrame) -> DataFrame:
    """texts (node, text, copies) -> node, copies, size (of the shingle set), marks, bands; without rows for texts that have no words.

    Bands are made of whole marks; of the marks themselves the low bytes are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                found = [shingles(t.as_py(), hasher) for t in b.column("text")]
                b = b.filter(pa.array([len(h) > 0 for h, _ in found], pa.bool_()))
                marks = signatures([(h, np.ones(len(h))) for h, _ in found if len(h)])
                low = [m.tobytes() for m in marks.astype(np.uint8)]
                sizes = pa.array([len(h) for h, _ in found if len(h)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), sizes, pa.array(low, pa.binary()), pa.array(list(band_keys(marks)), pa.list_(pa.int64()))], ["node", "copies", "size", "marks", "bands"])

    return texts.select("node", "text", "copies").mapInArrow(run, "node binary, copies long, size long, marks binary, bands array<long>")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """signed -> key, node, hub of the buckets that have several nodes; the hub is the node with most copies."""
    bands = signed.select("node", "copies", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.max(F.struct("copies", "node")).alias("h"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), F.col("h.node").alias("hub"))
    hubs = written(hubs, "hubs")  # aggregates are written before they are joined, as only then can a hot key's rows be split
    return bands.join(hubs, F.col("key") == F.col("_key")).select("key", "node", "hub")


def hub_pairs(shared: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b): b shares a bucket with a, its hub, and their signatures agree on at least `least`."""
    pairs = shared.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    left, right = signed.select(F.col("node").alias("_a"), F.col("marks").alias("x")), signed.select(F.col("node").alias("_b"), F.col("marks").alias("y"))
    met = pairs.join(left, F.col("a") == F.col("_a")).select("a", "b", "x").join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("x", "y"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return met.mapInArrow(run, "a binary, b binary")


def with_texts(pairs: DataFrame, texts: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """pairs (key, other, <key>_parts, ...) with the text of key, in place of <key>_parts.

    A node of many pairs has its text dealt out in several copies, one for about PART_PAIRS pairs, so no task has them all.
    """
    parts = f"{key}_parts"
    few = pairs.select(F.col(key).alias("_key"), F.col(parts).alias("_parts")).distinct()
    dealt = few.join(texts.select("node", F.col("text").alias(name)), F.col("_key") == F.col("node")).select("_key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), name)
    met = pairs.withColumn("_p", F.pmod(F.xxhash64(other), F.col(parts)).cast("int")).join(dealt, (F.col(key) == F.col("_key")) & (F.col("_p") == F.col("_part")))
    return met.drop("_p", "_key", "_part", parts)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) of nodes whose texts' shingle sets have a Jaccard similarity of at least threshold."""
    for key in ("a", "b"):
        counts = pairs.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias(f"{key}_parts"))
        pairs = pairs.join(written(counts, "counts"), F.col(key) == F.col("_k")).drop("_k")
    pairs = written(pairs, "counted-pairs")
    both = with_texts(with_texts(pairs, texts, "a", "b", "x"), texts, "b", "a", "y").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, other = shingles(x.as_py(), hasher)[0], shingles(y.as_py(), hasher)[0]
                good.append(min(len(one), len(other)) >= threshold * max(len(one), len(other)) and jaccard(one, other) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, label: the smallest node of its component, for every node of an edge.

    Labels travel along edges and by pointer jumping until none changes; every round is a written table.
    """
    edges = written(edges.where("a != b").union(edges.where("a != b").select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        far = labels.select("node", F.col("label").alias("_via")).join(labels.toDF("_node", "_far"), F.col("_via") == F.col("_node")).select("node", F.col("_far").alias("label"))
        best = near.union(far).groupBy("node").agg(F.min("label").alias("label"))
        moved = written(best.join(labels.toDF("_node", "_old"), F.col("node") == F.col("_node")).select("node", "label", (F.col("label") != F.col("_old")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def cross_pairs(shared: DataFrame, signed: DataFrame, labels: DataFrame, least: float, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs across components that share a bucket, may have the threshold by their sizes, and whose signatures agree on at least `least`; each pair once.

    A bucket is cut by size class, each class in blocks of about BLOCK nodes by a hash; a block meets blocks of its own class
    and of the next, so no task holds a whole bucket. The nodes of a bucket's largest component are in blocks of their own,
    which do not meet among themselves.
    """
    own = labels.toDF("_node", "label")
    labelled = shared.join(own, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select(F.col("key").alias("_key"))
    members = labelled.join(written(mixed, "mixed"), F.col("key") == F.col("_key")).select("key", "node", "label")
    parts = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("most"))
    members = members.join(written(parts.withColumnRenamed("key", "_key"), "largest"), F.col("key") == F.col("_key")).select("key", "node", "label", (F.col("label") == F.col("most")).alias("main"))
    size_class = F.floor(F.log("size") / F.lit(float(np.log(1 / threshold)) + 1e-9)).cast("int").alias("class")
    members = members.join(signed.select(F.col("node").alias("_node"), size_class), F.col("node") == F.col("_node")).drop("_node")
    members = written(members, "members")
    sizes = members.groupBy("key", "class", "main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = written(sizes.select(F.col("key").alias("_key"), F.col("class").alias("_class"), F.col("main").alias("_main"), "blocks"), "block-counts")
    placed = members.join(sizes, (F.col("key") == F.col("_key")) & (F.col("class") == F.col("_class")) & (F.col("main") == F.col("_main")))
    placed = placed.select("key", "class", "main", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "label")
    placed = placed.join(signed.select(F.col("node").alias("_node"), "marks", "bands"), F.col("node") == F.col("_node"))
    # the number of the bucket's band: the pair is this bucket's only if no earlier band has one key
    placed = placed.withColumn("band", F.array_position("bands", F.col("key")) - 1)
    blocks = written(placed.groupBy("key", "class", "main", "block").agg(F.first("band").alias("band"), F.collect_list(F.struct("node", "label", "marks", "bands")).alias("x")), "blocks")
    brief = blocks.select("key", "class", "main", "block")  # which blocks meet is settled without signatures
    near = brief.withColumn("_c", F.explode(F.array("class", F.col("class") + 1)))
    other = brief.toDF("_key", "_class", "_main", "_block")
    met = near.join(other, (F.col("key") == F.col("_key")) & (F.col("_c") == F.col("_class")))
    once = (F.col("class") != F.col("_class")) | (F.struct("main", "block") <= F.struct("_main", "_block"))
    met = written(met.where(once & ~(F.col("main") & F.col("_main"))).drop("_c"), "block-pairs")
    one = blocks.toDF("k1", "c1", "m1", "b1", "band", "x")
    two = blocks.drop("band").toDF("k2", "c2", "m2", "b2", "y")
    both = met.join(one, (F.col("key") == F.col("k1")) & (F.col("class") == F.col("c1")) & (F.col("main") == F.col("m1")) & (F.col("block") == F.col("b1")))
    both = both.join(two, (F.col("_key") == F.col("k2")) & (F.col("_class") == F.col("c2")) & (F.col("_main") == F.col("m2")) & (F.col("_block") == F.col("b2")))
    same = (F.col("class") == F.col("_class")) & (F.col("main") == F.col("_main")) & (F.col("block") == F.col("_block"))

    def unpack(column: pa.StructArray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        node, label, marks = (column.field(c).to_pylist() for c in ("node", "label", "marks"))
        bands = column.field("bands").flatten().to_numpy().reshape(len(column), BANDS)
        return node, np.array(label, "V16"), np.frombuffer(b"".join(marks), np.uint8).reshape(len(column), M), bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for same, band, x, y in zip(*(batch.column(c) for c in ("same", "band", "x", "y")), strict=True):
                same, band = same.as_py(), band.as_py()
                nx, lx, mx, bx = unpack(x.values)
                ny, ly, my, by = (nx, lx, mx, bx) if same else unpack(y.values)  # x and y need not list a block in one order
                for i in range(len(nx)):  # a node against the whole other block
                    lo = i + 1 if same else 0
                    # marks are low bytes only, so they do not tell which buckets a pair shares
                    hit = ((mx[i] == my[lo:]).mean(1) >= least) & ((bx[i] == by[lo:]).argmax(1) == band) & (lx[i] != ly[lo:])
                    for j in np.flatnonzero(hit):
                        a.append(nx[i])
                        b.append(ny[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return both.select(same.alias("same"), "band", "x", "y").mapInArrow(run, "a binary, b binary")


def near_labels(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """distinct_texts() -> node, label of the nodes that are linked to others."""
    signed = written(sign(texts), "signatures")
    shared = written(shared_buckets(signed), "buckets")
    least = LEAST_ESTIMATE + threshold - THRESHOLD
    labels = components(written(verify(written(hub_pairs(shared, signed, least), "pairs"), texts, threshold), "links"))
    more = verify(written(cross_pairs(shared, signed, labels, least, threshold), "pairs"), texts, threshold)
    own, other = labels.toDF("_a", "la"), labels.toDF("_b", "lb")
    between = more.join(own, F.col("a") == F.col("_a"), "left").join(other, F.col("b") == F.col("_b"), "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(written(between, "links"))
    # a component that the second step joins to others takes their label; nodes that only this step links come with theirs
    moved = labels.join(joined.toDF("_node", "_to"), F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    return written(moved.unionByName(joined.join(labels.select(F.col("node").alias("_known")), F.col("node") == F.col("_known"), "left_anti")), "labels")


def classed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (node, ...) with label, the node itself where it has no other."""
    return rows.join(labels.toDF("_node", "label"), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("_node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, class_size: class_id is the smallest doc_id of the class, null if it has none."""
    rows = pick(docs, "doc_id", "text").withColumn("node", digest(F.col("text")))
    found = written(classed(rows.select("doc_id", "node"), near_labels(distinct_texts(rows.select("node", "text")), threshold)), "classes")
    classes = found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).withColumnRenamed("label", "_label")
    return found.join(written(classes, "class-ids"), F.col("label") == F.col("_label")).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest doc_id (null last, then by text and the other columns). Columns of documents."""
    rows = pick(docs, *DOCUMENT_COLUMNS).withColumn("node", digest(F.col("text")))
    texts = distinct_texts(rows.select("node", "text"))
    others = [c for c in DOCUMENT_COLUMNS if c != "text"]
    brief = rows.select(*others, "node", F.col("text").isNull().alias("no_text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", *[c for c in others if c != "doc_id"], "no_text")
    kept = classed(brief, near_labels(texts, threshold)).groupBy("label").agg(F.min(order).alias("k")).select("k.*")
    own = texts.select(F.col("node").alias("_node"), "text")
    return kept.join(own, F.col("node") == F.col("_node")).withColumn("text", F.when(~F.col("no_text"), F.coalesce("text", F.lit("")))).select(*DOCUMENT_COLUMNS)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
