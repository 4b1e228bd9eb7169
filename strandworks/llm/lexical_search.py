"""Ranked lexical search: the best documents of each item, by branch and bound over a trie of restricted term vectors.

Terms are runs of bytes other than the ASCII characters that are no letters or digits; A-Z count as a-z. A document's vector
is restricted to terms that some item has. Documents are dealt to trees of at most TREE_DOCS. In a tree each vector is a path of
terms, the most frequent first, so vectors with the same frequent terms share their beginnings; a path on which few documents
are left is a leaf. Every node knows, of the documents below it, the largest tf of each term and the smallest m. As a score
grows with tf and falls with m, these bound what an item can score below a node. The search of an item goes depth-first to the
child of the largest bound, and leaves out nodes whose bound is below the item's worst kept score. That score is kept from tree
to tree of a task; tasks' best are merged.

Counts (documents, terms, documents of a term) are those of the whole table. Items are taken in blocks of about ITEM_TERMS
distinct terms; each block is a pass over the documents.

Null text has no terms. Documents without terms are none (not in N), items without terms give no rows. Rows of one doc_id are
documents of their own, null doc_ids come last at equal scores. Items of the same item_id and text are one; of the same item_id
and different texts they are ranked apart. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, pick, table, written
from .wordhash import WordHasher

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TOP = 20
ITEM_TERMS = 20_000
TREE_DOCS = 4096
#: Cells of a tree's table of documents and terms; with more terms a tree has fewer documents.
CELLS = 16_000_000
LEAF = 24
SALTS = 64


def item_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> item (a number), item_id, terms (hashes, ascending), counts; without items that have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SEPARATORS)
        for b in batches:
            terms, counts = [], []
            for _, _, hashes, n in hasher(b.column("text")):
                for part in np.split(hashes, np.cumsum(n)[:-1]):
                    t, k = np.unique(part.view(np.int64), return_counts=True)
                    terms.append(t)
                    counts.append(k)
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["item", "item_id", "terms", "counts"])

    rows = pick(items, "item_id", "text").distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item long, item_id {kind}, terms array<long>, counts array<long>").where(F.size("terms") > 0)


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n (terms with repeats), terms (places in vocabulary), tfs; without documents that have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(SEPARATORS)
        for b in batches:
            ids = b.column("doc_id")
            for lo, hi, hashes, n in hasher(b.column("text")):
                words = hashes.view(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == words)
                own = np.repeat(np.arange(hi - lo), n)[hit]
                key, tf = np.unique(own * len(vocabulary) + place[hit], return_counts=True)
                at = np.searchsorted(key, np.arange(hi - lo + 1) * len(vocabulary)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32)))  # noqa: B023, E731
                out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), listed(key % len(vocabulary)), listed(tf)], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied with; grows with tf, falls with m, 0 for tf 0."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """The trie of some documents' vectors.

    Documents are sorted by their paths, so a node's are those from first[node] to last[node]; children[node] is empty in a leaf.
    bound[node, term] is the part of the score that no document below the node exceeds, exact[doc, term] a document's own.
    """

    def __init__(self, ids: list[int | None], terms: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, rank: np.ndarray, leaf: int = LEAF) -> None:
        """rank: 0 for the most frequent term."""
        paths = []
        for t in terms:
            paths.append(np.sort(rank[t]).astype(">u4").tobytes())
        order = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids = [ids[i] for i in order]
        self.paths, m = [paths[i] for i in order], m[order]
        sizes = [len(terms[i]) for i in order]
        row, column = np.repeat(np.arange(len(order)), sizes), np.concatenate([terms[i] for i in order])
        tf = np.zeros((len(order), len(rank)), np.int32)
        tf[row, column] = np.concatenate([tfs[i] for i in order])
        self.exact = np.zeros(tf.shape, np.int32)
        self.exact[row, column] = part_of_score(tf[row, column], m[row])
        self.first, self.last, self.children = [], [], []
        self._grow(leaf)
        most = np.stack([tf[a:b].max(0) for a, b in zip(self.first, self.last)])
        least = np.array([m[a:b].min() for a, b in zip(self.first, self.last)])
        self.bound = part_of_score(most, least[:, None]).astype(np.int32)

    def _grow(self, leaf: int) -> None:
        def node(a: int, b: int) -> int:
            self.first.append(a)
            self.last.append(b)
            self.children.append([])
            return len(self.first) - 1

        paths = self.paths
        todo = [(node(0, len(paths)), 0)]
        while todo:
            at, depth = todo.pop()
            a, b = self.first[at], self.last[at]
            if b - a <= leaf or paths[a] == paths[b - 1]:
                continue
            while len(paths[a]) > depth and paths[a][: depth + 4] == paths[b - 1][: depth + 4]:
                depth += 4  # all go on with the same term
            i, alone = a, []
            while i < b:
                ahead = paths[i][: depth + 4]
                # paths are sorted: those that end here come first, then those of each next term
                end = bisect_left(paths, ahead + b"\xff" * 8, i, b) if len(ahead) > depth else bisect_left(paths, ahead + b"\x00", i, b)
                alone.append((i, end))
                i = end
            kept = 0  # neighbours of few documents share a leaf
            for k, (i, end) in enumerate(alone):
                begin = alone[kept][0]
                if end - begin > leaf or k == len(alone) - 1:
                    if end - begin > leaf and i > begin:
                        self.children[at].append(node(begin, i))
                        begin = i
                    child = node(begin, end)
                    self.children[at].append(child)
                    if end - begin > leaf:
                        todo.append((child, depth + 4))
                    kept = k + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, bool, int]], top: int = TOP) -> int:
        """Merges the documents below into best, ascending (-score, no id, id), of at most top; returns how many it scored."""
        bounds = self.bound[:, terms].astype(np.float64) @ weights  # sums stay below 2^53
        scored, todo = 0, [0]
        while todo:
            at = todo.pop()
            least = -best[-1][0] if len(best) == top else 1
            if bounds[at] < least:
                continue
            if self.children[at]:
                todo += sorted(self.children[at], key=bounds.__getitem__)
                continue
            a, b = self.first[at], self.last[at]
            scores = self.exact[a:b, terms].astype(np.float64) @ weights
            scored += b - a
            for i in np.flatnonzero(scores >= least).tolist():
                doc_id = self.ids[a + i]
                insort(best, (-int(scores[i]), doc_id is None, doc_id or 0))
                if len(best) > top:
                    best.pop()
        return scored


def best_of_tasks(found: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, rank: np.ndarray, top: int = TOP) -> DataFrame:
    """vectors() -> item, doc_id, score: the best of each task, by trees. asked: item, its terms, their weights with repeats."""
    size = max(64, min(TREE_DOCS, CELLS // max(1, len(rank))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in asked]
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                m = np.array([75 + 25 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
                terms, tfs = ([x.values.to_numpy() for x in b.column(c)] for c in ("terms", "tfs"))
                tree = Tree(b.column("doc_id").to_pylist(), terms, tfs, m, rank)
                for own, (_, t, w) in zip(best, asked, strict=True):
                    tree.search(t, w, own, top)
        rows = [(item, None if no_id else doc_id, -score) for own, (item, _, _) in zip(best, asked, strict=True) for score, no_id, doc_id in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The best of all tasks, in two steps, so that no task has an item's rows of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_s", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_s").orderBy(*order))).where(F.col("rank") <= top).drop("_s", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search_block(docs: DataFrame, block: list, top: int) -> DataFrame | None:
    """docs, rows of item_terms() -> item, doc_id, score, rank."""
    vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in block]))
    found = written(vectors(docs, vocabulary), "vectors")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    counts = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a term of the block
        counts[r["t"]] = r["df"]
    rank = np.argsort(np.argsort(-counts, kind="stable"))
    asked = []
    for r in block:
        place = np.searchsorted(vocabulary, np.array(r["terms"], np.int64))
        held = counts[place] > 0
        weights = np.array([k * weight(total["docs"], df) for k, df in zip(r["counts"], counts[place].tolist(), strict=True)], np.float64)
        asked.append((r["item"], place[held], weights[held]))
    return written(ranked(best_of_tasks(found, asked, total["docs"], total["terms"], rank, top), top).select("item", "doc_id", "score", "rank"), "ranked")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_terms_of_a_block: int = ITEM_TERMS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score."""
    asked = written(item_terms(items), "items")
    n = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-n // item_terms_of_a_block)
    whole: DataFrame | None = None
    for k in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()  # about item_terms_of_a_block terms
        part = search_block(docs, block, top) if block else None
        if part is not None:
            whole = part if whole is None else whole.unionByName(part)
    names = asked.select(F.col("item").alias("_item"), "item_id")
    if whole is None:
        return names.where(F.lit(False)).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return whole.join(names, F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sql() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH cut AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, len(w) AS n FROM cut WHERE len(w) > 0), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({words("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM cut) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
part AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS p FROM f JOIN d USING (r), s),
scored AS (SELECT item_id, r, doc_id, sum(k * w * p)::BIGINT AS score FROM part JOIN w USING (term) JOIN q USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}"""
