"""Centroid clustering of integer vectors by scalar lookup tables.

A vector's component x becomes the integer floor(64 * x). Vectors are kept in blocks: for each dimension the integers that
occur in the block, and for each component its place among them. A round tabulates, for each block, the squared difference of
each occurring integer and each centroid's component; distances are then gathers from that table and sums over dimensions, and
no vector is multiplied. Blocks are bounded, so are their tables, however many integers occur in all. The driver sees the
centroids only.

Vectors that are null, have another number of components than DIMENSIONS, or a null or non-finite one are left out. One whose
integers pass MOST ends the job, as a distance might not fit into 64 bits. Repeated rows count as often as they stand; equal
hashes (of repeated or null vec_ids, null hashed as empty) are ordered by components. With fewer vectors than CENTROIDS there
are as many centroids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
MOST = 1 << 27
BLOCK = 4096


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, v (array of integers) of those kept."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.where(F.coalesce(F.size("x") == dimensions, F.lit(False))).where(F.forall("x", finite))
    large = F.raise_error(F.lit(f"a component passes {MOST} / {SCALE}")).cast("bigint")
    whole = F.transform("x", lambda x: F.when(F.abs(x * SCALE) <= MOST, F.floor(x * SCALE)).otherwise(large))
    return rows.select("vec_id", whole.alias("v"))


def blocks(rows: DataFrame, dimensions: int = DIMENSIONS, size: int = BLOCK) -> DataFrame:
    """rows (vec_id, v) -> ids, codes, values, starts: values[starts[d] : starts[d + 1]] occur in dimension d, codes are places in values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, dimensions)
                found = [np.unique(v[:, d], return_inverse=True) for d in range(dimensions)]
                starts = np.cumsum([0, *(len(u) for u, _ in found)])
                codes = np.stack([inverse + at for (_, inverse), at in zip(found, starts)], 1).astype("<i4")
                columns = [[b.column("vec_id").to_pylist()], [codes.tobytes()], [np.concatenate([u for u, _ in found]).tolist()], [starts.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], ["ids", "codes", "values", "starts"])

    return rows.mapInArrow(run, "ids array<long>, codes binary, values array<long>, starts array<int>")


def nearest(codes: np.ndarray, values: np.ndarray, starts: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector of a block, the smaller one at a tie, and the squared distance."""
    dimension = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    squares = (values[:, None] - centroids.T[dimension]) ** 2  # a row an occurring value, a column a centroid
    distance = np.zeros((len(codes), len(centroids)), np.int64)
    for d in range(codes.shape[1]):
        distance += squares[codes[:, d]]
    best = distance.argmin(1)
    return best, distance[np.arange(len(codes)), best]


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, codes, values and starts of each block of a batch."""
    for ids, codes, values, starts in zip(*(b.column(c) for c in ("ids", "codes", "values", "starts")), strict=True):
        yield ids.values, np.frombuffer(codes.as_py(), "<i4").reshape(len(ids.values), -1), values.values.to_numpy(), starts.values.to_numpy()


def moved(found: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: exact floors of their vectors' means; one without vectors stays."""
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for b in batches:
            for _, codes, values, starts in unpacked(b):
                best, _ = nearest(codes, values, starts, now)
                for c in np.unique(best):
                    sums[c] += values[codes[best == c]].sum(0)
                counts += np.bincount(best, minlength=len(now))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now)), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = found.mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0").select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    total = parts.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    after = [list(c) for c in centroids]
    for r in total.collect():  # a row a centroid and dimension
        after[r["cluster"]][r["d"]] = int(r["s"]) // r["n"]
    return after


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = integers(vectors, dimensions)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [r["v"] for r in rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]
    out = "vec_id long, cluster int, distance long"
    if not centroids:
        return rows.sparkSession.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    found = written(blocks(rows, dimensions), "blocks")
    for _ in range(rounds):
        centroids = moved(found, centroids)
    last = np.array(centroids, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, values, starts in unpacked(b):
                best, distance = nearest(codes, values, starts, last)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(found.mapInArrow(assign, out), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = [F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]
    return assigned.select("vec_id", "cluster", "distance", F.get(F.array(*inertia), F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_sql() -> str:
    nearest_sql = "SELECT i, min(d * 16 + k) % 16 AS k, min(d * 16 + k) // 16 AS d FROM (SELECT i, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY i"
    sql = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT k, c FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v AS c FROM kept) WHERE k < {CENTROIDS})"""
    for r in range(ROUNDS):
        sql += f""",
a{r} AS MATERIALIZED ({nearest_sql.format(r=r)}),
s{r} AS (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(len(v))) AS p FROM kept JOIN a{r} USING (i)) GROUP BY k, p),
m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))"""
    return (
        sql
        + f""",
a{ROUNDS} AS MATERIALIZED ({nearest_sql.format(r=ROUNDS)})
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (i) JOIN c{ROUNDS} USING (k)"""
    )
