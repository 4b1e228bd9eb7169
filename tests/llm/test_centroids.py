"""Clustering by lookup tables against plain Python and SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from strandworks.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<double>"
SF = "/root/testdata/sf0.001"


def plain(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    now = [v for _, v in first]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        for n in range(len(now)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if members:
                now[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *best(v)[::-1]) for i, v in kept]
    of = lambda n: sum(d for _, c, d in found if c == n)
    return sorted(((i, c, d, of(c), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def run(spark, rows, **k):
    return sorted((tuple(r) for r in ce.cluster_vectors(spark.createDataFrame(rows, SCHEMA), **k).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_python(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1, 1]) * r.random() * 10 ** r.randrange(-2, 3) for _ in range(64)]) for i in range(120)]
    rows += rows[:30]
    assert run(spark, rows) == plain(rows)


def test_ties_repeats_and_what_is_left_out(spark):
    r = random.Random(5)
    few = [[float(r.randrange(-1, 2)) for _ in range(4)] for _ in range(6)]
    rows = [(i % 20, few[i % 6]) for i in range(60)] + [(None, few[0]), (None, few[1])]
    rows += [(100, None), (101, [1.0] * 3), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [float("inf")] * 4), (105, []), (106, [-0.001] * 4)]
    got = run(spark, rows, k=5, dimensions=4)
    assert got == plain(rows, k=5, dimensions=4) and len(got) == 63
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(7, [0.5, 0.5])], dimensions=2) == plain([(7, [0.5, 0.5])], dimensions=2)


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="a component passes"):
        run(spark, [(1, [1e30, 0.0])], dimensions=2)


def test_other_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "x", "y")], "vec_id long, embedding array<double>, v string, cluster string")
    assert ce.cluster_vectors(rows, dimensions=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_tables_are_those_of_occurring_values():
    v = np.array([[3, -5], [3, 7], [-2, 7]])
    codes, values, starts = np.array([[1, 2], [1, 3], [0, 3]]), np.array([-2, 3, -5, 7]), np.array([0, 2, 4])
    centroids = np.array([[0, 0], [3, 7], [3, 7]])
    best, distance = ce.nearest(codes, values, starts, centroids)
    assert best.tolist() == [0, 1, 1] and distance.tolist() == [34, 0, 25]
    assert (values[codes] == v).all()


def test_blocks_do_not_change_the_result(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    frame = ce.integers(spark.createDataFrame(rows, SCHEMA), 8)
    for size in (1, 7, 4096):
        found = ce.blocks(frame, 8, size)
        assert ce.moved(found, [[0] * 8, [64] * 8]) == ce.moved(ce.blocks(frame.repartition(3), 8), [[0] * 8, [64] * 8])


def test_the_registered_query_equals_sql(spark):
    want = duckdb.connect()
    want.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = ce.op13_centroids(spark, SF)
    names = ", ".join(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.execute(f"SELECT {names} FROM ({ce.op13_sql()})").fetchall())
