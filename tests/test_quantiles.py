"""Exact quantiles by selection against percentile()."""

import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import accuracy
from strandworks.operators.quantiles import exact_quantiles

PS = {"lowest": 0.0, "a": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "b": 0.987, "highest": 1.0}


def drawn(seed):
    r = random.Random(seed)
    shapes = [lambda: r.random(), lambda: r.choice([0.5, 0.5, 0.25]), lambda: r.gauss(0, 1e9), lambda: 1 + r.random() * 1e-13, lambda: 0.0 if r.random() < 0.9 else r.random() * 1e-300, lambda: None if r.random() < 0.5 else -float(r.randrange(50))]
    rows = [(f"m{k}", r.choice(["x", None]), shape()) for k, shape in enumerate(shapes) for _ in range(r.choice([1, 2, 3, 400, 1500]))]
    return [*rows, (None, "x", 0.25), (None, "x", 0.75), ("none", "x", None)]


@pytest.mark.parametrize(("seed", "few", "buckets"), [(0, 100_000, 4096), (1, 20, 16), (2, 1, 2), (3, 50, 4096)])
@pytest.mark.parametrize("groups", [(), ("model",), ("model", "caller")])
def test_equals_percentile(spark, seed, few, buckets, groups):
    rows = spark.createDataFrame(drawn(seed), "model string, caller string, identity double").repartition(3)
    want = rows.groupBy(*groups).agg(*[F.percentile("identity", F.lit(p)).alias(n) for n, p in PS.items()])
    got = exact_quantiles(rows, "identity", groups, PS, few, buckets)
    order = lambda frame: {tuple(r)[: len(groups)]: tuple(r)[len(groups) :] for r in frame.collect() if r["median"] is not None}
    assert order(got) == order(want)


def test_one_value_of_many_rows_and_many_rows_of_few_values(spark):
    rows = spark.range(200_000).select((F.when(F.col("id") % 2 == 0, 0.9).otherwise(F.col("id") / 4e5)).alias("identity"))
    want = rows.agg(*[F.percentile("identity", F.lit(p)).alias(n) for n, p in PS.items()]).first()
    assert tuple(exact_quantiles(rows, "identity", (), PS, 1000).first()) == tuple(want)


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "model string, caller string, identity double")
    assert tuple(accuracy.identity_summary(none).first()) == (None, None, None, None, None, 0)
    assert accuracy.identity_summary(none, ("model",)).count() == 0
    some = spark.createDataFrame([("a", "O", 0.5), ("a", "F", None), ("b", "F", 0.25)], none.schema)
    assert {tuple(r) for r in accuracy.identity_summary(some, ("model",)).collect()} == {("a", 0.5, None, 0.5, 0.5, 0.5, 1), ("b", 0.25, None, 0.25, 0.25, 0.25, 1)}
    assert {tuple(r) for r in accuracy.compare_runs(some, ("O", "F")).collect()} == {("a", 0.5, 0.5, None, None), ("b", None, None, 0.25, 0.25)}


def test_no_task_gathers_a_group(spark):
    """What windows put in order are counts of parts; rows are aggregated in part before they are shuffled."""
    rows = spark.range(50_000).select(F.lit("m").alias("model"), (F.col("id") / 1e5).alias("identity"))
    plan = exact_quantiles(rows, "identity", ("model",), {"median": 0.5}, 500)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "partial_count" in plan and "collect_" not in plan
