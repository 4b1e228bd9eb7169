"""Exact quantiles of groups of any size by distributed selection.

A quantile is one order statistic of its group or lies between two. Each is looked for in an interval of values, at first from
the group's smallest to its largest: rows are counted by BUCKETS equal parts of it, and the search goes on in the part that holds
the rank, from the smallest to the largest value there. Once few rows are left in it, or one value only, they are counted by
value. No task holds a group: counting is partial before it is shuffled, and what is put in order are the parts' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import written

BUCKETS = 4096
#: An interval of at most so many rows is counted by value at once.
FEW_ROWS = 100_000
#: Intervals up to this many go to every task.
FEW_INTERVALS = 50_000


def same(groups: list[str], left: str, right: str) -> Column:
    """Whether the groups agree, null with null; true without groups."""
    whole = F.lit(True)
    for i in range(len(groups)):
        whole = whole & F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}"))
    return whole


def ranks(ps: tuple[float, ...]) -> Column:
    """The places (from 0) of the order statistics that the quantiles of n rows need."""
    at = [p * (F.col("n") - 1) for p in ps]
    return F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))


def inside(rows: DataFrame, targets: DataFrame, groups: list[str], few: bool) -> DataFrame:
    """rows (g0.., v) in the intervals of targets (t0.., lo, hi), with these columns; an interval counts once for all its ranks."""
    found = targets.select(*[f"t{i}" for i in range(len(groups))], "one", "lo", "hi").distinct()
    return rows.join(F.broadcast(found) if few else found, (F.col("key") == F.col("one")) & same(groups, "g", "t") & F.col("v").between(F.col("lo"), F.col("hi")))


def before(keys: list[Column], order: str, count: str) -> Column:
    """How many rows stand in the parts before."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def order_statistics(rows: DataFrame, value: str, groups: tuple[str, ...], ps: tuple[float, ...], few_rows: int = FEW_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """rows -> t0.. (the groups), n, k, x: the k-th smallest value of each group, from 0, for every k that ps need; nulls are none.

    rows are looked at several times, so they should be a written table.
    """
    names = list(groups)
    g, t = [f"g{i}" for i in range(len(names))], [f"t{i}" for i in range(len(names))]
    base = rows.select(*[F.col(c).alias(x) for c, x in zip(names, g, strict=True)], F.lit(0).alias("key"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    sizes = base.groupBy("key", *g).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    targets = sizes.select(*[F.col(a).alias(b) for a, b in zip(g, t, strict=True)], F.col("key").alias("one"), "n", F.explode(ranks(ps)).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("skip"), F.col("n").alias("held"))
    targets = written(targets, "ranks")
    few = targets.count() <= FEW_INTERVALS
    wide = (F.col("held") > few_rows) & (F.col("lo") < F.col("hi"))
    interval = [*map(F.col, t), F.col("lo"), F.col("hi")]
    while not targets.where(wide).isEmpty():
        met = inside(base, targets.where(wide), names, few)
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1)).alias("part")
        counts = met.groupBy(*t, "lo", "hi", part).agg(F.count("*").alias("c"), F.min("v").alias("part_lo"), F.max("v").alias("part_hi"))
        counts = counts.withColumn("earlier", before(interval, "part", "c"))
        counts = written(counts.select(*[F.col(x).alias(f"p{i}") for i, x in enumerate(t)], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "c", "earlier", "part_lo", "part_hi"), "parts")
        here = same(names, "t", "p") & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("k") - F.col("skip") >= F.col("earlier")) & (F.col("k") - F.col("skip") < F.col("earlier") + F.col("c"))
        closer = targets.where(wide).join(counts, here).select(*t, "one", "n", "k", F.col("part_lo").alias("lo"), F.col("part_hi").alias("hi"), (F.col("skip") + F.col("earlier")).alias("skip"), F.col("c").alias("held"))
        targets = written(targets.where(~wide).unionByName(closer), "ranks")
    many = F.col("lo") < F.col("hi")
    values = inside(base, targets.where(many), names, few).groupBy(*t, "lo", "hi", "v").agg(F.count("*").alias("c")).withColumn("earlier", before(interval, "v", "c"))
    values = values.select(*[F.col(x).alias(f"p{i}") for i, x in enumerate(t)], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "v", "c", "earlier")
    here = same(names, "t", "p") & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("k") - F.col("skip") >= F.col("earlier")) & (F.col("k") - F.col("skip") < F.col("earlier") + F.col("c"))
    found = targets.where(many).join(values, here).select(*t, "n", "k", F.col("v").alias("x"))
    return found.unionByName(targets.where(~many).select(*t, "n", "k", F.col("lo").alias("x")))


def exact_quantiles(rows: DataFrame, value: str, groups: tuple[str, ...], ps: dict[str, float], few_rows: int = FEW_ROWS, buckets: int = BUCKETS, held: bool = False) -> DataFrame:
    """rows (groups, value) -> t0.. (the groups), and a column for each of ps (name: quantile), as percentile() would give them.

    Between two order statistics a quantile is linear. Groups without values give no row. held: rows are a written table.
    """
    found = order_statistics(rows if held else written(rows.select(*groups, value), "values"), value, groups, tuple(ps.values()), few_rows, buckets)

    def of(p: float) -> Column:
        at = F.lit(p) * (F.first("n") - 1)
        x = lambda k: F.max(F.when(F.col("k") == k.cast("long"), F.col("x")))
        place = F.lit(p) * (F.col("n") - 1)
        low, high = x(F.floor(place)), x(F.ceil(place))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.groupBy(*[f"t{i}" for i in range(len(groups))]).agg(*[of(p).alias(name) for name, p in ps.items()])


def with_quantiles(summary: DataFrame, rows: DataFrame, value: str, groups: tuple[str, ...], ps: dict[str, float]) -> DataFrame:
    """summary (groups, ...: one row a group) with the quantiles of the groups of rows, a written table; null where a group has no values."""
    found = exact_quantiles(rows, value, groups, ps, held=True)
    named = summary.toDF(*[f"s_{c}" for c in summary.columns])
    agree = F.lit(True)
    for i, c in enumerate(groups):
        agree = agree & F.col(f"s_{c}").eqNullSafe(F.col(f"t{i}"))
    return named.join(found, agree, "left").select(*[F.col(f"s_{c}").alias(c) for c in summary.columns], *ps)
