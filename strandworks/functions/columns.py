"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; a column that use() repeats in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
