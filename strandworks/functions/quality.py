"""Column expressions over quality strings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: First and last quality character, and the smallest mean error, so that a score is 40 at most.
OFFSET = 33
LAST = 126
LEAST_ERROR = 1e-4
#: Characters that are looked up at once, or one string if it is longer; and strings that are added up side by side.
PIECE = 1 << 22
ABREAST = 256
ERRORS = np.array([10 ** ((c - OFFSET) / -10) for c in range(OFFSET, LAST + 1)])


def sums_of(errors: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of errors[start : start + size] of each string, added one by one from the left, as SQL engines do.

    Strings go side by side, a character of each at a time, while many are that long; the few longest are then finished one
    after the other.
    """
    order = np.argsort(-size, kind="stable")
    start, size, sums, k = start[order], size[order], np.zeros(len(size)), 0
    while (n := int(np.searchsorted(-size, -k))) >= ABREAST:  # strings longer than k
        sums[:n] += errors[start[:n] + k]
        k += 1
    for i in range(n):
        sums[i] = np.cumsum(np.r_[sums[i], errors[start[i] + k : start[i] + size[i]]])[-1]
    out = np.empty(len(size))
    out[order] = sums
    return out


def mean_errors(texts: pa.Array) -> pa.Array:
    """Mean error probability of each string, null for null or empty ones, by look-ups in the column's buffer.

    A character that is no quality ends the job.
    """
    wide = pa.types.is_large_string(texts.type)
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return pa.nulls(n, pa.float64())
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    codes, size = np.frombuffer(data, np.uint8), np.diff(at)
    sums = np.zeros(n)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1))
        part = codes[at[lo] : at[hi]]
        if len(part):
            if part.min() < OFFSET or part.max() > LAST:
                raise ValueError("a quality string has other characters than ! to ~")
            sums[lo:hi] = sums_of(ERRORS[part - OFFSET], at[lo:hi] - at[lo], size[lo:hi])
        lo = hi
    return pa.array(sums / np.maximum(size, 1), mask=size == 0)


def scores(texts: pa.Array) -> pa.Array:
    """Phred score of each string's mean error, null for null or empty ones.

    The logarithm is the C library's, as SQL engines take it: the JVM's own ends otherwise in the last bit for some errors, and
    scores are compared for equality. numpy's depends on the processor.
    """
    errors = mean_errors(texts)
    return pa.array([None if e is None else -10 * math.log10(max(e, LEAST_ERROR)) for e in errors.to_pylist()], pa.float64())


def read_score(quality: Column) -> Column:
    """Phred score of the mean error probability, null for null or empty strings.

    One Arrow step over whole columns: higher-order functions would make an object of each character.
    """
    return F.arrow_udf(scores, DoubleType())(quality)


def six_digits(score: Column) -> Column:
    """Rounded to six significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(F.nullif(score, F.lit(0.0))))))
    return F.coalesce(F.rint(score * scale) / scale, score)
