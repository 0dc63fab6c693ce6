"""Exact medians at any size: a rank is closed in by counts between sketched bounds until what is left fits one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written

BUCKET = 100_000  # values that a task may sort at the end


def _bounds(values: DataFrame, x: str, share: float, slack: float) -> tuple[float, float]:
    """Values near the share of the order, from a sketch whose parts tasks merge."""
    around = [max(0.0, share - slack), min(1.0, share + slack)]
    return tuple(values.agg(F.percentile_approx(x, around, 10_000).alias("q")).first().q)


def value_at(values: DataFrame, x: str, rank: int, n: int, bucket: int = BUCKET, slack: float = 1e-3) -> float:
    """The value of 0-based rank `rank` among the n values of column x (no null, no NaN).

    Each round counts the values under, between and above two bounds around the rank; the rank lies between, or the slack grows.
    The part between is a two-thousandth of the rows or so, or one value repeated.
    """
    part, below, size = values, 0, n
    while size > bucket:
        lo, hi = _bounds(part, x, (rank - below) / max(size - 1, 1), slack)
        c = part.agg(F.count_if(F.col(x) < lo).alias("under"), F.count_if(F.col(x).between(lo, hi)).alias("within")).first()
        if not below + c.under <= rank < below + c.under + c.within:
            slack *= 8
            continue
        if lo == hi:
            return lo
        if c.within == size:  # the bounds are the ends: halve, so that a round always leaves less
            mid = lo + (hi - lo) / 2
            mid = lo if mid >= hi else mid
            left = part.filter(F.col(x) <= mid)
            m = left.count()
            part, below, size = (left, below, m) if rank < below + m else (part.filter(F.col(x) > mid), below + m, size - m)
            continue
        part, below, size = part.filter(F.col(x).between(lo, hi)), below + c.under, c.within
    return part.select(x).orderBy(x).limit(rank - below + 1).agg(F.max(x).alias("v")).first().v


def medians(df: DataFrame, cols: list[str], bucket: int = BUCKET) -> dict[str, float | None]:
    """The exact median of each column (the mean of the middle two where the count is even); null and NaN do not count, none is None.

    The columns are written once. Tables of one bucket are sorted in one task; larger ones go by value_at.
    """
    kept = written(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]))
    counts, out = kept.agg(*[F.count(c).alias(c) for c in cols]).first(), {}
    small = [c for c in cols if counts[c] <= bucket]
    if small:
        out = kept.agg(*[F.median(c).alias(c) for c in small]).first().asDict()
    for c in cols:
        if c in out:
            continue
        n, values = counts[c], kept.filter(F.col(c).isNotNull()).select(c)
        middle = {(n - 1) // 2, n // 2}
        out[c] = sum(value_at(values, c, r, n, bucket) for r in middle) / len(middle)
    release(kept)
    return {c: out[c] for c in cols}
