"""Exact quantiles by distributed selection: counting over narrowing ranges, no aggregate that holds the values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges counted at once, and values that are looked at one by one at last.
RANGES, FEW = 1000, 10_000


def ranked_value(df: DataFrame, value: str, rank: int, few: int | None = None) -> float:
    """The value with ``rank`` smaller or equal ones before it in ascending order, of a column of doubles without nulls.

    Each pass counts equal ranges of what is left between two values, with each range's least and greatest value, and
    goes on in the range that holds the rank: RANGES rows a pass come to the driver. It ends where a range holds one
    value, however often, or FEW rows at most.
    """
    few = FEW if few is None else few
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v"))
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= rank < n:
        raise IndexError(f"rank {rank} of {n} values")
    while lo < hi and n > few:
        own = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        at = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * RANGES), F.lit(RANGES - 1))
        for r in own.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at").collect():
            if rank < r["n"]:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            rank -= r["n"]
    if lo == hi:
        return lo
    return sorted(r["v"] for r in rows.where((F.col("v") >= lo) & (F.col("v") <= hi)).collect())[rank]


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], few: int | None = None) -> list[float | None]:
    """The quantiles of a column, interpolated between the two values beside each share as ``percentile`` does; nulls and
    NaN don't count, and of no values there are none."""
    own = df.select(F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    n = own.count()
    if not n:
        return [None] * len(shares)
    known: dict[int, float] = {}
    at = lambda k: known.setdefault(k, ranked_value(own, value, k, few)) if k not in known else known[k]
    out = []
    for share in shares:
        place = share * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        out.append(at(low) if low == high else (high - place) * at(low) + (place - low) * at(high))
    return out
