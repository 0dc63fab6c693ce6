"""Key constraints as counts of violating rows, and study-grouped splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums


def _row(df: DataFrame, name: str, n: Column) -> DataFrame:
    return df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")


def unique(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _row(n, name, F.sum(F.col("n") - 1))


def references(df: DataFrame, name: str, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Rows with a non-null col that other does not hold; rows are counted by value before they move."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return _row(n.join(other.select(F.col(other_col).alias("k")), "k", "left_anti"), name, F.sum("n"))


def not_null(df: DataFrame, name: str, col: str) -> DataFrame:
    return _row(df, name, F.count_if(F.col(col).isNull()))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def require(df: DataFrame, message: str) -> DataFrame:
    """df, which must have a row; looking for one is a job of its own."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_none(bad: DataFrame, message: str, col: str, show: int = 5) -> None:
    """No row may be bad; at most `show` of them are named."""
    if found := [str(r[0]) for r in bad.select(col).distinct().orderBy(col).limit(show).collect()]:
        raise ValueError(f"{message}: {found}")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def study_roles(df: DataFrame, study: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """study, n, role: whole studies fall to roles in order of a seeded hash, by the share of rows before them.

    Studies are ranged by the hash, so no task holds them all. shares sum to 1; the last role takes the rest.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(study).cast("string")).cast("binary"))
    n = df.groupBy(study).agg(F.count(F.lit(1)).alias("n")).withColumn("key", key)
    at = running_sums(n, [F.col("key"), F.col(study)], ["n"])
    total = at.agg(F.sum("n").alias("total"))
    placed = at.crossJoin(total).withColumn("at", F.col("before_n") / F.col("total"))  # total is one row
    *first, last = shares
    role, edge = F.lit(last), 0.0
    bounds = []
    for r in first:
        edge += shares[r]
        bounds.append((r, edge))
    for r, e in reversed(bounds):
        role = F.when(F.col("at") < e, F.lit(r)).otherwise(role)
    return placed.select(study, "n", role.alias("role"))
