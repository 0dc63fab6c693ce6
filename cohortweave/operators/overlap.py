"""Overlaps of many id sets from their membership patterns: each id moves once, pairs come from the few patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 62  # families in a long


def membership_patterns(rows: DataFrame, family: str, key: str, families: list) -> DataFrame:
    """(pattern, n): how many ids are in just these families; pattern is the sorted list of their places in `families`.

    An id's rows fold to bits before they move, so an id of any number of rows is a row per task.
    """
    of = lambda w: families[w * WORD : (w + 1) * WORD]
    words = range(-(-len(families) // WORD)) or range(1)
    bit = lambda w: reduce(lambda c, i: F.when(F.col(family) == F.lit(of(w)[i]), F.lit(1 << i)).otherwise(c), range(len(of(w))), F.lit(0)).cast("long")
    held = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[bit(w).alias(f"w{w}") for w in words])
    masks = held.groupBy("k").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words])
    n = masks.groupBy(*[f"w{w}" for w in words]).agg(F.count(F.lit(1)).alias("n"))
    at = F.sequence(F.lit(0), F.lit(max(len(families) - 1, 0)))
    has = lambda i: reduce(lambda c, w: F.when(F.floor(i / WORD) == w, F.getbit(f"w{w}", i % WORD)).otherwise(c), words, F.lit(0)) == 1
    return n.select(F.filter(at, has).alias("pattern"), "n").filter(F.size("pattern") > 0)


def families_of(rows: DataFrame, family: str, most: int = 2000) -> list:
    """The families' names in order; more than `most` is an error, as their pairs are the result's size."""
    found = [r[0] for r in rows.filter(F.col(family).isNotNull()).select(family).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} families")
    return sorted(found)


def pairwise_overlap(rows: DataFrame, family: str, key: str) -> DataFrame:
    """(a, b, n) for all pairs of families a < b: distinct ids in both, zero where there are none."""
    families = families_of(rows, family)
    spark, kind = rows.sparkSession, rows.schema[family].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(families)), f"i int, name {kind}")
    patterns = membership_patterns(rows, family, key, families)
    a = patterns.select("n", F.explode("pattern").alias("i"), "pattern")
    both = a.select("n", "i", F.explode("pattern").alias("j")).filter("i < j").groupBy("i", "j").agg(F.sum("n").alias("n"))
    grid = names.select("i", F.col("name").alias("a")).join(names.select(F.col("i").alias("j"), F.col("name").alias("b")), F.col("i") < F.col("j"))  # a row a pair of the result
    return grid.join(both, ["i", "j"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def common_ids(rows: DataFrame, family: str, key: str) -> DataFrame:
    """One row: families, distinct ids in any (the union) and in all (the intersection)."""
    families = families_of(rows, family)
    p = membership_patterns(rows, family, key, families)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return p.agg(total("n").alias("n_any"), total(F.when(F.size("pattern") == len(families), F.col("n"))).alias("n_all")).select(F.lit(len(families)).alias("n_families"), "*")


def column_overlap(tables: dict[str, DataFrame], name_of=lambda c: c) -> DataFrame:
    """Per column name over the tables' own schemas: n_tables that have it, everywhere, n_rows and n_values (not null) over them.

    name_of maps a table's column to the name that tables share. Tables are counted in one pass each.
    """
    parts = []
    for table, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        long = counts.select(F.explode(F.array(*[F.struct(F.lit(name_of(c)).alias("name"), F.col("_rows").alias("n_rows"), F.col(f"`{c}`").alias("n_values")) for c in df.columns])).alias("x"))
        parts.append(long.select(F.lit(table).alias("tab"), "x.*"))
    n = reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.count_distinct("tab").alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))
    return n.withColumn("everywhere", F.col("n_tables") == len(tables))
