"""Running sums and maxima over a total order without a task that sees all rows: range partitions, then whole partitions' offsets.

The ranged rows are written once, as another run of the same range exchange may draw other bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order: _part, and _row, which rises along the order."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))


def running(rows: DataFrame, what, cols: list[str], keys: list[str] = (), first=None) -> DataFrame:
    """ranged rows with before_c for each c of cols: what(c) (a sum or a maximum) over the earlier rows of the same keys.

    Each partition runs its own; a row per partition and key carries what earlier partitions hold. `first` stands where nothing is earlier.
    """
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *keys).agg(*[what(c).alias(f"_all_{c}") for c in cols])
    offsets = parts.select("_part", *keys, *[what(f"_all_{c}").over(earlier).alias(f"_off_{c}") for c in cols])
    local = rows.select("*", *[what(c).over(inside).alias(f"_in_{c}") for c in cols])
    at = local.join(offsets, ["_part", *keys]) if keys else local.join(F.broadcast(offsets), "_part")  # a row per partition
    both = F.greatest if what is F.max else lambda a, b: F.coalesce(a + b, a, b)
    out = [F.coalesce(both(F.col(f"_in_{c}"), F.col(f"_off_{c}")), F.lit(first)).alias(f"before_{c}") for c in cols]
    return at.select(*rows.columns, *out)


def running_sums(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with before_x for each x of sums: the sum of x over all rows earlier in `order`, which must be total."""
    return running(ranged(df, order), F.sum, sums, first=0).drop("_part", "_row")


def ordered_lists(df: DataFrame, keys: list[str], value: str, piece: int = 10_000) -> DataFrame:
    """keys, piece and items: each key's values (not null) in order, in arrays of at most `piece`, numbered from 0.

    Rows range over all partitions by key and value, so a key of any size is spread; laid end to end, its pieces are its whole list.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"), F.lit(1).cast("long").alias("_one"))
    order = [*[F.col(k) for k in keys], F.col("_value")]
    placed = running(ranged(rows, order), F.sum, ["_one"], keys, first=0)
    at = placed.withColumn("piece", F.floor(F.col("before__one") / piece).cast("int"))
    lists = at.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("before__one", "_value"))).alias("l"))
    return lists.select(*keys, "piece", F.transform("l", lambda x: x["_value"]).alias("items"))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Dense ids of all rows along a total order."""
    counted = running_sums(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    return counted.withColumn(name, F.col("before__one") + start).drop("_one", "before__one")
