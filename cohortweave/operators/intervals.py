"""Point and interval operators: binned range joins, precedence, distance bands and interval merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged, running


FAN = 8  # ratio of the bin widths of neighbouring levels
LEVELS = 12


def points_in_intervals(points: DataFrame, intervals: DataFrame, slack: int = 0, bin_width: int = 1000) -> DataFrame:
    """Inner join of (chrom, pos) with (chrom, start, end), both ends inclusive, padded by slack.

    An interval falls to the level whose bins are about as wide as it, and explodes to at most FAN + 1 of them; a point lies in one bin
    of each level. The join thus has equal keys (chrom, level, bin) for narrow and very wide intervals, and no pair
    appears twice.
    """
    lo, hi = F.col("start") - slack, F.col("end") + slack
    span = F.greatest((hi - lo + 1).cast("double") / bin_width, F.lit(1.0))
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log(span) / F.log(F.lit(float(FAN))) + 1e-9).cast("int"))
    wide = intervals.withColumn("_level", level)
    width = bin_width * F.pow(F.lit(float(FAN)), F.col("_level"))
    binned = wide.withColumn("_bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    used = sorted(r[0] for r in wide.select("_level").distinct().collect() if r[0] is not None)  # at most LEVELS
    places = [F.struct(F.lit(k).alias("_level"), F.floor(F.col("pos") / (bin_width * FAN**k)).alias("_bin")) for k in used or [0]]
    at = points.withColumn("_at", F.explode(F.array(*places))).select(*points.columns, "_at._level", "_at._bin")
    return at.join(binned, ["chrom", "_level", "_bin"]).filter(F.col("pos").between(lo, hi)).drop("_level", "_bin")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def with_distance(df: DataFrame) -> DataFrame:
    """Distance to the interval and its side: left is south, right is north, inside is in."""
    left, right = F.col("start") - F.col("pos"), F.col("pos") - F.col("end")
    return df.withColumn("dist", F.greatest(left, right, F.lit(0))).withColumn(
        "side", F.when(left > 0, "south").when(right > 0, "north").otherwise("in")
    )


def distance_bands(points: DataFrame, islands: DataFrame, near: int, far: int) -> DataFrame:
    """The nearest island's band for each (chrom, pos); equal distances take the side first in order; none is open."""
    best = first_by(with_distance(points_in_intervals(points, islands, far)), ["chrom", "pos"], [F.col("dist"), F.col("side")])
    band = F.when(F.col("dist") == 0, "island").when(F.col("dist") <= near, F.concat("side", F.lit("_shore"))).otherwise(F.concat("side", F.lit("_shelf")))
    return points.join(best.select("chrom", "pos", band.alias("band")), ["chrom", "pos"], "left").withColumn("band", F.coalesce("band", F.lit("open")))


BUCKETS = 1 << 16  # counters of a task in the first look for large keys


def merge_intervals(df: DataFrame, key: str | list[str], gap: int = 1, most: int = 1_000_000) -> DataFrame:
    """Union of (start, end) per key; intervals that touch or lie `gap` apart become one. An interval without ends comes last, so it
    parts no others: it falls to its key's last run, or stays where its key has nothing else.

    Keys of up to `most` rows are merged by a window each. Larger ones are ranged by key and start over many tasks, where each
    partition learns how far the earlier ones reach.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, "start", "end")
    large = _large_keys(rows, keys, most)
    if large is None or large.isEmpty():
        return _merged_in_windows(rows, keys, gap)
    few = F.broadcast(large)  # keys of over `most` rows are few
    return _merged_in_windows(rows.join(few, keys, "left_anti"), keys, gap).unionByName(_merged_in_ranges(rows.join(few, keys, "left_semi"), keys, gap))


def _large_keys(rows: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """Keys of over `most` rows. Rows are counted by a hash first, which moves BUCKETS counts a task at most; None where no
    bucket is that large, and else only the keys of large buckets are counted."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = [r[0] for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()]
    if not full:
        return None
    return rows.filter(bucket.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*keys)


def _in_order() -> list[Column]:
    return [F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last()]


def _merged_in_windows(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_in_order())
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("fresh", _fresh(before, gap))
    runs = flagged.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _extents(runs, keys)


def _merged_in_ranges(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    reached = running(ranged(rows, [*[F.col(k) for k in keys], *_in_order()]), F.max, ["end"], keys)
    flagged = reached.withColumn("fresh", _fresh(F.col("before_end"), gap))
    return _extents(running(flagged, F.sum, ["fresh"], keys, first=0).withColumn("run", F.col("before_fresh") + F.col("fresh")), keys)


def _fresh(before: Column, gap: int) -> Column:
    """1 where a row opens a new run: nothing earlier reaches it."""
    return F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0).cast("long")


def _extents(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
