"""Quality control and profiling in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import medians


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def qc_stats(df: DataFrame, value: str, keys: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    v = F.col(value)
    ok = F.when(finite(v), v)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~F.coalesce(finite(v), F.lit(False))).alias("n_missing"), F.count_if(finite(v)).alias("n_finite"),
        F.count_if(finite(v) & ((v < lo) | (v > hi))).alias("n_out_of_range"),
        F.min(ok).alias("v_min"), F.max(ok).alias("v_max"), F.round(F.avg(ok), 6).alias("v_mean"),
    )


def value_counts(df: DataFrame, col: str, top: int) -> DataFrame:
    """The `top` most frequent values, ties by value, null as __NULL__; further values go into one row __truncated_levels__, counted as levels."""
    c = F.coalesce(F.col(col).cast("string"), F.lit("__NULL__")).alias("value")
    n = df.select(c).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = n.orderBy(F.desc("n"), "value").limit(top)
    rest = n.agg((F.count(F.lit(1)) - top).alias("n")).filter("n > 0").select(F.lit("__truncated_levels__").alias("value"), "n")
    return best.unionByName(rest)


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows, non-null rate, distinct values, kind, numeric share, min, max and mean of what parses.

    numeric where 80 % of the values parse, else categorical up to max(20, 5 % of the rows) values, else string.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "s")
    x = F.expr("try_cast(s AS double)")
    kind = F.when((F.col("numeric_rate") >= 0.8) & (F.col("n_unique") > 0),
        "numeric").when(F.col("n_unique") <= F.greatest(F.lit(20.0), 0.05 * F.col("n")), "categorical").otherwise("string")
    return long.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count("s") / F.count(F.lit(1)), 6).alias("non_null_rate"), F.countDistinct("s").alias("n_unique"),
        F.round(F.count(x) / F.greatest(F.count("s"), F.lit(1)), 6).alias("numeric_rate"),
        F.round(F.min(x), 6).alias("v_min"), F.round(F.max(x), 6).alias("v_max"), F.round(F.avg(x), 4).alias("v_mean"),
    ).withColumn("kind", kind)


def top_values(df: DataFrame, cols: list[str], top: int = 8) -> DataFrame:
    """(col, place, value, n): the `top` most frequent values of the categorical columns of column_profile, ties by value; null is no value."""
    kinds = column_profile(df, cols).filter("kind = 'categorical'").select("col")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "value").filter("value IS NOT NULL")
    n = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "col")  # kinds: a row per column
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "value"))  # each task passes on its own first `top`
    return n.select("col", place.alias("place"), "value", "n").filter(F.col("place") <= top)


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: missing, unparsed and numeric values of a text column, with least, middle and greatest; the middle by medians()."""
    text = F.nullif(F.btrim(F.col(col).cast("string")), F.lit(""))
    x = text.try_cast("double")
    middle = medians(df.select(x.alias("x")), ["x"])["x"]
    return df.agg(
        F.count_if(text.isNull()).alias("n_missing"), F.count_if(text.isNotNull() & x.isNull()).alias("n_unparsed"), F.count(x).alias("n_numeric"),
        F.min(x).alias("v_min"), F.lit(middle).cast("double").alias("v_median"), F.max(x).alias("v_max"),
    )


def id_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct ids on either side, on both and on one only, and whether they agree."""
    mark = lambda df, c: df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(c, F.lit(1))
    j = mark(a, "in_a").join(mark(b, "in_b"), key, "full")
    s = j.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"))
    return s.select("*", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"),
        ((F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).alias("aligned"))


def compare_sources(df: DataFrame, a: str, b: str, keys: list[str], at: str) -> DataFrame:
    """Agreement of two measurements of the same cells; worst_at is the cell (column `at`) of the greatest difference, the greatest of ties."""
    d = F.abs(F.col(a) - F.col(b))
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 8).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 8).alias("rmse"),
        F.round(F.corr(a, b), 6).alias("r"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n_mismatch"), *[F.round(F.avg((d <= x).cast("double")),
            6).alias(f"within{i or ''}") for i, x in enumerate((0.005, 0.02, 0.1))],
        F.max(d).alias("_worst"),
    )
    worst = df.join(F.broadcast(stats.select(*keys, "_worst")), keys).filter(d == F.col("_worst")).groupBy(*keys).agg(F.max(at).alias("worst_at"))
    return stats.join(worst, keys, "left").drop("_worst")


def compare_grids(a: DataFrame, b: DataFrame, row: str, col: str, value: str = "beta") -> DataFrame:
    """Per shared row of two sources, over their shared columns: n cells of the dense grid, n_a and n_b with a value, n_one_side, n_neither, mae.

    The grid is never made: cells that either side holds meet in a full join, and what neither holds is the rest of the row's width.
    Cells (row, col) are unique on each side.
    """
    shared = lambda k: a.select(k).distinct().join(b.select(k).distinct(), k)
    rows, cols = shared(row), shared(col)
    side = lambda df, name: df.select(row, col, F.col(value).alias(name)).join(rows, row, "left_semi").join(cols, col, "left_semi")
    both = side(a, "of_a").join(side(b, "of_b"), [row, col], "full")
    one = F.col("of_a").isNull() != F.col("of_b").isNull()
    per = both.groupBy(row).agg(
        F.count("of_a").alias("n_a"), F.count("of_b").alias("n_b"), F.count_if(one).alias("n_one_side"),
        F.count_if(F.coalesce("of_a", "of_b").isNotNull()).alias("n_any"), F.avg(F.abs(F.col("of_a") - F.col("of_b"))).alias("mae"))
    width = cols.agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.join(per, row, "left").crossJoin(width)  # one row
    return out.select(row, "n", zero("n_a"), zero("n_b"), zero("n_one_side"), (F.col("n") - F.coalesce("n_any", F.lit(0))).alias("n_neither"), "mae")


def extremes(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of least and of greatest score as side best and worst, ties by key; rows whose score is null or NaN come last on both."""
    s = df.withColumn(score, F.nanvl(F.col(score), F.lit(None).cast("double")))
    end = lambda order, side: s.orderBy(order, key).limit(k).withColumn("side", F.lit(side))
    return end(F.asc_nulls_last(score), "best").unionByName(end(F.desc_nulls_last(score), "worst"))
