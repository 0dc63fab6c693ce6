"""Ragged segment reductions; the segment dimension keeps empty segments in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

POOLS = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "mean": lambda v: F.coalesce(F.avg(v), F.lit(0.0)),
    "sqrt_sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)) / F.greatest(F.sqrt(F.count(v).cast("double")), F.lit(1.0)),
    "max": lambda v: F.coalesce(F.max(v), F.lit(0.0)),
}


def segment_pool(values: DataFrame, how: str, segments: DataFrame | None = None, n_dims: int = 1) -> DataFrame:
    """values: segment, dim, v. One row per segment and dim (0 to n_dims - 1 of given segments): pooled, present."""
    if how not in POOLS:
        raise ValueError(f"unknown pool {how!r}")
    rows = values
    if segments is not None:
        grid = segments.select("segment", F.explode(F.sequence(F.lit(0), F.lit(n_dims - 1))).alias("dim"))
        rows = grid.join(values, ["segment", "dim"], "left")
    return rows.groupBy("segment", "dim").agg(POOLS[how]("v").alias("pooled"), (F.count("v") > 0).alias("present"))


def segment_softmax(values: DataFrame) -> DataFrame:
    """values: segment, v. Adds p, shifted by the segment's maximum; aggregates join back, so no segment sits in one task."""
    top = values.groupBy("segment").agg(F.max("v").alias("top"))
    shifted = values.join(top, "segment").withColumn("e", F.exp(F.col("v") - F.col("top")))
    total = shifted.groupBy("segment").agg(F.sum("e").alias("total"))
    return shifted.join(total, "segment").withColumn("p", F.col("e") / F.greatest("total", F.lit(1e-12))).drop("e", "top", "total")


def segment_count(values: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of each segment, 0 for those without."""
    n = values.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return segments.select("segment").join(n, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))


def dense_ids(df: DataFrame, col: str, name: str = "id") -> DataFrame:
    """0-based ids of the sorted distinct values (a vocabulary or ontology), without a task that sees them all."""
    return numbered(df.select(col).distinct(), [F.col(col)], name)
