"""Long measurement cells: quality roll-ups, ingest, round trips, and the rows a scorer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import m_value
from .checks import require
from .ordered import numbered
from .profile import finite
from .ranks import medians


def ingest(cells: DataFrame, columns: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells (sample_id, probe_id, beta) at their places: row_index, col_index, beta; probes without a column fall out.

    columns: probe_id, locus_id. samples: sample_id, row_index. Columns are numbered by locus. Out-of-range values stay as they are.
    """
    placed = numbered(columns.select("probe_id", "locus_id"), [F.col("locus_id")], "col_index")
    return cells.join(samples, "sample_id").join(placed, "probe_id").select("row_index", "col_index", "beta")


def matrix_summary(cells: DataFrame, n_rows: int, n_cols: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One row: finite, missing (absent cells too) and out-of-range counts, extremes, population mean and deviation over a dense n_rows x n_cols grid."""
    v = F.when(finite(F.col("beta")), F.col("beta"))
    s = cells.agg(F.count(v).alias("n_finite"), F.count_if((v < lo) | (v > hi)).alias("n_out_of_range"), F.min(v).alias("v_min"),
        F.max(v).alias("v_max"), F.round(F.avg(v), 6).alias("v_mean"), F.round(F.stddev_pop(v), 6).alias("v_std"))
    return s.select(F.lit(n_rows * n_cols).cast("long").alias("n_cells"), (F.lit(n_rows * n_cols) - F.col("n_finite")).cast("long").alias("n_missing"), "*")


def corpus_summary(cells: DataFrame, row: str, col: str, beta: str, n_cols: int) -> DataFrame:
    """One row: loci without variance, and least, middle and most of the samples' missing shares and means."""
    v = F.when(finite(F.col(beta)), F.col(beta))
    flat = cells.groupBy(col).agg(F.max(v).alias("hi"), F.min(v).alias("lo")).agg(F.count_if(F.col("hi") == F.col("lo")).alias("n_flat"))
    each = cells.groupBy(row).agg((1 - F.count(v) / F.lit(n_cols)).alias("gone"), F.avg(v).alias("mean"))
    middle = medians(each, ["gone", "mean"])
    three = lambda c: [F.round(F.min(c), 6).alias(f"{c}_min"), F.round(F.lit(middle[c]).cast("double"), 6).alias(f"{c}_median"), F.round(F.max(c), 6).alias(f"{c}_max")]
    return flat.crossJoin(each.agg(*three("gone"), *three("mean")))  # a row each


def round_trip(stored: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """n, n_mismatch, max_diff of stored cells against raw ones as float32; a value on one side only is a mismatch, raw-only cells are not compared."""
    j = stored.select(*keys, F.col("beta").cast("float").alias("a")).join(raw.select(*keys, F.col("beta").cast("float").alias("b")), keys, "left")
    gap = F.abs(F.col("a").cast("double") - F.col("b").cast("double"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_mismatch"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_diff"))


def chosen_rows(samples: DataFrame) -> DataFrame:
    """The first, middle and last sample by row_index."""
    n = samples.agg(F.max("row_index").alias("m")).first()["m"]
    return samples.filter(F.col("row_index").isin(*({0, n // 2, n} if n is not None else set())))


def locus_gene_pairs(columns: DataFrame, locus_region: DataFrame, regions: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct (col_index, gene_id), with gene_index by name; only columns below `most` where it is set."""
    c = columns if most is None else columns.filter(F.col("col_index") < most)
    pairs = c.join(locus_region, "locus_id").join(regions.select("region_id", "gene_id"), "region_id").select("col_index", "gene_id").distinct()
    genes = numbered(require(pairs, "no column lies in a gene").select("gene_id").distinct(), [F.col("gene_id")], "gene_index")
    return pairs.join(genes, "gene_id")


def static_columns(columns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every column with its locus's vector and whether it has one."""
    return columns.join(vectors.select("locus_id", "vector"), "locus_id", "left").select("col_index", "locus_id", "vector", F.col("vector").isNotNull().alias("valid"))


def feature_rows(cells: DataFrame, static: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (row_index, gene_index, col_index) with features [beta, M, vector...] where both are there."""
    e = _edges(cells, static, pairs).filter("NOT no_value AND valid")
    return e.select("row_index", "gene_index", "col_index", F.concat(F.array(F.col("beta"), m_value(F.col("beta"))),
        F.transform("vector", lambda x: x.cast("double"))).alias("features"))


def feature_drops(cells: DataFrame, static: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per sample: observed edges, and those dropped for a missing value (counted first) or a missing vector."""
    e = _edges(cells, static, pairs)
    return e.groupBy("row_index").agg(
        F.count_if(~F.col("no_value") & F.col("valid")).alias("n_observed"), F.count_if(F.col("no_value")).alias("n_no_value"),
        F.count_if(~F.col("no_value") & ~F.col("valid")).alias("n_no_vector"),
    )


def _edges(cells: DataFrame, static: DataFrame, pairs: DataFrame) -> DataFrame:
    e = cells.join(static.select("col_index", "vector", "valid"), "col_index").join(pairs.select("col_index", "gene_index"), "col_index")
    return e.withColumn("no_value", ~F.coalesce(finite(F.col("beta")), F.lit(False)))


def vector_summary(vectors: DataFrame, col: str, near_zero: float = 1e-6) -> DataFrame:
    """One row: norms (mean, population deviation, extremes, near-zero count) and the spread of the per-dimension variances."""
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n = vectors.select(norm.alias("norm")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("norm"), 6).alias("norm_mean"), F.round(F.stddev_pop("norm"), 6).alias("norm_std"),
        F.round(F.min("norm"), 6).alias("norm_min"), F.round(F.max("norm"), 6).alias("norm_max"), F.count_if(F.col("norm") <= near_zero).alias("n_near_zero"),
    )
    dims = vectors.select(F.posexplode(col).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("var"))
    d = dims.agg(F.round(F.avg("var"), 6).alias("var_mean"), F.round(F.min("var"), 6).alias("var_min"), F.round(F.max("var"), 6).alias("var_max"))
    return n.crossJoin(d)  # a row each


def same_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places (col_index, locus_id) where two matrices differ, missing ones too."""
    j = a.select("col_index", F.col("locus_id").alias("of_a")).join(b.select("col_index", F.col("locus_id").alias("of_b")), "col_index", "full")
    return j.filter(~F.col("of_a").eqNullSafe(F.col("of_b")))


def bound_faults(edges: DataFrame, n_items: int, n_groups: int) -> DataFrame:
    """(check_name, n_bad) of a ragged batch: item and group indices inside their ranges, no null."""
    bad = {"item": ~F.coalesce(F.col("item").between(0, n_items - 1), F.lit(False)), "group": ~F.coalesce(F.col("grp").between(0, n_groups - 1), F.lit(False))}
    return edges.agg(*[F.count_if(c).alias(k) for k, c in bad.items()]).unpivot([], list(bad), "check_name", "n_bad")


def embedding_faults(loci: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(check_name, n_bad): mapped rows are 0..n-1 without gaps, unmapped ones have none, vectors have the width and finite values."""
    mapped = F.col("embedding_row").isNotNull()
    a = loci.agg(
        F.abs(F.coalesce(F.max("embedding_row") + 1, F.lit(0)) - F.count_if(mapped)).alias("gaps"),
        (F.count_if(mapped) - F.count_distinct("embedding_row")).alias("repeats"),
        F.count_if(mapped != (F.col("mapping_status") == "mapped")).alias("status"),
    )
    b = vectors.agg(F.count_if(F.size("vector") != width).alias("width"), F.count_if(F.exists("vector", lambda x: ~finite(x.cast("double")))).alias("not_finite"))
    return a.crossJoin(b).unpivot([], ["gaps", "repeats", "status", "width", "not_finite"], "check_name", "n_bad")  # a row each
