"""Readers of measurement text: one file a sample, wide tables plain or in a zip; tiles of a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_measure, strict_measure
from ..operators.checks import require
from .packs import header_of, locate, read_wide_zip


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Sample files without a byte, by the store's own listing: Spark's readers pass over them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(p) or [] for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return sorted(s.getPath().getName() for s in found if s.isFile() and s.getLen() == 0 and ".txt" in s.getPath().getName())


def read_two_column(spark: SparkSession, path: str) -> DataFrame:
    """Headerless probe-and-value text, one .txt file a sample: sample_id (file stem), probe_id, beta.

    NA tokens, NaN in any case and junk are null betas. No file and an empty file are errors; a null or repeated probe of a sample
    fails the job. A file with blank lines alone has no sample: see missing_samples.
    """
    if empty := _empty_files(spark, path):
        raise ValueError(f"empty sample files: {empty[:5]}")
    raw = spark.read.schema("probe_id string, raw string").option("pathGlobFilter", "*.txt*").csv(path, sep="\t")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt(\.gz)?$", "")
    cells = require(raw.select(stem.alias("sample_id"), F.nullif(F.col("probe_id"), F.lit("")).alias("probe_id"),
        parse_measure(F.col("raw")).alias("beta")), f"no sample rows under {path}")
    named = cells.withColumn("probe_id", F.coalesce("probe_id", F.raise_error(F.concat(F.lit("null probe in sample "), F.col("sample_id")))))
    n = named.groupBy("sample_id", "probe_id").agg(F.count(F.lit(1)).alias("n"), F.first("beta").alias("beta"))
    once = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("probe repeats in sample "), F.col("sample_id"))))
    return n.filter(once).drop("n")


def missing_samples(cells: DataFrame, names: list[str]) -> list[str]:
    """Of the named samples, in order, those without a row: absent or empty files."""
    asked = cells.sparkSession.createDataFrame([(x,) for x in names], "sample_id string")
    return [r.sample_id for r in asked.join(cells, "sample_id", "left_anti").orderBy("sample_id").collect()]


def read_wide(spark: SparkSession, path: str, sample_ids: list[str], probe_prefix: str = "cg") -> DataFrame:
    """Wide text with a sample_id header: only wanted samples and probe rows, long form (packs.CELLS); row_index is the order asked for.

    A token of a wanted cell that is neither a number nor an NA token fails the job.
    """
    wide = spark.read.csv(path, sep="\t", header=True, quote="")
    header_of("\t".join(wide.columns), sample_ids)
    cell = lambda i, s: F.struct(F.lit(i).alias("row_index"), F.lit(s).alias("sample_id"), strict_measure(F.col(f"`{s}`")).alias("beta"))
    cells = F.explode(F.array(*[cell(i, s) for i, s in enumerate(sample_ids)]))
    return wide.filter(F.col("sample_id").startswith(probe_prefix)).select(F.col("sample_id").alias("probe_id"), cells.alias("c")).select("probe_id", "c.*")


def read_pack(spark: SparkSession, places: list[tuple[str, str | None]], sample_ids: list[str], probe_prefix: str = "cg") -> DataFrame:
    """The wide table of the first of places that is there (packs.locate): a text file, one in a folder, or a zip's text member."""
    kind, path = locate(places)
    if kind == "zip":
        return read_wide_zip(spark, path, None, sample_ids, probe_prefix)
    return read_wide(spark, path, sample_ids, probe_prefix)


def tiles_of(cells: DataFrame, width: int = 4096) -> DataFrame:
    """Long cells (row_index, col_index, beta) as one array per row and block of columns, missing as null.

    A tile is its sorted cells with runs of nulls between them, in time linear in its width; of repeated cells the greatest counts.
    """
    block = F.floor(F.col("col_index") / width)
    k = (F.col("col_index") % width).cast("int")
    one = cells.groupBy("row_index", block.alias("block"), k.alias("k")).agg(F.max(F.col("beta").cast("float")).alias("v"))
    sorted_cells = F.array_sort(F.collect_list(F.struct("k", "v")))
    t = one.groupBy("row_index", "block").agg(sorted_cells.alias("c"))
    gap = lambda n: F.array_repeat(F.lit(None).cast("float"), n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("c"), i - 1)["k"])
    parts = F.transform("c", lambda x, i: F.concat(gap(x["k"] - before(i) - 1), F.array(x["v"])))
    tail = gap(width - 1 - F.element_at("c", -1)["k"])
    return t.select("row_index", "block", F.concat(F.flatten(parts), tail).alias("tile"))


def write_tiles(cells: DataFrame, path: str, width: int = 4096) -> None:
    """Tiles to Parquet by block; a block's rows meet first, spread by row, so the files per block stay few."""
    tiles_of(cells, width).repartition("block", F.pmod("row_index", F.lit(8))).write.mode("overwrite").partitionBy("block").parquet(path)


def read_tiles(spark: SparkSession, path: str, width: int = 4096) -> DataFrame:
    t = spark.read.parquet(path).select("row_index", "block", F.posexplode("tile").alias("k", "beta"))
    return t.filter("beta is not null").select("row_index", (F.col("block") * width + F.col("k")).alias("col_index"), "beta")
