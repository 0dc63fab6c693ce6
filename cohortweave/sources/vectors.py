"""A store of vectors by locus: bucketed and sorted Parquet with its index, so lookups move the columns that ask, never the vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import require_columns
from ..operators.ordered import numbered
from .tables import write_index

#: Columns of the store and of its index.
VECTORS = ("locus_id", "vector")
INDEX = ("embedding_row", "locus_id")


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/store.json"


def write_vectors(vectors: DataFrame, path: str, table: str, width: int, buckets: int = 200) -> None:
    """Store (locus_id, vector) as float32 in `buckets` buckets by locus, and the index (embedding_row by locus order) beside it.

    A null or repeated locus, a vector of another width, and a value that is not finite are errors, found before anything is written.
    `table` names the store in the session's catalogue; open_vectors names it in another session.
    """
    spark = vectors.sparkSession
    v = require_columns(vectors, list(VECTORS)).select(F.col("locus_id").cast("long").alias("locus_id"), F.col("vector").cast("array<float>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    s = v.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("locus_id").alias("loci"), F.count_if(~F.coalesce((F.size("vector") == width) & ~odd, F.lit(False))).alias("bad")).first()
    if s.loci != s.n:
        raise ValueError(f"{s.n - s.loci} rows repeat a locus or have none")
    if s.bad:
        raise ValueError(f"{s.bad} vectors are not {width} finite numbers")
    dealt = v.repartition(buckets, "locus_id")  # a task a bucket, so a file a bucket
    dealt.write.mode("overwrite").bucketBy(buckets, "locus_id").sortBy("locus_id").option("path", f"{path.rstrip('/')}/vectors").saveAsTable(table)
    write_index(numbered(v.select("locus_id"), [F.col("locus_id")], INDEX[0]), f"{path.rstrip('/')}/index", list(INDEX), INDEX[0], s.n)
    line = json.dumps({"buckets": buckets, "rows": s.n, "width": width}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(_manifest(path))


def open_vectors(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The store under path, by its buckets."""
    stated = json.loads(spark.read.text(_manifest(path)).first().value)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} (locus_id BIGINT, vector ARRAY<FLOAT>) USING parquet CLUSTERED BY (locus_id) SORTED BY (locus_id) INTO {stated['buckets']} BUCKETS LOCATION '{path.rstrip('/')}/vectors'")
    return spark.table(table)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/index").select(*INDEX)


def vectors_of(columns: DataFrame, store: DataFrame) -> DataFrame:
    """columns (with locus_id) with their vector and whether there is one; the store joins in its buckets, only columns move.

    The hint keeps the join by merge or hash of shuffled columns, for a store is large; a broadcast of few columns moves no vector either.
    """
    return columns.join(store.hint("merge"), "locus_id", "left").withColumn("valid", F.col("vector").isNotNull())
