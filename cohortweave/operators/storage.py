"""Tables in the folder that all executors share: written once and read back."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a fresh local one only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: survives lost executors and cuts the plan. zstd takes less room and more time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def spread(df: DataFrame, waves: int = 4) -> DataFrame:
    """Few rows that will become many, dealt out evenly: `waves` tasks a core, whatever the layout of the files they come from."""
    return df.repartition(waves * df.sparkSession.sparkContext.defaultParallelism)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Give up shuffle files of finished jobs between the steps of a long one: Spark deletes them once the driver has collected what
    stood for them, and a driver with little to do collects rarely."""
    for _ in range(2):  # Python's garbage lets go of the driver's, with a delay
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
