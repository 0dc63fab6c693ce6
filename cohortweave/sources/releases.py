"""Releases: a folder of Parquet tables with a manifest that states their columns, rows and digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.digest import table_digest
from .tables import normalised_sheet, read_sheet, write_table

#: Columns that each table of a graph release must have.
GRAPH = {
    "loci": ("locus_id", "chromosome", "position", "canonical_key"),
    "genes": ("gene_id", "gene_name", "chromosome"),
    "regions": ("region_id", "gene_id", "region_type"),
    "probe_locus_edges": ("probe_id", "platform_id", "locus_id"),
    "locus_region_edges": ("locus_id", "region_id"),
}
INDEX = {"sample_index": ("row_index", "sample_id"), "locus_index": ("col_index", "locus_id")}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several places that exists, in any store that Spark reads; none is an error."""
    for path in paths:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def write_release(tables: dict[str, DataFrame], path: str, contract: dict[str, tuple[str, ...]]) -> dict:
    """Write the contract's tables, then a manifest of their rows and digests with sorted keys; returns it."""
    spark, manifest = next(iter(tables.values())).sparkSession, {}
    for name, columns in contract.items():
        write_table(tables[name], f"{path}/{name}.parquet", list(columns))
        d = table_digest(spark.read.parquet(f"{path}/{name}.parquet"), list(columns)).first()
        manifest[name] = {"columns": list(columns), "digest": d.digest, "rows": d.n}
    line = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def read_release(spark: SparkSession, path: str, contract: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """The contract's tables, with just its columns."""
    return {name: spark.read.parquet(f"{path}/{name}.parquet").select(*columns) for name, columns in contract.items()}


def release_faults(spark: SparkSession, path: str, contract: dict[str, tuple[str, ...]]) -> list[str]:
    """What keeps a release from matching its manifest: tables or columns that are not there, other rows, another digest."""
    manifest, faults = json.loads(spark.read.text(f"{path}/manifest.json").first().value), []
    for name, columns in contract.items():
        stated = manifest.get(name)
        if stated is None:
            faults.append(f"{name}: not in the manifest")
            continue
        fs, p = _fs(spark, f"{path}/{name}.parquet")
        if not fs.exists(p):
            faults.append(f"{name}: no table")
            continue
        df = spark.read.parquet(f"{path}/{name}.parquet")
        if missing := sorted(set(columns) - set(df.columns)):
            faults.append(f"{name}: missing columns {missing}")
            continue
        d = table_digest(df, list(columns)).first()
        if d.n != stated["rows"]:
            faults.append(f"{name}: {d.n} rows, {stated['rows']} stated")
        elif d.digest != stated["digest"]:
            faults.append(f"{name}: another digest than stated")
    return faults


def export_families(spark: SparkSession, families: dict[str, tuple[list[str], str]], path: str) -> list[str]:
    """Each family's sample sheet, from the first of its places that exists, to a normalised table; returns the tables' paths.

    families: name to (places, value column).
    """
    out = []
    for family, (places, value_col) in families.items():
        found = first_existing(spark, places)
        target = f"{path}/{family}.parquet"
        normalised_sheet(read_sheet(spark, found), family, value_col, found.rsplit("/", 1)[-1]).write.mode("overwrite").parquet(target)
        out.append(target)
    return out
