"""Locus registry, probe edges and the map from observed probes to loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key
from .checks import require, require_columns
from .intervals import first_by
from .ordered import numbered

FULL_QUALITY = 60.0  # mapping quality of full confidence


def mapped(probes: DataFrame) -> DataFrame:
    return probes.filter(F.col("mapping_status") == "mapped")


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the order asked."""
    return df.select(*[c for c in wanted if c in df.columns])


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose right side must hold each key once; a repeated key fails the job instead of multiplying rows."""
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    checked = once.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("right key repeats in a many-to-one join")))).drop("_n")
    return left.join(checked, keys, how)


def build_registry(probes: DataFrame, build: str = "GRCh38", source: str = "annotation") -> tuple[DataFrame, DataFrame]:
    """(loci, edges): loci are the distinct mapped positions, numbered from 1 by contig name and position; an edge per mapped probe.

    Ids come from range partitions and their offsets, so no task sees all loci. Confidence is mapQ over the full quality.
    """
    require_columns(probes, ["probe_id", "platform_id", "chromosome", "position", "mapping_status"])
    at = mapped(probes).select("chromosome", "position").distinct()
    loci = numbered(at, [F.col("chromosome"), F.col("position")], "locus_id", start=1)
    loci = loci.select("locus_id", F.lit(build).alias("genome_build"), "chromosome", "position",
        canonical_key(build, F.col("chromosome"), F.col("position")).alias("canonical_key"), F.lit("mapped").alias("mapping_status"))
    edges = many_to_one(mapped(probes), loci.select("locus_id", "chromosome", "position"), ["chromosome", "position"], "left")
    confidence = F.col("mapQ").cast("double") / FULL_QUALITY if "mapQ" in probes.columns else F.lit(None).cast("double")
    return loci, edges.select("probe_id", "platform_id", "locus_id", F.lit(source).alias("mapping_source"), confidence.alias("mapping_confidence"), F.lit(True).alias("is_primary"))


def primary_edges(edges: DataFrame, loci: DataFrame, platform: str) -> DataFrame:
    """A platform's primary edges with their loci's keys; none is an error."""
    own = require(edges.filter((F.col("platform_id") == platform) & F.col("is_primary")), f"no primary edges for platform {platform}")
    return many_to_one(own, loci.select("locus_id", "canonical_key"), ["locus_id"])


def map_probes(observed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, unmapped, counts): one column per locus, its first observed probe by name; observed: probe_id.

    Unmapped probes are listed, not an error, unless nothing maps.
    """
    seen = observed.select("probe_id").distinct()
    hit = edges.join(seen, "probe_id", "left_semi")
    columns = require(first_by(hit, ["locus_id"], [F.col("probe_id")]), "no observed probe maps to a locus")
    unmapped = seen.join(edges.select("probe_id"), "probe_id", "left_anti")
    found = hit.agg(F.count_distinct("probe_id").alias("n_mapped"), F.count(F.lit(1)).alias("n_edges"), F.count_distinct("locus_id").alias("n_loci"))
    counts = seen.agg(F.count(F.lit(1)).alias("n_observed")).crossJoin(found)  # a row each
    return columns, unmapped, counts.select("n_observed", "n_mapped", (F.col("n_edges") - F.col("n_loci")).alias("n_collapsed"), "n_loci")
