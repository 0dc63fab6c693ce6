"""The report of a graph build: its counts, and its rules with the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks
from .loci import mapped, present

PROBES = ("probe_id", "platform_id", "mapping_status")


def _one(df: DataFrame, section: str, **values: Column) -> DataFrame:
    row = df.agg(*[F.coalesce(v, F.lit(0)).cast("double").alias(k) for k, v in values.items()])
    return row.unpivot([], list(values), "name", "value").select(F.lit(section).alias("section"), "name", "value")


def _each(df: DataFrame, section: str, col: str, value: Column | None = None) -> DataFrame:
    n = df.groupBy(F.col(col).cast("string").alias("name")).agg((F.count(F.lit(1)) if value is None else value).cast("double").alias("value"))
    return n.filter("name IS NOT NULL").select(F.lit(section).alias("section"), "name", "value")


def graph_report(loci: DataFrame, probes: DataFrame, edges: DataFrame, genes: DataFrame, regions: DataFrame, locus_region: DataFrame) -> DataFrame:
    """(section, name, value): totals, regions and locus-region edges by type, probes and mapped probes by platform, loci by context.

    A count of an empty table is 0. Loci without a region, and with regions of several genes, count from the locus-region edges.
    """
    n = F.count(F.lit(1))
    typed = locus_region.join(regions.select("region_id", "gene_id", "region_type"), "region_id", "left")
    per_locus = edges.groupBy("locus_id").agg(n.alias("n"))
    of_genes = typed.groupBy("locus_id").agg(F.count_distinct("gene_id").alias("n_genes"))
    parts = [
        _one(loci, "total", n_loci=n), _one(genes, "total", n_genes=n), _one(regions, "total", n_regions=n), _one(locus_region, "total", n_locus_region_edges=n),
        _one(probes, "total", n_probes=n, n_unmapped_probes=F.count_if(F.col("mapping_status") != "mapped")), _one(edges, "total", n_probe_locus_edges=n),
        _one(loci.join(locus_region.select("locus_id").distinct(), "locus_id", "left_anti"), "total", n_unassigned_loci=n),
        _one(of_genes, "total", n_loci_multi_gene=F.count_if(F.col("n_genes") > 1)),
        _one(per_locus, "total", probes_collapsed_max=F.max("n"), probes_collapsed_mean=F.avg("n")),
        _each(regions, "regions_by_type", "region_type"), _each(typed, "edges_by_type", "region_type"),
        _each(probes, "platform_probes", "platform_id"), _each(mapped(present(probes, list(PROBES))), "platform_mapped", "platform_id"),
    ]
    if "cpg_context" in loci.columns:
        parts.append(_each(loci, "context", "cpg_context"))
    return reduce(DataFrame.unionByName, parts)


def graph_rules(loci: DataFrame, probes: DataFrame, edges: DataFrame, genes: DataFrame, regions: DataFrame, locus_region: DataFrame) -> DataFrame:
    """(check_name, n_bad, passed): keys are there once, both ends of every edge are there, regions have their gene and begin before
    they end, mapped probes have a locus and others none."""
    with_locus = edges.select("probe_id", "platform_id").distinct().withColumn("has", F.lit(True))
    status = probes.join(with_locus, ["probe_id", "platform_id"], "left").agg(
        F.count_if((F.col("mapping_status") == "mapped") != F.coalesce("has", F.lit(False))).alias("n_bad")).select(F.lit("probe_status").alias("check_name"), "n_bad")
    order = regions.agg(F.count_if(F.col("start") > F.col("end")).alias("n_bad")).select(F.lit("region_order").alias("check_name"), "n_bad")
    found = checks.report([
        checks.unique(loci, "locus_key", ["locus_id"]), checks.unique(genes, "gene_key", ["gene_id"]), checks.unique(regions, "region_key", ["region_id"]),
        checks.unique(edges, "edge_key", ["probe_id", "platform_id", "locus_id"]), checks.references(edges, "edge_locus", "locus_id", loci, "locus_id"),
        checks.references(locus_region, "link_locus", "locus_id", loci, "locus_id"), checks.references(locus_region, "link_region", "region_id", regions, "region_id"),
        checks.references(regions, "region_gene", "gene_id", genes, "gene_id"), order, status,
    ])
    return found.withColumn("passed", F.col("n_bad") == 0)
