"""Annotation text: gene rows, island tables, ordering and coordinate lists; and the region bed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contig_name

ATTRIBUTES = ("gene_id", "gene_type", "gene_name", "transcript_id", "exon_number")


def attributes(attrs: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    """(names, values) of the wanted keys in the order of the text, quoted or bare. Two passes over the text find all keys."""
    found = rf'(?:^|;)\s*({"|".join(keys)})\s+"?([^";\s]*[^";]*)"?'
    return tuple(F.regexp_extract_all(attrs, F.lit(found), F.lit(i)) for i in (1, 2))


def last_value(names: Column, values: Column, key: str) -> Column:
    """The last value of a key; null where there is none or it is empty."""
    back = F.nullif(F.array_position(F.reverse(names), key).cast("int"), F.lit(0))
    return F.nullif(F.rtrim(F.element_at(values, -back)), F.lit(""))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Lines (column value) to chrom, feature, start, end, strand and ATTRIBUTES; remarks and lines of under nine fields fall out."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= 9))
    names, values = attributes(f[8], (*ATTRIBUTES, "gene_biotype"))
    fields = rows.select(f[0].alias("chrom"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"),
        names.alias("_names"), values.alias("_values"))
    attribute = lambda key: last_value(F.col("_names"), F.col("_values"), key)
    kind = F.coalesce(attribute("gene_type"), attribute("gene_biotype"))
    cols = [kind.alias(k) if k == "gene_type" else attribute(k).alias(k) for k in ATTRIBUTES]
    return fields.select("chrom", "feature", "start", "end", "strand", *cols)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Plain or compressed; one compressed file is one task, so unpack large ones."""
    return parse_gtf(spark.read.text(path))


def parse_islands(lines: DataFrame) -> DataFrame:
    """Island lines to chrom, start (1-based), end; a leading numeric column, as table dumps have, is passed over line by line."""
    f = F.split("value", "\t")
    shift = F.when(f[0].rlike("^[0-9]+$") & (F.size(f) >= 4), 1).otherwise(0)
    at = lambda i: F.get(f, shift + i)
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= 3))
    return rows.select(contig_name(at(0)).alias("chrom"), (at(1).cast("long") + 1).alias("start"), at(2).cast("long").alias("end")).filter("chrom IS NOT NULL")


def zip_by_place(ordering: DataFrame, coords: DataFrame, place: str = "place") -> DataFrame:
    """Two lists with a place column side by side; a place that only one has fails the job. 0-based CpG_beg becomes a 1-based position."""
    j = ordering.join(coords, place, "full")
    whole = F.col("probe_id").isNotNull() & F.col("has_coord").isNotNull()
    checked = j.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("ordering and coordinates differ in length"))))
    mapped = F.col("CpG_beg").isNotNull() & F.col("chromosome").isNotNull()
    return checked.select("probe_id", F.when(mapped, F.col("chromosome")).alias("chromosome"),
        F.when(mapped, F.col("CpG_beg") + 1).alias("position"), F.when(mapped, "mapped").otherwise("unmapped").alias("mapping_status"))


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their place. Ids rise along a file's splits, and rank over them gives the line number."""
    from ..operators.ordered import numbered

    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    return numbered(lines, [F.col("_at")], "place").drop("_at")


def read_platform(spark: SparkSession, ordering: str, coords: str) -> DataFrame:
    """Probe ids of an ordering file and contig and start of a coordinate file, with headers, joined by line."""
    f = F.split("value", "\t")
    body = lambda p: read_placed(spark, p).filter("place > 0")
    o = body(ordering).select("place", f[0].alias("probe_id"))
    c = body(coords).select("place", F.lit(True).alias("has_coord"), contig_name(f[0]).alias("chromosome"), F.get(f, F.lit(1)).try_cast("long").alias("CpG_beg"))
    return zip_by_place(o, c)


def bed_rows(regions: DataFrame) -> DataFrame:
    """The eight bed columns: 0-based start, score 0."""
    return regions.select("chromosome", (F.col("start") - 1).alias("start_0"), "end", "region_id", F.lit(0).alias("score"), "strand", "gene_id", "region_type")


def write_bed(regions: DataFrame, path: str) -> None:
    bed_rows(regions).orderBy("chromosome", "start_0", "end", "region_id").write.mode("overwrite").csv(path, sep="\t", header=False)
