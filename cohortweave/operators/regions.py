"""Gene regions by role from annotation rows: promoter windows, first exons, untranslated regions, bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contig_name, strip_version
from .intervals import first_by, merge_intervals
from .storage import written

#: Roles in order of precedence.
ROLES = ("promoter_core", "promoter_proximal", "five_prime", "three_prime", "gene_body")


def role_rank(role: Column) -> Column:
    """Position of a role in the order of precedence, the last for any other."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    return F.coalesce(F.try_element_at(ranks, role), F.lit(len(ROLES)))


def transcription_start(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", start).otherwise(end)


def genes_of(rows: DataFrame, types: tuple[str, ...] = ("protein_coding",), version: str = "") -> DataFrame:
    """One row per gene of the wanted types, the last of a repeated id; ids lose their version, a missing name is the id."""
    gene = rows.filter((F.col("feature") == "gene") & F.coalesce("gene_type", F.lit("")).isin(*types))
    gid = strip_version(F.col("gene_id"))
    g = gene.select(
        gid.alias("gene_id"), F.coalesce("gene_name", gid).alias("gene_name"), contig_name(F.col("chrom")).alias("chromosome"),
        "start", "end", "strand", "gene_type", F.lit(version).alias("source_version"),
    ).filter("chromosome IS NOT NULL AND gene_id IS NOT NULL")
    return first_by(g, ["gene_id"], [F.desc("start"), F.desc("end")])


def role_intervals(rows: DataFrame, genes: DataFrame, types: tuple[str, ...], core: int, proximal: int) -> DataFrame:
    """(gene_id, chromosome, strand, role, start, end) before merging, with the gene's contig and strand. Rows of genes that are not
    kept fall out; empty windows too.

    An untranslated region without a side takes it from its midpoint against the coding bounds of its transcript. All other rows
    are read once: each is an array of what it stands for.
    """
    r = rows.withColumn("gene_id", strip_version(F.col("gene_id")))
    start, end, feature = F.col("start").cast("long"), F.col("end").cast("long"), F.col("feature")
    span = lambda role, lo=start, hi=end: F.struct(F.lit(role).alias("role"), lo.alias("start"), hi.alias("end"))
    tss = transcription_start(start, end, F.col("strand"))
    floor = lambda x: F.greatest(F.lit(1).cast("long"), x)
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    near = span(ROLES[0], floor(tss - core), tss + core)
    far = span(ROLES[1], F.when(plus, floor(tss - proximal)).when(minus, tss + core), F.when(plus, tss - core).when(minus, tss + proximal))
    of_row = (
        F.when((feature == "transcript") & F.coalesce("gene_type", F.lit("")).isin(*types), F.array(near, far))
        .when((feature == "exon") & (F.col("exon_number") == "1"), F.array(span(ROLES[2])))
        .when(feature == "five_prime_utr", F.array(span(ROLES[2]))).when(feature == "three_prime_utr", F.array(span(ROLES[3])))
    )
    plain = r.filter(feature.isin("transcript", "exon", "five_prime_utr", "three_prime_utr")).select("gene_id", F.inline(of_row))
    coding = r.filter((feature == "CDS") & F.col("transcript_id").isNotNull()).join(genes.select("gene_id"), "gene_id", "left_semi")
    coding = coding.groupBy("transcript_id").agg(F.min("start").alias("cds_lo"), F.max("end").alias("cds_hi"))
    mid = F.floor((start + end) / 2)
    before, after = mid < F.col("cds_lo"), mid > F.col("cds_hi")
    side = F.when((plus & before) | (minus & after), ROLES[2]).when((plus & after) | (minus & before), ROLES[3])
    utr = r.filter(feature == "UTR").join(coding, "transcript_id").select("gene_id", side.alias("role"), start.alias("start"), end.alias("end")).filter("role IS NOT NULL")
    body = genes.select("gene_id", F.lit(ROLES[4]).alias("role"), start.alias("start"), end.alias("end"))
    spans = reduce(DataFrame.unionByName, [plain, utr, body]).filter(F.col("start") <= F.col("end"))
    return spans.join(genes.select("gene_id", "chromosome", "strand"), "gene_id")


def build_regions(rows: DataFrame, types: tuple[str, ...] = ("protein_coding",), core: int = 200, proximal: int = 1500, version: str = "") -> tuple[DataFrame, DataFrame]:
    """(genes, regions): per gene and role the merged intervals, numbered from the second on (`_2`, ...) in region_id.

    rows: chrom, feature, start, end (1-based, inclusive), strand, gene_id, gene_type, gene_name, transcript_id, exon_number.
    Windows run per gene and role, so no contig sits in one task. Where only genes are wanted, genes_of alone reads less.
    """
    rows = written(rows)  # parsed text is read several times below
    genes = written(genes_of(rows, types, version))
    spans = written(role_intervals(rows, genes, types, core, proximal))  # read by the count of large keys, then merged
    key = ["gene_id", "role", "chromosome", "strand"]
    n = F.row_number().over(Window.partitionBy(*key).orderBy("start"))
    suffix = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))
    named = merge_intervals(spans, key).withColumn("n", n).withColumn("region_id", F.concat(F.col("gene_id"), F.lit(":"), F.col("role"), suffix))
    return genes, named.select("region_id", "gene_id", F.col("role").alias("region_type"), "chromosome", "start", "end", "strand")
