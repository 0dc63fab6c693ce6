"""Regions from annotation lines: how lines are dealt out, attributes, and merging by several keys."""

from cohortweave.operators import intervals, regions
from cohortweave.plans import annotation as plans
from cohortweave.plans.queries import QUERIES
from cohortweave.sources import annotation

SF = "/root/testdata/sf0.001"


def test_lines_of_one_file_are_many_tasks(spark):
    lines = plans._gtf_lines(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_genes_alone_build_no_regions(spark, monkeypatch):
    def stop(*_):
        raise AssertionError("regions are not asked for")

    monkeypatch.setattr(regions, "build_regions", stop)
    assert QUERIES["gene_table"](spark, SF).count() == QUERIES["gene_order"](spark, SF).count() > 0


def test_merge_by_several_keys(spark):
    rows = [("a", x, s, s + 4) for x in (1, 2) for s in (0, 5, 20)] + [("b", 1, 3, 9)]
    df = spark.createDataFrame(rows, "k string, x int, start long, end long")
    want = [("a", 1, 0, 9), ("a", 1, 20, 24), ("a", 2, 0, 9), ("a", 2, 20, 24), ("b", 1, 3, 9)]
    for most in (1_000_000, 2):
        assert sorted(map(tuple, intervals.merge_intervals(df, ["k", "x"], most=most).collect())) == want


def test_regions_by_hand(spark):
    """Sides of untranslated regions, a repeated gene id, exons but the first, and rows of genes that are not kept."""
    line = lambda kind, s, e, attrs, strand="+": f"chr1\ts\t{kind}\t{s}\t{e}\t.\t{strand}\t.\t{attrs}"
    g, t, u = 'gene_id "G.1"; gene_type "protein_coding";', ' transcript_id "T";', 'gene_id "H"; gene_type "lncRNA"; transcript_id "U";'
    lines = [line("gene", 1000, 5000, g), line("gene", 900, 4000, g), line("transcript", 1000, 5000, g + t), line("exon", 1000, 1100, g + t + " exon_number 1;"),
        line("exon", 3000, 3100, g + t + " exon_number 2;"), line("CDS", 1200, 4000, g + t), line("UTR", 1102, 1150, g + t), line("UTR", 1000, 1101, g + t),
        line("UTR", 4500, 5000, g + t), line("gene", 1, 90, u), line("exon", 1, 9, u + " exon_number 1;")]
    rows = annotation.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string"))
    genes, areas = regions.build_regions(rows)
    assert [(r.gene_id, r.start, r.end) for r in genes.collect()] == [("G", 1000, 5000)]
    assert sorted((r.region_id, r.chromosome, r.start, r.end, r.strand) for r in areas.collect()) == [
        ("G:five_prime", "chr1", 1000, 1150, "+"), ("G:gene_body", "chr1", 1000, 5000, "+"), ("G:promoter_core", "chr1", 800, 1200, "+"),
        ("G:promoter_proximal", "chr1", 1, 800, "+"), ("G:three_prime", "chr1", 4500, 5000, "+")]


def test_attributes(spark):
    """The last of repeated keys, bare and quoted values, an empty value, and keys inside other keys' names."""
    attrs = ['gene_id "A"; gene_id "B"; xgene_id "C"', 'gene_id A ; gene_biotype  "k l" ;gene_name ""', 'note "a; gene_id b"; exon_number 1;', "gene_id; gene_name N;transcript_id T", 'gene_id "A"; gene_id ""; gene_type X']
    df = spark.createDataFrame([(f"c\ts\tgene\t1\t2\t.\t+\t.\t{a}",) for a in attrs], "value string").coalesce(1)
    got = [(r.gene_id, r.gene_type, r.gene_name, r.transcript_id, r.exon_number) for r in annotation.parse_gtf(df).collect()]
    assert got == [("B", None, None, None, None), ("A", "k l", None, None, None), ("b", None, None, None, "1"), (None, None, "N", "T", None), (None, "X", None, None, None)]


def test_graph_tables_are_worked_out_once(spark):
    loci, probes, edges, _, areas, links = plans._graph(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    assert all(hasattr(x, "written_at") for x in (loci, probes, edges, areas, links))
