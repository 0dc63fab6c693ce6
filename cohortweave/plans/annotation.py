"""Registered queries of the annotation build: regions, registry, probe map, role edges, reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, loci, matrix, regions, report
from ..operators.ordered import numbered
from ..operators.storage import spread, written
from ..sources import annotation
from .queries import query

_GENE = "part"


def _gtf_lines(t):
    """Annotation lines from parts: a gene, its transcript, two exons, a coding span and two untranslated ones per part.

    Parts are dealt out before they become text: a file's row group is one task, and its lines are far more than its bytes tell.
    """
    p = spread(t("part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("k"), (F.col("p_partkey") * 700).alias("s"), (F.col("p_partkey") * 700 + F.col("p_size") * 40 + 400).alias("e"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("st"), F.when(F.col("p_size") % 5 == 0, "lncRNA").otherwise("protein_coding").alias("ty"),
        F.when(F.col("p_partkey") % 11 == 0, "MT").otherwise((F.col("p_partkey") % 7 + 1).cast("string")).alias("c"),
    )
    k = F.col("k").cast("string")
    gene = F.concat(F.lit('gene_id "G'), k, F.lit('.1"; gene_type "'), F.col("ty"), F.lit('"; gene_name "N'), k, F.lit('";'))
    of_t = F.concat(gene, F.lit(' transcript_id "T'), k, F.lit('";'))
    s, e = F.col("s"), F.col("e")
    rows = [("gene", s, e, gene), ("transcript", s, e, of_t), ("exon", s, s + 150, F.concat(of_t, F.lit(" exon_number 1;"))), ("exon", e - 120, e, F.concat(of_t, F.lit(" exon_number 2;")))]
    rows += [("CDS", s + 100, e - 100, of_t), ("UTR", s, s + 60, of_t), ("UTR", e - 60, e, of_t)]
    line = [F.concat_ws("\t", "c", F.lit("src"), F.lit(f), a.cast("string"), b.cast("string"), F.lit("."), "st", F.lit("."), x) for f, a, b, x in rows]
    return p.select(F.explode(F.array(*line, F.lit("# a remark"))).alias("value"))


_REGION_SQL = """p AS (SELECT p_partkey AS k, p_partkey * 700 AS s, p_partkey * 700 + p_size * 40 + 400 AS e, p_partkey % 2 = 0 AS plus, CASE WHEN p_partkey % 11 = 0 THEN 'chrM' ELSE 'chr' || (p_partkey % 7 + 1) END AS chromosome FROM part WHERE p_size % 5 <> 0),
x AS (SELECT *, CASE WHEN plus THEN s ELSE e END AS tss FROM p),
i AS (SELECT k, 'promoter_core' AS r, greatest(1, tss - 200) AS a, tss + 200 AS b FROM x
UNION ALL SELECT k, 'promoter_proximal', CASE WHEN plus THEN greatest(1, tss - 1500) ELSE tss + 200 END, CASE WHEN plus THEN tss - 200 ELSE tss + 1500 END FROM x
UNION ALL SELECT k, 'gene_body', s, e FROM x UNION ALL SELECT k, 'five_prime', s, s + 150 FROM x
UNION ALL SELECT k, CASE WHEN plus THEN 'five_prime' ELSE 'three_prime' END, s, s + 60 FROM x UNION ALL SELECT k, CASE WHEN plus THEN 'three_prime' ELSE 'five_prime' END, e - 60, e FROM x),
f AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a > max(b) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM i WHERE a <= b WINDOW w AS (PARTITION BY k, r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k, r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM f),
m AS (SELECT k, r, min(a) AS a, max(b) AS b FROM g GROUP BY k, r, run),
n AS (SELECT *, row_number() OVER (PARTITION BY k, r ORDER BY a) AS n FROM m),
regions AS (SELECT 'G' || k || ':' || r || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS region_id, 'G' || k AS gene_id, r AS region_type, chromosome, a AS "start", b AS "end", CASE WHEN plus THEN '+' ELSE '-' END AS strand FROM n JOIN p USING (k))"""


def _regions(t):
    return regions.build_regions(annotation.parse_gtf(_gtf_lines(t)))


def _genes(t):
    """The genes alone, which need no other line."""
    return regions.genes_of(annotation.parse_gtf(_gtf_lines(t)))


@query(f"WITH {_REGION_SQL} SELECT * FROM regions")
def gene_regions(t):
    return _regions(t)[1]


@query("""SELECT 'G' || p_partkey AS gene_id, 'N' || p_partkey AS gene_name, CASE WHEN p_partkey % 11 = 0 THEN 'chrM' ELSE 'chr' || (p_partkey % 7 + 1) END AS chromosome,
p_partkey * 700 AS "start", p_partkey * 700 + p_size * 40 + 400 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_size % 5 <> 0""")
def gene_table(t):
    return _genes(t).select("gene_id", "gene_name", "chromosome", "start", "end", "strand")


@query(f"""WITH {_REGION_SQL}, pts AS (SELECT DISTINCT 'chr' || (l_partkey % 7 + 1) AS chromosome, l_partkey * 350 + l_suppkey AS pos FROM lineitem),
h AS (SELECT pts.chromosome, pos, gene_id, region_id, row_number() OVER (PARTITION BY pts.chromosome, pos, gene_id ORDER BY list_position(['promoter_core', 'promoter_proximal', 'five_prime', 'three_prime', 'gene_body'], region_type), region_id) AS rn
FROM pts JOIN regions USING (chromosome) WHERE pos BETWEEN "start" AND "end") SELECT chromosome, pos, gene_id, region_id FROM h WHERE rn = 1""")
def role_edges(t):
    """Loci to regions: one role per locus and gene, by precedence."""
    pts = t("lineitem").select(F.concat(F.lit("chr"), (F.col("l_partkey") % 7 + 1).cast("string")).alias("chrom"), (F.col("l_partkey") * 350 + F.col("l_suppkey")).alias("pos")).distinct()
    hits = intervals.points_in_intervals(pts, written(_regions(t)[1]).withColumnRenamed("chromosome", "chrom"))
    best = intervals.first_by(hits, ["chrom", "pos", "gene_id"], [regions.role_rank(F.col("region_type")), F.col("region_id")])
    return best.select(F.col("chrom").alias("chromosome"), "pos", "gene_id", "region_id")


@query(f"""WITH {_REGION_SQL} SELECT chromosome, "start" - 1 AS start_0, "end", region_id, 0 AS score, strand, gene_id, region_type FROM regions""")
def regions_bed(t):
    return annotation.bed_rows(_regions(t)[1])


def _probes(t):
    """Probes of two platforms: lineitem parts and suppliers; every ninth is unmapped."""
    k = F.col("l_partkey")
    return t("lineitem").select(
        F.concat(F.lit("cg"), k.cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("probe_id"), F.when(k % 2 == 0, "HM450").otherwise("EPIC").alias("platform_id"),
        F.concat(F.lit("chr"), (k % 23 + 1).cast("string")).alias("chromosome"), (k / 3).cast("long").alias("position"), F.when(k % 9 == 0, "unmapped").otherwise("mapped").alias("mapping_status"), (k % 61).alias("mapQ"),
    ).distinct()


_PROBES = """probes AS (SELECT DISTINCT 'cg' || l_partkey || '_' || l_linenumber AS probe_id, CASE WHEN l_partkey % 2 = 0 THEN 'HM450' ELSE 'EPIC' END AS platform_id,
'chr' || (l_partkey % 23 + 1) AS chromosome, l_partkey // 3 AS position, CASE WHEN l_partkey % 9 = 0 THEN 'unmapped' ELSE 'mapped' END AS mapping_status, l_partkey % 61 AS mapq FROM lineitem),
loci AS (SELECT row_number() OVER (ORDER BY chromosome, position) AS locus_id, * FROM (SELECT DISTINCT chromosome, position FROM probes WHERE mapping_status = 'mapped')),
edges AS (SELECT probe_id, platform_id, locus_id, mapq / 60.0::DOUBLE AS mapping_confidence FROM probes JOIN loci USING (chromosome, position) WHERE mapping_status = 'mapped')"""


@query(f"WITH {_PROBES} SELECT locus_id, chromosome, position, 'GRCh38:' || chromosome || ':' || position AS canonical_key FROM loci")
def locus_registry(t):
    return loci.build_registry(_probes(t))[0].select("locus_id", "chromosome", "position", "canonical_key")


@query(f"WITH {_PROBES} SELECT probe_id, platform_id, locus_id, round(mapping_confidence, 6) AS mapping_confidence FROM edges")
def probe_edges(t):
    return loci.build_registry(_probes(t))[1].select("probe_id", "platform_id", "locus_id", F.round("mapping_confidence", 6).alias("mapping_confidence"))


_OBSERVED = "o AS (SELECT DISTINCT 'cg' || l_partkey || '_' || l_linenumber AS probe_id FROM lineitem WHERE l_suppkey % 3 = 0)"


def _map(t):
    seen = t("lineitem").filter("l_suppkey % 3 = 0").select(F.concat(F.lit("cg"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("probe_id"))
    table, edges = loci.build_registry(_probes(t))
    return loci.map_probes(seen, loci.primary_edges(edges, table, "HM450"))


@query(f"""WITH {_PROBES}, {_OBSERVED} SELECT locus_id, min(probe_id) AS probe_id FROM edges JOIN o USING (probe_id) WHERE platform_id = 'HM450' GROUP BY 1""")
def probe_map(t):
    return _map(t)[0].select("locus_id", "probe_id")


@query(f"""WITH {_PROBES}, {_OBSERVED} SELECT probe_id FROM o WHERE probe_id NOT IN (SELECT probe_id FROM edges WHERE platform_id = 'HM450')""")
def unmapped_probes(t):
    return _map(t)[1]


@query(f"""WITH {_PROBES}, {_OBSERVED}, h AS (SELECT * FROM edges JOIN o USING (probe_id) WHERE platform_id = 'HM450')
SELECT (SELECT count(*) FROM o) AS n_observed, count(DISTINCT probe_id) AS n_mapped, count(*) - count(DISTINCT locus_id) AS n_collapsed, count(DISTINCT locus_id) AS n_loci FROM h""")
def probe_map_counts(t):
    return _map(t)[2]


@query(f"""WITH {_PROBES}, n AS (SELECT locus_id, count(*) AS n FROM edges GROUP BY 1) SELECT count(*) AS n_loci, max(n) AS probes_max, round(avg(n), 6) AS probes_mean, count(*) FILTER (WHERE n > 1) AS n_shared FROM n""")
def probes_per_locus(t):
    n = loci.build_registry(_probes(t))[1].groupBy("locus_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_loci"), F.max("n").alias("probes_max"), F.round(F.avg("n"), 6).alias("probes_mean"), F.count_if(F.col("n") > 1).alias("n_shared"))


@query(f"""WITH {_REGION_SQL} SELECT region_type, count(*) AS n_regions, count(DISTINCT gene_id) AS n_genes, sum("end" - "start" + 1)::BIGINT AS bases FROM regions GROUP BY 1""")
def region_report(t):
    return _regions(t)[1].groupBy("region_type").agg(F.count(F.lit(1)).alias("n_regions"), F.count_distinct("gene_id").alias("n_genes"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@query("""SELECT p_partkey, regexp_replace(trim(p_name), '_[A-Z]{2}[0-9]{2}$', '') AS stem, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'chrM' WHEN 2 THEN 'chr7' ELSE 'chr' || p_size END AS contig,
CASE WHEN p_size % 3 = 0 OR p_size <= 5 THEN NULL ELSE 'MT:' || (p_size - 6) END AS place, p_type AS platform, CASE WHEN p_size % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex,
CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS label, CASE WHEN p_size % 2 = 0 THEN 'control' ELSE p_brand END AS shown, len(string_split(p_name, ' ')) AS n_ids, p_size % 2 = 0 AS series, p_size % 2 = 0 AS hashed FROM part""")
def label_rules(t):
    """Every label rule on crafted variants of part columns."""
    k = F.col("p_size")
    contig = F.when(k % 4 == 0, " na ").when(k % 4 == 1, "\tMT").when(k % 4 == 2, "chr7 ").otherwise(k.cast("string"))
    patched = F.when(k % 3 == 0, "chr1_alt").otherwise("chrM")
    return t("part").select(
        "p_partkey", text.probe_stem(F.concat(F.lit(" "), F.trim("p_name"), F.lit("_TC21\n"))).alias("stem"), text.contig_name(contig).alias("contig"),
        text.location_key(patched, k - 5).alias("place"), text.platform_name(F.col("p_type")).alias("platform"), text.sex_label(F.when(k % 2 == 0, " WOMAN").otherwise("m")).alias("sex"),
        text.word_label(F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(F.lit(" "), "p_brand"))).alias("label"), text.label_or_control(F.when(k % 2 == 0, " NA").otherwise(F.col("p_brand")), True).alias("shown"),
        F.size(text.id_list(F.concat(F.regexp_replace("p_name", " ", " , "), F.lit(" ,, ")))).alias("n_ids"), text.is_series(F.when(k % 2 == 0, "gse12").otherwise("GPL1")).alias("series"),
        text.valid(F.when(k % 2 == 0, F.sha2("p_name", 256)).otherwise(F.md5("p_name")), "sha256").alias("hashed"),
    )


@query(f"""WITH {_REGION_SQL} SELECT gene_id, region_type, "start", row_number() OVER (ORDER BY gene_id, region_type, "start", region_id) - 1 AS place FROM regions""")
def region_order(t):
    """Regions in the stated order of a release: by gene, type and start."""
    rows = numbered(_regions(t)[1], [F.col(c) for c in ("gene_id", "region_type", "start", "region_id")], "place")
    return rows.select("gene_id", "region_type", "start", "place")


@query("""SELECT 'G' || p_partkey AS gene_id, row_number() OVER (ORDER BY 'G' || p_partkey) - 1 AS place FROM part WHERE p_size % 5 <> 0""")
def gene_order(t):
    return numbered(_genes(t), [F.col("gene_id")], "place").select("gene_id", "place")


@query(f"""WITH {_PROBES} SELECT probe_id, locus_id, row_number() OVER (ORDER BY probe_id, locus_id) - 1 AS by_probe, row_number() OVER (ORDER BY locus_id, probe_id) - 1 AS by_locus FROM edges""")
def probe_order(t):
    """Probe-locus edges in both stated orders."""
    e = loci.build_registry(_probes(t))[1].select("probe_id", "locus_id")
    return numbered(numbered(e, [F.col("probe_id"), F.col("locus_id")], "by_probe"), [F.col("locus_id"), F.col("probe_id")], "by_locus").select("probe_id", "locus_id", "by_probe", "by_locus")


_GRAPH_SQL = f"""{_REGION_SQL}, {_PROBES}, genes AS (SELECT DISTINCT gene_id FROM regions), lr AS (SELECT locus_id, region_id, gene_id, region_type FROM loci JOIN regions USING (chromosome) WHERE position BETWEEN "start" AND "end" AND (locus_id + length(region_id)) % 5 <> 0)"""


def _graph(t):
    """loci, probes, edges, genes, regions and locus-region edges, every fifth of which is left out.

    The report and the rules read each of them several times, so each is worked out once and written.
    """
    probes = written(_probes(t))
    table, edges = loci.build_registry(probes)
    table, edges = written(table), written(edges)
    areas = written(_regions(t)[1])
    points = table.select("locus_id", F.col("chromosome").alias("chrom"), F.col("position").alias("pos"))
    hits = intervals.points_in_intervals(points, areas.withColumnRenamed("chromosome", "chrom")).filter((F.col("locus_id") + F.length("region_id")) % 5 != 0)
    return table, probes, edges, areas.select("gene_id").distinct(), areas, written(hits.select("locus_id", "region_id"))


@query(f"""WITH {_GRAPH_SQL}, v AS (SELECT 'total' AS section, 'n_loci' AS name, count(*)::DOUBLE AS value FROM loci UNION ALL SELECT 'total', 'n_genes', count(*) FROM genes UNION ALL SELECT 'total', 'n_regions', count(*) FROM regions
UNION ALL SELECT 'total', 'n_locus_region_edges', count(*) FROM lr UNION ALL SELECT 'total', 'n_probes', count(*) FROM probes UNION ALL SELECT 'total', 'n_unmapped_probes', count(*) FROM probes WHERE mapping_status <> 'mapped'
UNION ALL SELECT 'total', 'n_probe_locus_edges', count(*) FROM edges UNION ALL SELECT 'total', 'n_unassigned_loci', count(*) FROM loci WHERE locus_id NOT IN (SELECT locus_id FROM lr)
UNION ALL SELECT 'total', 'n_loci_multi_gene', count(*) FROM (SELECT locus_id FROM lr GROUP BY 1 HAVING count(DISTINCT gene_id) > 1)
UNION ALL SELECT 'total', 'probes_collapsed_max', max(n) FROM (SELECT count(*) AS n FROM edges GROUP BY locus_id) UNION ALL SELECT 'total', 'probes_collapsed_mean', avg(n) FROM (SELECT count(*) AS n FROM edges GROUP BY locus_id)
UNION ALL SELECT 'regions_by_type', region_type, count(*) FROM regions GROUP BY 2 UNION ALL SELECT 'edges_by_type', region_type, count(*) FROM lr GROUP BY 2
UNION ALL SELECT 'platform_probes', platform_id, count(*) FROM probes GROUP BY 2 UNION ALL SELECT 'platform_mapped', platform_id, count(*) FROM probes WHERE mapping_status = 'mapped' GROUP BY 2) SELECT section, name, round(value, 6) AS value FROM v""")
def graph_report(t):
    return report.graph_report(*_graph(t)).withColumn("value", F.round("value", 6))


@query(f"""WITH {_GRAPH_SQL}, e AS (SELECT * FROM edges UNION ALL SELECT probe_id, platform_id, -1, mapping_confidence FROM edges WHERE locus_id % 10 = 0),
v AS (SELECT 'locus_key' AS check_name, 0 AS n_bad UNION ALL SELECT 'gene_key', 0 UNION ALL SELECT 'region_key', count(*) FILTER (WHERE "start" % 3 = 0) FROM regions UNION ALL SELECT 'edge_key', 0
UNION ALL SELECT 'edge_locus', count(*) FROM e WHERE locus_id = -1 UNION ALL SELECT 'link_locus', 0 UNION ALL SELECT 'link_region', 0 UNION ALL SELECT 'region_gene', 2 * count(*) FILTER (WHERE "start" % 3 = 0 AND gene_id = 'G1') + count(*) FILTER (WHERE "start" % 3 <> 0 AND gene_id = 'G1') FROM regions
UNION ALL SELECT 'region_order', count(*) FILTER (WHERE "start" % 3 = 0) FROM regions UNION ALL SELECT 'probe_status', count(*) FROM (SELECT DISTINCT probe_id, platform_id FROM probes WHERE mapping_status = 'mapped' AND probe_id LIKE '%_1')) SELECT check_name, n_bad::BIGINT AS n_bad, n_bad = 0 AS passed FROM v""")
def graph_rules(t):
    """The rules on a graph with planted faults: repeated and turned regions, a gene that is gone, edges to nowhere, probes said to be unmapped."""
    table, probes, edges, genes, areas, links = _graph(t)
    turned = areas.filter(F.col("start") % 3 == 0).withColumn("end", F.col("start") - 1)
    lost = edges.filter(F.col("locus_id") % 10 == 0).withColumn("locus_id", F.lit(-1).cast("long"))
    said = probes.withColumn("mapping_status", F.when((F.col("mapping_status") == "mapped") & F.col("probe_id").endswith("_1"), "unmapped").otherwise(F.col("mapping_status")))
    return report.graph_rules(table, said, edges.unionByName(lost), genes.filter("gene_id <> 'G1'"), areas.unionByName(turned), links)
