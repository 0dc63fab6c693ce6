"""Registered queries of catalogue views, orders, profiles and small networks; each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import digest, overlap, phenotypes, profile, scorers
from ..operators.ordered import numbered, ranged, running
from ..operators.storage import shared_dir
from ..sources import tables
from ..sources.stored import StoredTable
from .queries import query


@query("""SELECT locus_id, region_id, row_number() OVER (ORDER BY locus_id, region_id) - 1 AS place FROM (SELECT DISTINCT l_partkey AS locus_id, l_suppkey AS region_id FROM lineitem)""")
def edge_order(t):
    """Edges sorted by both ends; the place comes from range partitions."""
    e = t("lineitem").select(F.col("l_partkey").alias("locus_id"), F.col("l_suppkey").alias("region_id")).distinct()
    return numbered(e, [F.col("locus_id"), F.col("region_id")], "place")


@query("""SELECT p_partkey, 'chr' || (p_partkey % 23) AS chromosome, row_number() OVER (ORDER BY 'chr' || (p_partkey % 23), p_size, p_partkey) AS locus_id FROM part""")
def contig_order(t):
    """Contigs in text order (chr10 before chr2), then position."""
    p = t("part").select("p_partkey", "p_size", F.concat(F.lit("chr"), (F.col("p_partkey") % 23).cast("string")).alias("chromosome"))
    return numbered(p, [F.col("chromosome"), F.col("p_size"), F.col("p_partkey")], "locus_id", start=1).drop("p_size")


@query("""SELECT r_name, n_name, n_customers FROM (SELECT r_name, n_name, count(c_custkey) AS n_customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) ORDER BY n_customers DESC, n_name LIMIT 5""")
def preview(t):
    n = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_customers")).orderBy(F.desc("n_customers"), "n_name").limit(5)


@query("""SELECT o_orderkey AS artifact_id, 'custkey:' || o_custkey AS source, o_orderstatus AS status, o_totalprice > 100000 AS large FROM orders""")
def lineage(t):
    return t("orders").select(F.col("o_orderkey").alias("artifact_id"), F.concat(F.lit("custkey:"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("large"))


@query("""SELECT c_mktsegment AS study_id, c_custkey AS sample_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place FROM customer""")
def study_blocks(t):
    """Blocks of studies, each numbered on its own, over ranges of all rows, so a study of any size is spread."""
    c = t("customer").select(F.col("c_mktsegment").alias("study_id"), F.col("c_custkey").alias("sample_id"), F.lit(1).cast("long").alias("one"))
    placed = running(ranged(c, [F.col("study_id"), F.col("sample_id")]), F.sum, ["one"], ["study_id"], first=0)
    return placed.select("study_id", "sample_id", F.col("before_one").alias("place"))


@query("""WITH new AS (SELECT n_nationkey AS k, 'seed' AS v FROM nation WHERE n_nationkey < 5) SELECT n_nationkey AS k, coalesce(v, n_name) AS v FROM nation LEFT JOIN new ON k = n_nationkey UNION ALL SELECT 99, 'seed'""")
def seed_upsert(t):
    """Rows put into a stored table, then twice constant rows onto it, with the same outcome."""
    old = t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"), F.lit(0).alias("seq"))
    new = old.filter("k < 5").select("k").unionByName(old.limit(1).select(F.lit(99).cast("long").alias("k"))).select("k", F.lit("seed").alias("v"), F.lit(0).alias("seq"))
    spark = old.sparkSession
    table = StoredTable(spark, f"{shared_dir(spark)}/seeds-{uuid.uuid4().hex}")
    for rows in (old, new, new):
        table.upsert(rows, "k")
    return table.read()


def _digest_sql(table, fields):
    """SQL of a table's digest; fields: (type, expression)."""
    row = " || ".join(f"CASE WHEN {x} IS NULL THEN '{kind} null;' ELSE '{kind} ' || length(({x})::VARCHAR) || ':' || ({x})::VARCHAR || ';' END" for kind, x in fields)
    lanes = ", ".join(f"coalesce(sum(('0x' || substr(h, {29 - 4 * i}, 4))::BIGINT), 0)::BIGINT AS s{i}" for i in range(8))
    sql = f"SELECT count(*) AS n, {lanes} FROM (SELECT md5({row}) AS h FROM {table})"
    for i in range(1, 8):
        sql = f"SELECT * REPLACE (s{i} + (s{i - 1} >> 16) AS s{i}) FROM ({sql})"
    digits = " || ".join(f"lpad(lower(to_hex(s{i} & 65535)), 4, '0')" for i in reversed(range(8)))
    return f"SELECT n, {digits} AS digest FROM ({sql})"


@query(_digest_sql("orders", [("bigint", "o_orderkey % 50"), ("string", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END"), ("string", "CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END")]))
def table_digest(t):
    """A table as a multiset: rows repeat, and nulls change column."""
    k = F.col("o_orderkey")
    rows = t("orders").select((k % 50).cast("long").alias("k"), F.when(k % 3 > 0, F.col("o_orderstatus")).alias("a"), F.when(k % 3 < 2, F.col("o_orderpriority")).alias("b"))
    return digest.table_digest(rows, ["k", "a", "b"])


@query("""WITH s AS (SELECT DISTINCT l_partkey AS row, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE (l_partkey % 7 + 1) || ':' || (l_partkey - 1) END AS key FROM lineitem),
e AS (SELECT (p_partkey % 7 + 1) || ':' || (p_partkey - 1) AS key, p_size FROM part WHERE p_size > 10) SELECT row, s.key, p_size, p_size IS NOT NULL AS mapped FROM s LEFT JOIN e ON s.key = e.key""")
def location_join(t):
    """Loci to an outside table by a computed location key; patched contigs have none."""
    k = F.col("l_partkey")
    contig = F.when(k % 4 == 0, "chrUn_x").otherwise(F.concat(F.lit("chr"), (k % 7 + 1).cast("string")))
    loci = t("lineitem").select(k.alias("row"), text.location_key(contig, k).alias("key")).distinct()
    e = t("part").filter("p_size > 10").select(text.location_key((F.col("p_partkey") % 7 + 1).cast("string"), F.col("p_partkey")).alias("key"), "p_size")
    return loci.join(e, "key", "left").select("row", "key", "p_size", F.col("p_size").isNotNull().alias("mapped"))


@query("""SELECT c_custkey AS sample_id, c_nationkey::VARCHAR AS donor, c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS class_id FROM customer""")
def pilot_labels(t):
    """Cell types by dense id, and the donor from the title."""
    c = t("customer").select(F.col("c_custkey").alias("sample_id"), F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("title"), F.concat(F.lit(" "), "c_mktsegment").alias("value"))
    labels = phenotypes.family_labels(c.select("sample_id", "title"), c, "value")
    return labels.select("sample_id", text.donor_of(F.col("title")).alias("donor"), "label", "class_id")


def _profile_sql(tabs):
    one = lambda tab, c: f"""SELECT '{tab}' AS tab, '{c}' AS col, count(*) AS n, count(DISTINCT CAST({c} AS VARCHAR)) AS n_unique, round(count(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)) / greatest(count({c}), 1), 6) AS rate FROM {tab}"""
    inner = " UNION ALL ".join(one(tab, c) for tab, cols in tabs.items() for c in cols)
    return f"SELECT tab, col, n_unique, CASE WHEN rate >= 0.8 AND n_unique > 0 THEN 'numeric' WHEN n_unique <= greatest(20.0, 0.05 * n) THEN 'categorical' ELSE 'string' END AS kind FROM ({inner})"


_PROFILED = {"supplier": ["s_suppkey", "s_name", "s_nationkey"], "orders": ["o_orderstatus", "o_totalprice", "o_orderpriority"], "nation": ["n_name", "n_regionkey"]}


@query(_profile_sql(_PROFILED))
def table_profiles(t):
    each = [profile.column_profile(t(tab), cols).select(F.lit(tab).alias("tab"), "col", "n_unique", "kind") for tab, cols in _PROFILED.items()]
    return reduce(DataFrame.unionByName, each)


_SHARED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}
_SHARED_SQL = " UNION ALL ".join(f"SELECT '{tab}' AS tab, '{c[2:]}' AS name, count(*) AS r, count({c}) AS v FROM {tab}" for tab, cols in _SHARED.items() for c in cols)


@query(f"""SELECT name, count(DISTINCT tab) AS n_tables, sum(r)::BIGINT AS n_rows, sum(v)::BIGINT AS n_values, count(DISTINCT tab) = {len(_SHARED)} AS everywhere FROM ({_SHARED_SQL}) GROUP BY 1""")
def shared_columns(t):
    """Columns of three tables by their own schemas: where each is, whether in all, and its values."""
    return overlap.column_overlap({tab: t(tab).select(cols) for tab, cols in _SHARED.items()}, lambda c: c.split("_", 1)[1])


@query("""WITH l AS (SELECT 'lang' AS col, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), n AS (SELECT col, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place FROM n), d AS (SELECT 'lang' AS col, count(DISTINCT lang) <= greatest(20.0, 0.05 * count(*)) AS few FROM documents UNION ALL SELECT 'source', count(DISTINCT source) <= greatest(20.0, 0.05 * count(*)) FROM documents)
SELECT col, place, value, n FROM r JOIN d USING (col) WHERE few AND place <= 8""")
def categorical_values(t):
    """The eight most frequent values of each categorical column."""
    return profile.top_values(t("documents").select("lang", "source", F.length("text").cast("string").alias("size")), ["lang", "source"])


@query("""WITH a AS (SELECT DISTINCT 'GSE' || c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT 'GSE' || s_nationkey AS k FROM supplier) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both""")
def namespace_overlap(t):
    """Accessions of the series kind in two namespaces."""
    a = t("customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "gse").otherwise("X"), F.col("c_nationkey").cast("string")).alias("k")).filter(text.is_series(F.col("k"))).select(F.upper("k").alias("k"))
    b = t("supplier").select(F.concat(F.lit("GSE"), F.col("s_nationkey").cast("string")).alias("k"))
    return profile.id_alignment(a, b, "k").select("n_a", "n_b", "n_both")


_W1, _B1, _W2, _B2 = [[0.5, -0.2, 0.1], [0.3, 0.4, -0.6]], [0.1, -0.1], [[0.7, -0.3]], [0.05]


def _gelu(z):
    """The Gaussian unit by the error function's power series, good to five digits for |z| under 4."""
    series = f"list_sum(list_transform(range(0, 60), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * pow(({z}) / sqrt(2.0::DOUBLE), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
    return f"(0.5 * ({z}) * (1 + 1.1283791670955126::DOUBLE * {series}))"


@query(f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
l AS (SELECT vec_id, 0.1 + 0.5::DOUBLE * x - 0.2::DOUBLE * y + 0.1::DOUBLE * z AS a, -0.1 + 0.3::DOUBLE * x + 0.4::DOUBLE * y - 0.6::DOUBLE * z AS b FROM v),
n AS (SELECT vec_id, (a - (a + b) / 2) / sqrt(((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2) / 2 + 1e-5::DOUBLE) AS a, (b - (a + b) / 2) / sqrt(((a - (a + b) / 2) ** 2 + (b - (a + b) / 2) ** 2) / 2 + 1e-5::DOUBLE) AS b FROM l)
SELECT vec_id, round(0.05 + 0.7::DOUBLE * {_gelu('a')} - 0.3::DOUBLE * {_gelu('b')}, 5) AS value FROM n""")
def network(t):
    """Linear, layer norm, activation, linear without activation."""
    v = [F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)]
    x = t("embeddings").select("vec_id", *v)
    out = scorers.network(x, ["vec_id"], ["v0", "v1", "v2"], [(_W1, _B1), (_W2, _B2)])
    return out.select("vec_id", F.round("y0", 5).alias("value"))


@query("""WITH s AS (SELECT label, max(embedding[1]::DOUBLE) AS s FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1), g AS (SELECT unnest(generate_series(0, 11)) AS gene) SELECT 0 AS sample, gene, round(coalesce(1 / (1 + exp(-s)), 0.5), 6) AS score, s IS NOT NULL AS present FROM g LEFT JOIN s ON label = gene""")
def absent_sets(t):
    """Sets without an item score the neutral value and are not present."""
    from ..functions.scores import sigmoid

    s = t("embeddings").filter("vec_id % 3 = 0").groupBy(F.col("label").alias("gene")).agg(F.max(F.get("embedding", F.lit(0)).cast("double")).alias("s"))
    spark = s.sparkSession
    genes = spark.range(12).select(F.col("id").cast("int").alias("gene"))
    got = scorers.with_absent(s.select(F.lit(0).alias("sample"), "gene", sigmoid(F.col("s")).alias("score")), spark.range(1).select(F.col("id").cast("int").alias("sample")), genes, "sample", "gene")
    return got.withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, round(coalesce(k, -1), 6) AS v FROM e""")
def aliased_number(t):
    """The first of several names that a JSON value has, as a number."""
    j = t("events").select("event_id", F.get_json_object("props", "$.missing").alias("a"), F.get_json_object("props", "$.k").alias("b"))
    return j.select("event_id", F.round(F.coalesce(tables.number_of(j, "none", "a", "b"), F.lit(-1.0)), 6).alias("v"))


_GRID = """a AS (SELECT l_suppkey AS s, l_partkey % 50 AS p, max(l_tax) AS beta FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_partkey % 60 AS p, max(l_discount) AS beta FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT a.s FROM a JOIN b ON a.s = b.s) CROSS JOIN (SELECT DISTINCT a.p FROM a JOIN b ON a.p = b.p))"""


@query(f"""WITH {_GRID} SELECT s, count(*) AS n, count(a.beta) AS n_a, count(b.beta) AS n_b, count(*) FILTER (WHERE (a.beta IS NULL) <> (b.beta IS NULL)) AS n_one_side, count(*) FILTER (WHERE a.beta IS NULL AND b.beta IS NULL) AS n_neither, round(avg(abs(a.beta - b.beta)), 6) AS mae
FROM g LEFT JOIN a USING (s, p) LEFT JOIN b USING (s, p) GROUP BY s""")
def grid_compare(t):
    """Two sources over their shared samples and probes."""
    cells = lambda k, m, v: t("lineitem").filter(F.col("l_suppkey") % k == 0).groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % m).alias("p")).agg(F.max(v).alias("beta"))
    return profile.compare_grids(cells(2, 50, "l_tax"), cells(3, 60, "l_discount"), "s", "p").withColumn("mae", F.round("mae", 6))


@query("""WITH n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_genes, count(*) AS n_edges FROM lineitem GROUP BY 1) SELECT count(*) AS n_loci, count(*) FILTER (WHERE n_genes > 1) AS n_multi_gene, max(n_genes) AS genes_max, round(avg(n_edges), 6) AS edges_mean FROM n""")
def genes_per_locus(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_genes"), F.count(F.lit(1)).alias("n_edges"))
    return n.agg(F.count(F.lit(1)).alias("n_loci"), F.count_if(F.col("n_genes") > 1).alias("n_multi_gene"), F.max("n_genes").alias("genes_max"), F.round(F.avg("n_edges"), 6).alias("edges_mean"))


@query("""SELECT l_linenumber AS epoch, round(sum(l_tax * l_quantity) / greatest(sum(l_quantity), 1), 6) AS loss, round(sum(CASE WHEN l_returnflag = 'R' THEN l_discount * l_quantity ELSE 0 END) / greatest(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 1), 6) AS accuracy,
round(sum(CASE WHEN l_returnflag = 'Z' THEN l_discount ELSE 0 END) / greatest(count(*) FILTER (WHERE l_returnflag = 'Z'), 1), 6) AS mae FROM lineitem GROUP BY 1""")
def epoch_tasks(t):
    """Batches to epochs: each task's mean weighs by its own observed rows, and a task without any counts 0."""
    share = lambda x, w: F.round(F.sum(x * w) / F.greatest(F.sum(w), F.lit(1.0)), 6)
    seen = lambda flag, w: F.when(F.col("l_returnflag") == flag, w).otherwise(F.lit(0.0))
    return t("lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(
        share(F.col("l_tax"), F.col("l_quantity")).alias("loss"), share(F.col("l_discount"), seen("R", F.col("l_quantity"))).alias("accuracy"),
        share(F.col("l_discount"), seen("Z", F.lit(1.0))).alias("mae"),
    )


@query("""SELECT coalesce(lang, '') AS grp, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS n_both FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def accuracy_by_group(t):
    j = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    same = (F.col("quality") == F.col("toxic")).cast("double")
    return j.groupBy(F.coalesce("lang", F.lit("")).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(same, F.lit(0.0))), 6).alias("accuracy"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("n_both"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Male' ELSE 'Female' END AS label, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS class_id, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 GROUP BY ALL""")
def sex_classes(t):
    """Samples by class of the default sex ontology; blank labels have none."""
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, " ").when(k % 3 == 0, "m").when(k % 2 == 0, "Woman").otherwise("FEMALE ")
    labels = t("customer").select(text.sex_label(said).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return phenotypes.sex_ontology(labels.sparkSession).join(labels, "label")
