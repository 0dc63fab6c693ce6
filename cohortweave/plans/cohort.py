"""Registered queries of matrices, labels, cohorts, splits, metrics, validators and reports; each with its SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import checks, matrix, phenotypes, profile, ranks, scorers, segments, splits
from ..operators.storage import shared_dir
from ..sources import measurements
from .queries import query

# A matrix of line measurements: rows are suppliers, columns parts below 40 (by key), one cell each, discount as the value.
_CELLS = """cells AS (SELECT l_suppkey AS row_index, l_partkey % 40 AS col_index, max(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 12 END) AS beta FROM lineitem GROUP BY ALL)"""


def _cells(t):
    v = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 12)
    return t("lineitem").groupBy(F.col("l_suppkey").alias("row_index"), (F.col("l_partkey") % 40).alias("col_index")).agg(F.max(v).alias("beta"))


@query(f"""WITH {_CELLS} SELECT 4000 AS n_cells, 4000 - count(beta) AS n_missing, count(beta) AS n_finite, count(*) FILTER (WHERE beta < 0 OR beta > 1) AS n_out_of_range,
min(beta) AS v_min, max(beta) AS v_max, round(avg(beta), 6) AS v_mean, round(stddev_pop(beta), 6) AS v_std FROM cells""")
def matrix_summary(t):
    return matrix.matrix_summary(_cells(t), 100, 40)


@query(f"""WITH {_CELLS}, f AS (SELECT count(*) FILTER (WHERE hi = lo) AS n_flat FROM (SELECT max(beta) AS hi, min(beta) AS lo FROM cells GROUP BY col_index)),
s AS (SELECT 1 - count(beta) / 40.0::DOUBLE AS gone, avg(beta) AS mean FROM cells GROUP BY row_index)
SELECT n_flat, round(min(gone), 6) AS gone_min, round(median(gone), 6) AS gone_median, round(max(gone), 6) AS gone_max, round(min(mean), 6) AS mean_min, round(median(mean), 6) AS mean_median, round(max(mean), 6) AS mean_max FROM f, s GROUP BY n_flat""")
def corpus_summary(t):
    return matrix.corpus_summary(_cells(t), "row_index", "col_index", "beta", 40)


_COLUMNS = "cols AS (SELECT DISTINCT l_partkey AS probe, l_partkey // 2 AS locus_id FROM lineitem WHERE l_partkey % 3 <> 0), placed AS (SELECT min(probe) AS probe, locus_id, row_number() OVER (ORDER BY locus_id) - 1 AS col_index FROM cols GROUP BY locus_id)"


@query(f"""WITH {_COLUMNS}, s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) - 1 AS row_index FROM supplier)
SELECT row_index, col_index, l_extendedprice AS beta FROM lineitem JOIN placed ON probe = l_partkey JOIN s ON s_suppkey = l_suppkey""")
def matrix_ingest(t):
    """Raw cells to matrix places: first probe per locus, samples by name, unmapped probes left out."""
    probes = t("lineitem").select(F.col("l_partkey").alias("probe_id"), F.floor(F.col("l_partkey") / 2).alias("locus_id")).filter(F.col("probe_id") % 3 != 0).distinct()
    columns = probes.groupBy("locus_id").agg(F.min("probe_id").alias("probe_id"))
    samples = matrix.numbered(t("supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name"), [F.col("s_name")], "row_index")
    cells = t("lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("probe_id"), F.col("l_extendedprice").alias("beta"))
    return matrix.ingest(cells, columns, samples.select("sample_id", "row_index"))


_PAIRS = """pairs AS (SELECT DISTINCT p_partkey % 40 AS col_index, p_brand AS gene_id FROM part WHERE p_size < 20 AND p_partkey % 40 < 30),
genes AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS gene_index FROM (SELECT DISTINCT gene_id FROM pairs)),
vecs AS (SELECT vec_id AS col_index, embedding FROM embeddings WHERE vec_id < 25)"""


def _pairs(t):
    columns = t("part").select((F.col("p_partkey") % 40).alias("col_index"), F.col("p_partkey").alias("locus_id"))
    edges = t("part").filter("p_size < 20").select(F.col("p_partkey").alias("locus_id"), F.col("p_partkey").alias("region_id"))
    return matrix.locus_gene_pairs(columns, edges, t("part").select(F.col("p_partkey").alias("region_id"), F.col("p_brand").alias("gene_id")), most=30)


def _static(t):
    columns = t("part").select((F.col("p_partkey") % 40).alias("col_index")).distinct().withColumn("locus_id", F.col("col_index"))
    return matrix.static_columns(columns, t("embeddings").filter("vec_id < 25").select(F.col("vec_id").alias("locus_id"), F.slice("embedding", 1, 3).alias("vector")))


@query(f"WITH {_PAIRS} SELECT col_index, gene_id, gene_index FROM pairs JOIN genes USING (gene_id)")
def locus_gene_pairs(t):
    return _pairs(t)


@query("""SELECT c AS col_index, embedding IS NOT NULL AS valid, round(embedding[1]::DOUBLE, 5) AS v0 FROM (SELECT DISTINCT p_partkey % 40 AS c FROM part) LEFT JOIN (SELECT * FROM embeddings WHERE vec_id < 25) ON vec_id = c""")
def static_columns(t):
    return _static(t).select("col_index", "valid", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("v0"))


@query(f"""WITH {_CELLS}, {_PAIRS}, b AS (SELECT *, least(greatest(beta, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS c FROM cells)
SELECT row_index, gene_index, col_index, round(beta, 5) AS beta, round(log2(c / (1 - c)), 4) AS m, round(embedding[1]::DOUBLE, 4) AS v0, round(embedding[3]::DOUBLE, 4) AS v2
FROM b JOIN pairs USING (col_index) JOIN genes USING (gene_id) JOIN vecs USING (col_index) WHERE beta IS NOT NULL""")
def feature_rows(t):
    f = matrix.feature_rows(_cells(t), _static(t), _pairs(t))
    at = lambda i, n: F.round(F.get("features", F.lit(i)), n)
    return f.select("row_index", "gene_index", "col_index", at(0, 5).alias("beta"), at(1, 4).alias("m"), at(2, 4).alias("v0"), at(4, 4).alias("v2"))


@query(f"""WITH {_CELLS}, {_PAIRS} SELECT row_index, count(*) FILTER (WHERE beta IS NOT NULL AND embedding IS NOT NULL) AS n_observed, count(*) FILTER (WHERE beta IS NULL) AS n_no_value,
count(*) FILTER (WHERE beta IS NOT NULL AND embedding IS NULL) AS n_no_vector FROM cells JOIN pairs USING (col_index) LEFT JOIN vecs USING (col_index) GROUP BY 1""")
def feature_drops(t):
    return matrix.feature_drops(_cells(t), _static(t), _pairs(t))


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), d AS (SELECT var_pop(x::DOUBLE) AS var FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)
SELECT n.*, d.* FROM (SELECT count(*) AS n, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std, round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max, count(*) FILTER (WHERE norm <= 1e-6) AS n_near_zero FROM n) n,
(SELECT round(avg(var), 6) AS var_mean, round(min(var), 6) AS var_min, round(max(var), 6) AS var_max FROM d) d""")
def vector_summary(t):
    return matrix.vector_summary(t("embeddings"), "embedding")


@query(f"""WITH {_CELLS}, m AS (SELECT max(row_index) AS m FROM cells), k AS (SELECT cells.*, col_index % 10 = 0 AS odd FROM cells, m WHERE beta IS NOT NULL AND row_index IN (0, m // 2, m))
SELECT count(*) AS n, count(*) FILTER (WHERE odd) AS n_mismatch, coalesce(max(CASE WHEN odd THEN abs((beta + 0.25)::FLOAT::DOUBLE - beta::FLOAT::DOUBLE) ELSE 0 END), 0) AS max_diff FROM k""")
def stored_round_trip(t):
    """Tiles are stored, with a tenth of the columns changed, and read back; the first, middle and last sample are held against the source."""
    raw = _cells(t)
    spark = raw.sparkSession
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    measurements.write_tiles(raw.withColumn("beta", F.when(F.col("col_index") % 10 == 0, F.col("beta") + 0.25).otherwise(F.col("beta"))), path, width=16)
    chosen = matrix.chosen_rows(raw.select("row_index").distinct())
    stored = measurements.read_tiles(spark, path, width=16).join(F.broadcast(chosen), "row_index")  # three rows
    return matrix.round_trip(stored, raw, ["row_index", "col_index"])


_LABELS = """age AS (SELECT c_custkey AS sample_id, 'S' || c_nationkey AS study, '450K' AS platform, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS age, c_mktsegment AS tissue FROM customer WHERE c_custkey % 2 = 0),
tis AS (SELECT c_custkey AS sample_id, 'S' || c_nationkey AS study, 'EPIC' AS platform, CASE WHEN c_custkey % 5 = 0 THEN '17' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 = 0),
sx AS (SELECT c_custkey AS sample_id, 'S' || c_nationkey AS study, 'EPIC' AS platform, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex FROM customer)"""


def _sources(t):
    c, k = t("customer"), F.col("c_custkey")
    study = F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("study_id")
    age = c.filter(k % 2 == 0).select(k.alias("sample_id"), study, F.lit("450K").alias("platform"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("phenotype_value_numeric"), F.col("c_mktsegment").alias("tissue"))
    tissue = c.filter(k % 3 == 0).select(k.alias("sample_id"), study, F.lit("EPIC").alias("platform"), F.when(k % 5 == 0, "17").otherwise(F.col("c_mktsegment")).alias("phenotype_value"))
    sex = c.select(k.alias("sample_id"), study, F.lit("EPIC").alias("platform"), F.when(k % 2 == 0, "f").otherwise(" Man").alias("phenotype_value"))
    return [phenotypes.row_labels(age), phenotypes.row_labels(tissue), phenotypes.row_labels(sex, sex_source=True)]


def _table(t):
    index = t("customer").select(F.col("c_custkey").alias("row_index"), F.col("c_custkey").alias("sample_id"))
    seen = t("customer").filter("c_mktsegment <> 'BUILDING'")
    return phenotypes.unified_table(index, *_sources(t), phenotypes.ontology(seen, "c_mktsegment", 5))


_TABLE = f"""{_LABELS}, ont AS (SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) - 1 AS id FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 HAVING count(*) >= 5),
u AS (SELECT s.sample_id, s.study AS study_id, CASE WHEN a.sample_id IS NOT NULL THEN 'HM450' ELSE 'EPIC' END AS platform_id, a.age AS age_years, coalesce(CASE WHEN t.value = '17' THEN NULL ELSE t.value END, a.tissue) AS label, s.sex AS sex_label
FROM sx s LEFT JOIN age a USING (sample_id) LEFT JOIN tis t USING (sample_id)),
tab AS (SELECT sample_id AS row_index, sample_id, study_id, platform_id, age_years, age_years IS NOT NULL AS age_mask, o.label AS tissue_label, o.id AS tissue_class_id, o.id IS NOT NULL AS tissue_mask, sex_label, CASE sex_label WHEN 'Female' THEN 0 ELSE 1 END AS sex_class_id, true AS sex_mask,
CASE WHEN age_years IS NOT NULL OR o.id IS NOT NULL THEN 'multi' ELSE 'sex' END AS phenotype_family FROM u LEFT JOIN ont o ON o.label = u.label)"""


@query(f"WITH {_TABLE} SELECT * FROM tab")
def unified_labels(t):
    return _table(t)


@query(f"""WITH {_TABLE}, f AS (SELECT * FROM tab UNION ALL SELECT * FROM tab WHERE row_index % 100 = 0)
SELECT 'age_mask' AS check_name, count(*) FILTER (WHERE row_index % 50 = 0) AS n_bad FROM f UNION ALL SELECT 'tissue_mask', count(*) FILTER (WHERE row_index % 60 = 0) FROM f
UNION ALL SELECT 'tissue_id', count(*) FILTER (WHERE row_index % 70 = 0 AND tissue_mask AND row_index % 60 <> 0) FROM f UNION ALL SELECT 'sex_mask', count(*) FILTER (WHERE row_index % 90 = 0) FROM f
UNION ALL SELECT 'repeated', count(*) FILTER (WHERE row_index % 100 = 0) // 2 FROM f""")
def label_consistency(t):
    """Planted faults: flipped masks, class ids of another label, repeated samples."""
    r = F.col("row_index")
    flip = lambda c, n: F.when(r % n == 0, ~F.col(c)).otherwise(F.col(c))
    table = _table(t).withColumns({
        "tissue_class_id": F.when(r % 70 == 0, F.col("tissue_class_id") + 1).otherwise(F.col("tissue_class_id")),
        "age_mask": flip("age_mask", 50), "tissue_mask": flip("tissue_mask", 60), "sex_mask": flip("sex_mask", 90)})
    tissues = phenotypes.ontology(t("customer").filter("c_mktsegment <> 'BUILDING'"), "c_mktsegment", 5)
    return phenotypes.consistency_faults(table.unionByName(table.filter(r % 100 == 0)), tissues)


@query("""WITH a AS (SELECT 0 AS p, o_orderkey AS place, o_custkey AS k, 'F' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, o_custkey, 'P' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 2, o_orderkey, o_custkey, 'O' FROM orders WHERE o_orderstatus = 'O'),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, place) AS rn FROM a) SELECT p AS priority, place, k, src, row_number() OVER (ORDER BY p, place, k) - 1 AS new_index FROM f WHERE rn = 1""")
def merged_sources(t):
    return phenotypes.first_seen_union(_status_sources(t), "k", "place")


def _status_sources(t):
    o = t("orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("src"))
    return [o.filter(F.col("src") == s) for s in ("F", "P", "O")]


@query("""SELECT count(*) AS n_in, count(DISTINCT o_custkey) AS n_out, count(*) - count(DISTINCT o_custkey) AS n_deduped FROM orders WHERE o_orderstatus IN ('F', 'P', 'O')""")
def merged_counts(t):
    s = _status_sources(t)
    return phenotypes.union_counts(s, phenotypes.first_seen_union(s, "k", "place"))


@query("""SELECT DISTINCT 'N' || c_nationkey AS study_id FROM customer WHERE c_custkey % 3 <> 0""")
def study_list(t):
    k = F.col("c_custkey")
    named = F.concat(F.lit(" N"), F.col("c_nationkey").cast("string"))
    return phenotypes.studies_of(t("customer").select(F.when(k % 3 == 0, "nan").when(k % 3 == 1, " ").otherwise(named).alias("study_id"), F.when(k % 3 == 1, named).alias("project_id")))


@query("""WITH a AS (SELECT unnest([7, 3, 12]) AS n, unnest([0, 1, 2]) AS place), r AS (SELECT c_nationkey, c_name, place, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer JOIN a ON n = c_nationkey)
SELECT c_nationkey::VARCHAR AS study_id, c_name AS sample_id, row_number() OVER (ORDER BY place, c_name) - 1 AS row_index FROM r WHERE rn <= 4""")
def cohort_pick(t):
    rows = t("customer").select(F.col("c_nationkey").cast("string").alias("study_id"), F.col("c_name").alias("sample_id"))
    return phenotypes.cohort(rows, ["7", "3", "12"], 4).select("study_id", "sample_id", "row_index")


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'control' ELSE o_orderpriority END AS label FROM orders) SELECT o_orderkey AS sample_id, label, dense_rank() OVER (ORDER BY label) - 1 AS class_id FROM l""")
def family_classes(t):
    rows = t("orders").select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 5 == 0, " na").otherwise(F.col("o_orderpriority")).alias("value"))
    return phenotypes.family_labels(rows.select("sample_id"), rows, "value", empty_as_control=True).select("sample_id", "label", "class_id")


@query("""SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::DOUBLE ELSE o_totalprice END AS y FROM orders""")
def family_numbers(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(k.alias("sample_id"), F.when(k % 3 == 0, "none").otherwise(F.col("o_totalprice").cast("string")).alias("phenotype_value_numeric"), F.col("o_custkey").alias("age"))
    return phenotypes.family_numbers(rows.select("sample_id"), rows)


@query("""SELECT o_orderkey, upper(o_orderstatus) || '!' AS o_orderstatus FROM orders""")
def sidecar_relabel(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return phenotypes.relabelled(o, o.select("o_orderkey", F.concat(F.upper("o_orderstatus"), F.lit("!")).alias("o_orderstatus")), "o_orderkey", "o_orderstatus")


@query("""SELECT c_custkey, c_mktsegment AS study_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'train' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'validation' ELSE 'external_test' END AS role, c_mktsegment AS group_id FROM customer""")
def explicit_split(t):
    return splits.explicit_split(
        t("customer").select("c_custkey", F.col("c_mktsegment").alias("study_id")),
        {"train": ["BUILDING", "MACHINERY"], "validation": ["AUTOMOBILE"], "external_test": ["FURNITURE", "HOUSEHOLD"]},
    )


@query("""SELECT c_custkey, c_nationkey::VARCHAR AS donor, CASE WHEN c_nationkey IN (1, 2) THEN 'validation' ELSE 'train' END AS role FROM customer""")
def donor_split(t):
    rows = t("customer").select("c_custkey", F.concat(F.lit("a_b_"), F.col("c_nationkey").cast("string")).alias("title"))
    return splits.donor_split(rows, ["1", "2"]).select("c_custkey", "donor", "role")


@query("""SELECT * FROM (SELECT unnest(generate_series(0, 4)) AS true_class) CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS said_class)
LEFT JOIN (SELECT l_linenumber AS true_class, l_partkey % 6 AS said_class, count(*) AS m FROM lineitem GROUP BY ALL) USING (true_class, said_class)""".replace("SELECT *", "SELECT true_class, said_class, coalesce(m, 0) AS n", 1))
def confusion_matrix(t):
    return scores.confusion(t("lineitem").withColumn("p", F.col("l_partkey") % 6), "l_linenumber", "p", 5)


@query("""WITH c AS (SELECT l_linenumber AS a, l_partkey % 6 AS b FROM lineitem WHERE l_linenumber < 5 AND l_partkey % 6 < 5),
k AS (SELECT x, (SELECT count(*) FROM c WHERE a = x) AS s, (SELECT count(*) FROM c WHERE b = x) AS d, (SELECT count(*) FROM c WHERE a = x AND b = x) AS tp FROM (SELECT unnest(generate_series(0, 4)) AS x))
SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s + d > 0 THEN 2.0 * tp / (s + d) ELSE 0 END), 6) AS macro_f1, round(avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END), 6) AS balanced_accuracy FROM k""")
def macro_scores(t):
    return scores.macro_scores(scores.confusion(t("lineitem").withColumn("p", F.col("l_partkey") % 6), "l_linenumber", "p", 5))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(l_tax - l_discount)), 6) AS mae, round(sqrt(avg((l_tax - l_discount) ** 2)), 6) AS rmse, round(corr(l_discount, l_tax), 6) AS r FROM lineitem GROUP BY 1""")
def regression_by_group(t):
    return scores.regression_scores(t("lineitem"), "l_discount", "l_tax", ["l_returnflag"])


@query("""WITH s AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 <> 0 THEN round(avg(abs(l_tax - l_discount)), 6) END AS mae FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mae NULLS LAST, l_suppkey) AS best, row_number() OVER (ORDER BY mae DESC NULLS LAST, l_suppkey) AS worst FROM s)
SELECT l_suppkey, mae, 'best' AS side FROM r WHERE best <= 3 UNION ALL SELECT l_suppkey, mae, 'worst' FROM r WHERE worst <= 3""")
def extreme_samples(t):
    """Samples without a score, here NaN, come last on both sides."""
    s = scores.regression_scores(t("lineitem"), "l_discount", "l_tax", ["l_suppkey"]).select("l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, float("nan")).otherwise(F.col("mae")).alias("mae"))
    return profile.extremes(s, "mae", "l_suppkey", 3)


@query("""WITH s AS (SELECT avg(o_totalprice) FILTER (WHERE o_orderkey % 4 <> 0) AS m, stddev_pop(o_totalprice) FILTER (WHERE o_orderkey % 4 <> 0) AS sd FROM orders) SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN sd >= 1e-6 THEN sd ELSE 1 END, 6) AS z FROM orders, s""")
def train_scaled(t):
    return scores.standardise(t("orders"), "o_totalprice", F.col("o_orderkey") % 4 != 0).select("o_orderkey", F.round("z", 6).alias("z"))


@query("""SELECT round(coalesce(avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END), 0), 6) AS loss_age, count(e) AS n_age, 0.0::DOUBLE AS loss_none, 0 AS n_none, round(coalesce(avg(CASE WHEN q THEN 1.0 ELSE 0.0 END), 0), 6) AS loss_sex, count(*) AS n_sex,
round(0.5 * coalesce(avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END), 0) + 2 * coalesce(avg(CASE WHEN q THEN 1.0 ELSE 0.0 END), 0), 6) AS loss FROM (SELECT CASE WHEN l_linenumber <> 2 THEN abs(l_quantity - 25) / 10 END AS e, l_returnflag = 'R' AS q FROM lineitem)""")
def multitask_loss(t):
    e = (F.col("l_quantity") - 25) / 10
    out = scores.multitask_loss(t("lineitem"), {
        "age": (scores.huber(e), F.col("l_linenumber") != 2, 0.5), "none": (e * e, F.lit(False), 1.0), "sex": ((F.col("l_returnflag") == "R").cast("double"), F.lit(True), 2.0),
    })
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("loss") else c for c in out.columns])


#: x from -8 to 8 by tenths with the error function's own value at x / sqrt(2), for SQL to look up.
_NORMAL = ", ".join(f"({i}, {math.erf(i / 10 / math.sqrt(2))!r}::DOUBLE)" for i in range(-80, 81))


@query(f"""WITH phi(k, e) AS (VALUES {_NORMAL}), v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, greatest(-80, least(80, floor(embedding[1]::DOUBLE * 30)))::INT AS k FROM embeddings)
SELECT vec_id, round(0.5 * (k / 10.0::DOUBLE) * (1 + e), 10) AS gelu, round(x / (1 + exp(-x)), 6) AS silu, round(CASE WHEN x > 0 THEN x ELSE x * 0.01::DOUBLE END, 6) AS leaky,
round(x / sqrt((x * x + y * y + z * z) / 3 + 1e-6::DOUBLE), 6) AS rms, round((x - (x + y + z) / 3) / sqrt(((x - (x + y + z) / 3) ** 2 + (y - (x + y + z) / 3) ** 2 + (z - (x + y + z) / 3) ** 2) / 3 + 1e-5::DOUBLE), 6) AS layer FROM v JOIN phi USING (k)""")
def activations(t):
    """Units and norms; the Gaussian unit on tenths, where SQL knows the error function's values."""
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    tenth = F.greatest(F.lit(-80), F.least(F.lit(80), F.floor(v[0] * 30))).cast("double") / 10
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return t("embeddings").select("vec_id", F.round(scores.gelu(tenth), 10).alias("gelu"), r6(scores.silu(v[0]), "silu"), r6(scores.leaky_relu(v[0]), "leaky"), r6(scores.rms_norm(v)[0], "rms"), r6(scores.layer_norm(v)[0], "layer"))


_HEADS = """e AS (SELECT vec_id % 20 AS sample, label AS gene, max(embedding[1]::DOUBLE) AS s FROM embeddings GROUP BY ALL), g AS (SELECT *, 1 / (1 + exp(-s)) AS score FROM e), w AS (SELECT DISTINCT label AS gene, label % 3 - 1 AS w, label % 4 <> 0 AS mask FROM embeddings)"""


@query(f"""WITH {_HEADS} SELECT sample, round(sum(score * w), 6) AS raw, round(sum((score - 0.5) * w) FILTER (WHERE mask), 6) AS centred FROM g JOIN w USING (gene) GROUP BY 1""")
def task_heads(t):
    e = t("embeddings").groupBy((F.col("vec_id") % 20).alias("sample"), F.col("label").alias("gene")).agg(F.max(F.get("embedding", F.lit(0)).cast("double")).alias("s"))
    g = e.select("sample", "gene", scores.sigmoid(F.col("s")).alias("score"))
    w = t("embeddings").select(F.col("label").alias("gene"), (F.col("label") % 3 - 1).cast("double").alias("weight"), (F.col("label") % 4 != 0).alias("mask")).distinct()
    return scorers.task_heads(g, w, "sample", "gene").select("sample", F.round("raw", 6).alias("raw"), F.round("centred", 6).alias("centred"))


@query("""WITH s AS (SELECT unnest(generate_series(0, 12)) AS segment) SELECT segment, count(vec_id) AS n FROM s LEFT JOIN embeddings ON label = segment GROUP BY 1""")
def segment_counts(t):
    v = t("embeddings").select(F.col("label").alias("segment"))
    return segments.segment_count(v, v.sparkSession.range(13).select(F.col("id").cast("int").alias("segment")))


@query("""WITH s AS (SELECT unnest(generate_series(0, 12)) AS segment), d AS (SELECT unnest([0, 1]) AS dim), g AS (SELECT * FROM s, d)
SELECT segment, dim, round(coalesce(max(embedding[dim + 1]::DOUBLE), 0), 6) AS v_max, round(coalesce(sum(embedding[dim + 1]::DOUBLE), 0), 5) AS v_sum, round(coalesce(avg(embedding[dim + 1]::DOUBLE), 0), 6) AS v_mean,
round(coalesce(sum(embedding[dim + 1]::DOUBLE), 0) / greatest(sqrt(count(vec_id)), 1), 5) AS v_sqrt, count(vec_id) > 0 AS present FROM g LEFT JOIN embeddings ON label = segment GROUP BY ALL""")
def segment_grid(t):
    """All pools with empty segments (10 to 12) at 0 and not present."""
    v = t("embeddings").select(F.col("label").cast("long").alias("segment"), F.posexplode(F.slice("embedding", 1, 2)).alias("dim", "x")).select("segment", "dim", F.col("x").cast("double").alias("v"))
    seg = v.sparkSession.range(13).select(F.col("id").alias("segment"))
    pool = lambda how, name, n: segments.segment_pool(v, how, seg, 2).select("segment", "dim", F.round("pooled", n).alias(name))
    present = segments.segment_pool(v, "max", seg, 2).select("segment", "dim", F.round("pooled", 6).alias("v_max"), "present")
    return present.join(pool("sum", "v_sum", 5), ["segment", "dim"]).join(pool("mean", "v_mean", 6), ["segment", "dim"]).join(pool("sqrt_sum", "v_sqrt", 5), ["segment", "dim"])


@query("""SELECT count(*) FILTER (WHERE trim(v) = '') AS n_missing, count(*) FILTER (WHERE trim(v) <> '' AND try_cast(v AS DOUBLE) IS NULL) AS n_unparsed, count(try_cast(v AS DOUBLE)) AS n_numeric,
min(try_cast(v AS DOUBLE)) AS v_min, median(try_cast(v AS DOUBLE)) AS v_median, max(try_cast(v AS DOUBLE)) AS v_max FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_brand ELSE p_size::VARCHAR END AS v FROM part)""")
def age_summary(t):
    k = F.col("p_partkey") % 4
    return profile.numeric_summary(t("part").select(F.when(k == 0, " ").when(k == 1, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("v")), "v")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders),
n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both) SELECT *, n_a - n_both AS only_a, n_b - n_both AS only_b, n_a = n_both AND n_b = n_both AS aligned FROM n""")
def id_alignment(t):
    return profile.id_alignment(t("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH a AS (SELECT p_partkey AS c, p_partkey AS l FROM part), b AS (SELECT p_partkey AS c, CASE WHEN p_partkey % 100 = 0 THEN -1 ELSE p_partkey END AS l FROM part WHERE p_partkey <> 7)
SELECT coalesce(a.c, b.c) AS col_index, a.l AS of_a, b.l AS of_b FROM a FULL JOIN b ON a.c = b.c WHERE a.l IS DISTINCT FROM b.l""")
def column_differences(t):
    k = F.col("p_partkey")
    a = t("part").select(k.alias("col_index"), k.alias("locus_id"))
    return matrix.same_columns(a, t("part").filter("p_partkey <> 7").select(k.alias("col_index"), F.when(k % 100 == 0, -1).otherwise(k).alias("locus_id")))


@query("""SELECT 'item' AS check_name, count(*) FILTER (WHERE NOT coalesce(l_partkey BETWEEN 0 AND 99, false)) AS n_bad FROM lineitem UNION ALL SELECT 'group', count(*) FILTER (WHERE NOT coalesce(l_linenumber BETWEEN 0 AND 5, false)) FROM lineitem""")
def batch_bounds(t):
    return matrix.bound_faults(t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("grp")), 100, 6)


@query("""WITH l AS (SELECT p_partkey, p_size, CASE WHEN p_size > 3 THEN p_partkey - CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END END AS r FROM part), g AS (SELECT abs(coalesce(max(r) + 1, 0) - count(r)) AS gaps, count(r) - count(DISTINCT r) AS repeats FROM l)
SELECT 'gaps' AS check_name, gaps AS n_bad FROM g UNION ALL SELECT 'repeats', repeats FROM g UNION ALL SELECT 'status', count(*) FILTER (WHERE p_size > 3 AND p_size % 2 = 0 OR p_size <= 3 AND p_size % 2 = 1) FROM part
UNION ALL SELECT 'width', count(*) FILTER (WHERE vec_id % 40 = 0) FROM embeddings UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE vec_id % 60 = 1) FROM embeddings""")
def embedding_checks(t):
    """Planted faults of every kind: rows that repeat, short vectors, values that are not finite."""
    k, v = F.col("p_partkey"), F.col("vec_id")
    rows = t("part").select(F.when(F.col("p_size") > 3, k - F.when(k % 7 == 0, 1).otherwise(0)).alias("embedding_row"), F.when(F.col("p_size") % 2 == 1, "mapped").otherwise("unmapped").alias("mapping_status"))
    odd = F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("inf")).cast("float")))
    vectors = t("embeddings").select(F.when(v % 40 == 0, F.slice("embedding", 1, 63)).when(v % 60 == 1, odd).otherwise(F.col("embedding")).alias("vector"))
    return matrix.embedding_faults(rows, vectors, 64)


@query("""SELECT l_suppkey AS study_id, count(DISTINCT l_returnflag) AS n_roles FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def leaking_studies(t):
    return splits.leaking(t("lineitem").select(F.col("l_suppkey").alias("study_id"), F.col("l_returnflag").alias("role")))


@query("""SELECT n_name, count(*) AS n_samples, count(*) FILTER (WHERE c_acctbal > 0) AS n_used FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def registry_filter(t):
    """Entries of two families with their sample counts."""
    c = t("customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("c_acctbal") > 0).alias("n_used"))


@query("""SELECT check_name, n_bad FROM (SELECT 'region_order' AS check_name, count(*) FILTER (WHERE p_size < 0) AS n_bad FROM part UNION ALL SELECT 'edge_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'edge_pk', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber))""")
def graph_checks(t):
    """A graph's validators: interval order, edges whose ends exist, edges once."""
    order = t("part").agg(F.count_if(F.col("p_size") < 0).alias("n_bad")).select(F.lit("region_order").alias("check_name"), "n_bad")
    return checks.report([order, checks.references(t("lineitem"), "edge_part", "l_partkey", t("part"), "p_partkey"), checks.unique(t("lineitem"), "edge_pk", ["l_orderkey", "l_partkey", "l_linenumber"])])


@query("""SELECT round(median(l_extendedprice), 6) AS price, round(median(CASE WHEN l_linenumber <> 3 THEN l_quantity END), 6) AS quantity, round(median(l_orderkey::DOUBLE), 6) AS place FROM lineitem""")
def exact_medians(t):
    """Medians by rank selection: no task sorts more than a bucket of the rows."""
    rows = t("lineitem").select("l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_orderkey")
    m = ranks.medians(rows, ["l_extendedprice", "l_quantity", "l_orderkey"], bucket=2000)
    named = zip(("price", "quantity", "place"), m.values(), strict=True)
    return t("lineitem").sparkSession.range(1).select(*[F.round(F.lit(v), 6).alias(k) for k, v in named])


@query("""WITH n AS (SELECT l_suppkey AS study_id, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT *, md5('5|' || study_id) AS k FROM n),
a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k, study_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(n) OVER ())::DOUBLE AS share FROM h),
r AS (SELECT *, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7 + 0.15 THEN 'validation' ELSE 'external_test' END AS role FROM a) SELECT 'v1' AS split_id, role, count(*) AS n_studies, sum(n)::BIGINT AS n_samples FROM r GROUP BY 2""")
def split_roles_manifest(t):
    """Whole studies dealt by share, and the manifest's counts by role."""
    samples = t("lineitem").select(F.col("l_suppkey").alias("study_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"))
    return splits.split_manifest(splits.auto_split(samples, seed=5), "v1")[1]
