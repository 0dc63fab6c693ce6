"""Registered queries of scorers, heads, losses, splits and key checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, scorers
from .queries import query

ENCODE = ([[0.5, -0.25, 0.75, 0.125], [-0.5, 0.25, 0.5, -0.375], [0.25, 0.5, -0.125, 0.625]], [0.1, -0.05, 0.0])
READ = ([[0.8, -0.6, 0.4]], [0.05])
KINDS = {0: [0.5, -0.5], 1: [-0.25, 0.75], 2: [1.0, 0.25]}
ENCODE_REGION = ([[0.5, 0.25, -0.5, 0.3, 0.2], [-0.4, 0.6, 0.2, -0.1, 0.5]], [0.0, 0.1])
READ_REGION = ([[0.7, -0.9]], [-0.1])
DIMS = 4
CLASSES = 10


def _sql_dense(names: list[str], layer, activate: bool = True) -> list[str]:
    out = []
    for row, bias in zip(*layer, strict=True):
        z = " + ".join([repr(float(bias)) + "::DOUBLE", *[f"{x} * ({w!r})::DOUBLE" for x, w in zip(names, row, strict=True)]])
        out.append(f"(CASE WHEN {z} > 0 THEN {z} ELSE ({z}) * 0.01::DOUBLE END)" if activate else f"({z})")
    return out


def _listed(exprs: list[str], name: str, wrap: str = "{}") -> str:
    return ", ".join(f"{wrap.format(e)} AS {name}{i}" for i, e in enumerate(exprs))


_V = [f"v{i}" for i in range(DIMS)]
_H = [f"h{i}" for i in range(len(ENCODE[0]))]
_ITEMS = f"i AS (SELECT vec_id % 5 AS sample, label AS gene, vec_id % 7 AS region, vec_id % 7 % 3 AS kind, {', '.join(f'embedding[{i + 1}]::DOUBLE AS v{i}' for i in range(DIMS))} FROM embeddings)"
_FLAT = f"""{_ITEMS}, p AS (SELECT sample, gene, {_listed(_sql_dense(_V, ENCODE), 'h', 'max({})')} FROM i GROUP BY sample, gene),
s AS (SELECT sample, gene, 1 / (1 + exp(-{_sql_dense(_H, READ, False)[0]})) AS score FROM p)"""


def _items(t):
    v = [F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(DIMS)]
    return t("embeddings").select((F.col("vec_id") % 5).alias("sample"), F.col("label").alias("gene"), (F.col("vec_id") % 7).alias("region"), (F.col("vec_id") % 7 % 3).alias("kind"), *v)


@query(f"WITH {_FLAT} SELECT sample, gene, round(score, 6) AS score FROM s")
def flat_score(t):
    return scorers.flat_score(_items(t), ["sample", "gene"], _V, ENCODE, READ).withColumn("score", F.round("score", 6))


_KIND = [" ".join(["CASE kind", *[f"WHEN {k} THEN {v[j]!r}::DOUBLE" for k, v in KINDS.items()], "ELSE 0.0::DOUBLE END"]) for j in range(2)]


@query(f"""WITH {_ITEMS}, r AS (SELECT sample, gene, region, kind, {_listed(_sql_dense(_V, ENCODE), 'h', 'max({})')} FROM i GROUP BY ALL),
k AS (SELECT *, {_KIND[0]} AS k0, {_KIND[1]} AS k1 FROM r),
g AS (SELECT sample, gene, {_listed(_sql_dense([*_H, 'k0', 'k1'], ENCODE_REGION), 'g', 'max({})')} FROM k GROUP BY sample, gene)
SELECT sample, gene, round(1 / (1 + exp(-{_sql_dense(['g0', 'g1'], READ_REGION, False)[0]})), 6) AS score FROM g""")
def layered_score(t):
    out = scorers.layered_score(_items(t), ["sample", "gene"], "region", "kind", _V, KINDS, ENCODE, ENCODE_REGION, READ_REGION)
    return out.withColumn("score", F.round("score", 6))


@query(f"""WITH {_FLAT}, w AS (SELECT DISTINCT label AS gene, o AS output, label % 3 - 1 + o * 0.5::DOUBLE AS weight, (label + o) % 4 <> 0 AS mask FROM embeddings, (SELECT unnest([0, 1]) AS o))
SELECT sample, output, round(sum((score - 0.5::DOUBLE) * weight), 6) AS value FROM s JOIN w USING (gene) WHERE mask GROUP BY sample, output""")
def masked_head(t):
    scored = scorers.flat_score(_items(t), ["sample", "gene"], _V, ENCODE, READ)
    genes = t("embeddings").select(F.col("label").alias("gene")).distinct().select("gene", F.explode(F.array(F.lit(0), F.lit(1))).alias("output"))
    w = genes.select("gene", "output", (F.col("gene") % 3 - 1 + F.col("output") * F.lit(0.5)).alias("weight"), ((F.col("gene") + F.col("output")) % 4 != 0).alias("mask"))
    return scorers.masked_head(scored, w, "sample", "gene").withColumn("value", F.round("value", 6))


_LOGITS = [f"embedding[{i + 1}]::DOUBLE" for i in range(CLASSES)]


@query(f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT label, sum(n) OVER ()::DOUBLE / (count(*) OVER () * n) AS w FROM n),
l AS (SELECT w, ln({' + '.join(f'exp({x})' for x in _LOGITS)}) - embedding[label + 1]::DOUBLE AS nll, embedding[label + 1] = greatest({', '.join(_LOGITS)}) AS hit FROM embeddings JOIN w USING (label))
SELECT round(sum(w * nll) / sum(w), 6) AS loss, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l""")
def weighted_ce(t):
    """Class weights come from one row a class; the item table is read twice and moves in no shuffle but the counts."""
    e = t("embeddings")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    w = n.crossJoin(every).select("label", (F.col("all") / (F.col("k") * F.col("n"))).alias("w"))  # every is one row
    logits = [F.get("embedding", F.lit(i)).cast("double") for i in range(CLASSES)]
    hit = F.get(F.array(*logits), F.col("label")) == F.greatest(*logits)
    rows = e.join(w, "label").select("w", scorers.cross_entropy(logits, F.col("label")).alias("nll"), hit.cast("double").alias("hit"))
    return rows.agg(F.round(F.sum(F.col("w") * F.col("nll")) / F.sum("w"), 6).alias("loss"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("""SELECT l_returnflag, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS loss, count(*) AS n_batches FROM lineitem GROUP BY 1""")
def epoch_rollup(t):
    mean = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.greatest(F.sum("l_quantity"), F.lit(1))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("loss"), F.count(F.lit(1)).alias("n_batches"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n, md5('7|' || o_custkey) AS key FROM orders GROUP BY 1),
p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY key, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n) OVER () AS before FROM n)
SELECT o_custkey, n, CASE WHEN before < 0.7::DOUBLE THEN 'train' WHEN before < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS role FROM p""")
def split_roles(t):
    return checks.study_roles(t("orders"), "o_custkey", {"train": 0.7, "val": 0.15, "test": 0.15}, seed=7)


@query("""SELECT 'orders_pk' AS check_name, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS n_bad
UNION ALL SELECT 'lineitem_pk', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
UNION ALL SELECT 'lineitem_order_fk', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'labels_document_fk', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'documents_lang', (SELECT count(*) FROM documents WHERE lang IS NULL)""")
def constraint_report(t):
    return checks.report([
        checks.unique(t("orders"), "orders_pk", ["o_orderkey"]),
        checks.unique(t("lineitem"), "lineitem_pk", ["l_orderkey", "l_linenumber"]),
        checks.references(t("lineitem"), "lineitem_order_fk", "l_orderkey", t("orders"), "o_orderkey"),
        checks.references(t("labels"), "labels_document_fk", "doc_id", t("documents"), "doc_id"),
        checks.not_null(t("documents"), "documents_lang", "lang"),
    ])


@query(f"""WITH {_FLAT}, w AS (SELECT DISTINCT label AS gene, o AS output, label % 3 - 1 + o * 0.5::DOUBLE AS weight, (label + o) % 4 <> 0 AS mask FROM embeddings, (SELECT unnest([0, 1]) AS o)),
m AS (SELECT sample, output, sum((score - 0.5::DOUBLE) * weight) AS v FROM s JOIN w USING (gene) WHERE mask GROUP BY sample, output), x AS (SELECT vec_id % 5 AS sample, avg(embedding[5]::DOUBLE) AS c0, avg(embedding[6]::DOUBLE) AS c1 FROM embeddings GROUP BY 1)
SELECT sample, o AS output, round(0.25 - 0.5 * o + coalesce(v, 0) + c0 * (0.3 + o) - c1 * (0.2 * o), 6) AS value FROM x CROSS JOIN (SELECT unnest([0, 1]) AS o) LEFT JOIN m ON m.sample = x.sample AND m.output = o""".replace("SELECT sample, o AS output", "SELECT x.sample, o AS output"))
def linear_head(t):
    """The masked head with a bias and two covariates of each sample."""
    scored = scorers.flat_score(_items(t), ["sample", "gene"], _V, ENCODE, READ)
    outputs = t("embeddings").select(F.col("label").alias("gene")).distinct().select("gene", F.explode(F.array(F.lit(0), F.lit(1))).alias("output"))
    w = outputs.select("gene", "output", (F.col("gene") % 3 - 1 + F.col("output") * F.lit(0.5)).alias("weight"), ((F.col("gene") + F.col("output")) % 4 != 0).alias("mask"))
    each = outputs.select("output").distinct()
    bias = each.select("output", (0.25 - 0.5 * F.col("output")).alias("bias"))
    o = F.col("output")
    cw = each.select("output", F.inline(F.array(F.struct(F.lit("c0").alias("name"), (0.3 + o).alias("weight")), F.struct(F.lit("c1").alias("name"), (-0.2 * o).cast("double").alias("weight")))))
    x = t("embeddings").groupBy((F.col("vec_id") % 5).alias("sample")).agg(*[F.avg(F.get("embedding", F.lit(4 + i)).cast("double")).alias(f"c{i}") for i in range(2)])
    out = scorers.linear_head(scored, w, "sample", "gene", bias, x.unpivot(["sample"], ["c0", "c1"], "name", "x"), cw)
    return out.withColumn("value", F.round("value", 6))


@query(f"""WITH {_ITEMS}, h AS (SELECT sample, gene, region, kind, {_listed(_sql_dense(_V, ENCODE), 'e')} FROM i),
r AS (SELECT sample, gene, region, kind, {', '.join(f'sum(e{i}) / sqrt(count(*)) AS h{i}' for i in range(3))} FROM h GROUP BY ALL), k AS (SELECT *, {_KIND[0]} AS k0, {_KIND[1]} AS k1 FROM r),
g AS (SELECT sample, gene, {_listed(_sql_dense([*_H, 'k0', 'k1'], ENCODE_REGION), 'g', 'avg({})')} FROM k GROUP BY sample, gene)
SELECT sample, gene, round(1 / (1 + exp(-{_sql_dense(['g0', 'g1'], READ_REGION, False)[0]})), 6) AS score FROM g""")
def layered_pools(t):
    """The layered scorer with other pools: sums by root of the number into regions, means into sets."""
    out = scorers.layered_score(_items(t), ["sample", "gene"], "region", "kind", _V, KINDS, ENCODE, ENCODE_REGION, READ_REGION, "sqrt_sum", "mean")
    return out.withColumn("score", F.round("score", 6))
