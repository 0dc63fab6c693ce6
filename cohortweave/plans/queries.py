"""Registered queries of the core operators over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import intervals, overlap, profile, segments
from ..operators.ordered import numbered, ordered_lists

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        ORACLE[f.__name__] = sql
        return f

    return add


def _points(t):
    return t("lineitem").select(F.col("l_partkey").alias("pos")).distinct().withColumn("chrom", F.col("pos") % 7)


_PTS = "pts AS (SELECT DISTINCT l_partkey AS pos, l_partkey % 7 AS chrom FROM lineitem)"


@query(f"""WITH {_PTS}, iv AS (SELECT p_partkey AS region, p_partkey % 7 AS chrom, p_partkey - p_size AS s, p_partkey + p_size AS e, p_brand AS gene, p_size FROM part),
h AS (SELECT pts.chrom, pos, gene, region, row_number() OVER (PARTITION BY pos, gene ORDER BY p_size, region) AS rn FROM pts JOIN iv ON pts.chrom = iv.chrom AND pos BETWEEN s AND e)
SELECT chrom, pos, gene, region FROM h WHERE rn = 1""")
def interval_precedence(t):
    iv = t("part").select(F.col("p_partkey").alias("region"), (F.col("p_partkey") % 7).alias("chrom"), (F.col("p_partkey") - F.col("p_size")).alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_brand").alias("gene"), "p_size")
    hits = intervals.points_in_intervals(_points(t), iv, bin_width=64)
    return intervals.first_by(hits, ["pos", "gene"], [F.col("p_size"), F.col("region")]).select("chrom", "pos", "gene", "region")


@query(f"""WITH {_PTS}, iv AS (SELECT p_partkey % 7 AS chrom, p_partkey AS s, p_partkey + 3 AS e FROM part WHERE p_size = 7),
h AS (SELECT pts.chrom, pos, greatest(s - pos, pos - e, 0) AS dist, CASE WHEN s > pos THEN 'south' WHEN pos > e THEN 'north' ELSE 'in' END AS side
  FROM pts JOIN iv ON pts.chrom = iv.chrom AND pos BETWEEN s - 40 AND e + 40),
b AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY dist, side) AS rn FROM h)
SELECT pts.chrom, pts.pos, CASE WHEN b.pos IS NULL THEN 'open' WHEN dist = 0 THEN 'island' WHEN dist <= 20 THEN side || '_shore' ELSE side || '_shelf' END AS band
FROM pts LEFT JOIN b ON pts.chrom = b.chrom AND pts.pos = b.pos AND rn = 1""")
def interval_bands(t):
    iv = t("part").filter("p_size = 7").select((F.col("p_partkey") % 7).alias("chrom"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + 3).alias("end"))
    return intervals.distance_bands(_points(t), iv, 20, 40).select("chrom", "pos", "band")


@query("""WITH i AS (SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders),
f AS (SELECT *, s + 60 AS e, max(s + 60) OVER (PARTITION BY o_custkey ORDER BY s, s + 60 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT o_custkey, min(s) AS "start", max(e) AS "end" FROM g GROUP BY o_custkey, run""")
def interval_merge(t):
    s = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return intervals.merge_intervals(t("orders").select("o_custkey", s.alias("start"), (s + 60).alias("end")), "o_custkey")


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers, round(sum(coalesce(c_acctbal, 0)), 2) AS fanned_balance
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def inventory_fanout(t):
    """A join of both sides would multiply a nation's customers by its suppliers; each side is summed first, and the sums multiply."""
    c = t("customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n_customers"), F.sum("c_acctbal").alias("balance"))
    s = t("supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("n_suppliers"), F.count(F.lit(1)).alias("fan"))
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = j.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    fanned = zero(F.col("balance")) * F.greatest(zero(F.col("fan")), F.lit(1))
    return j.groupBy("r_name", "n_name").agg(zero(F.sum("n_customers")).alias("n_customers"), zero(F.sum("n_suppliers")).alias("n_suppliers"), F.round(F.sum(fanned), 2).alias("fanned_balance"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 4) AS mean
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def group_summary(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""WITH g AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT md5(text) AS text_md5, doc_id, n FROM documents JOIN g USING (text)""")
def duplicate_groups(t):
    """A row per document of a repeated text; groups are counted by digest and length, so no task holds a group's ids."""
    d = t("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("size")).filter("size IS NOT NULL")
    several = d.groupBy("text_md5", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.join(several, ["text_md5", "size"]).select("text_md5", "doc_id", "n")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""")
def platform_overlap(t):
    j = t("part").join(t("lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@query("""SELECT p_brand, o_orderpriority, count(DISTINCT c_custkey) AS n_customers FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def coverage_4way(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("p_brand", "o_orderpriority").agg(F.countDistinct("c_custkey").alias("n_customers"))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(corr(o_totalprice, o_custkey), 6) AS r FROM orders GROUP BY ALL""")
def fold_stats(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"), F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("r"))


@query("""SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS id FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def dense_ids(t):
    return segments.dense_ids(t("customer"), "c_mktsegment")


@query("""SELECT l_partkey, min(l_suppkey) AS first_supp, count(*) - 1 AS collapsed FROM lineitem GROUP BY l_partkey""")
def first_per_key(t):
    return t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supp"), (F.count(F.lit(1)) - 1).alias("collapsed"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3""")
def topn_per_group(t):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return t("lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rn")


@query("""WITH u AS (SELECT o_orderkey, 1 AS p FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey, min(p) AS lane FROM u GROUP BY o_orderkey""")
def first_seen_union(t):
    o = t("orders")
    lane = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_totalprice") > 400000, 2).when(F.col("o_orderpriority") == "1-URGENT", 3)
    return o.select("o_orderkey", lane.alias("lane")).filter("lane is not null").groupBy("o_orderkey").agg(F.min("lane").alias("lane"))


@query("""SELECT l_returnflag, count(*) AS n_total, count(*) FILTER (WHERE l_discount IS NULL) AS n_missing, count(l_discount) AS n_finite,
count(*) FILTER (WHERE l_discount < 0.02 OR l_discount > 0.08) AS n_out_of_range, min(l_discount) AS v_min, max(l_discount) AS v_max, round(avg(l_discount), 6) AS v_mean FROM lineitem GROUP BY ALL""")
def qc_stats(t):
    return profile.qc_stats(t("lineitem"), "l_discount", ["l_returnflag"], 0.02, 0.08)


def _profile_sql(table, cols):
    one = " UNION ALL ".join(
        f"""SELECT '{c}' AS col, count(*) AS n, round(count({c}) / count(*), 6) AS non_null_rate, count(DISTINCT CAST({c} AS VARCHAR)) AS n_unique,
round(count(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)) / greatest(count({c}), 1), 6) AS numeric_rate, round(min(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)), 6) AS v_min,
round(max(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)), 6) AS v_max, round(avg(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)), 4) AS v_mean FROM {table}"""
        for c in cols
    )
    return f"""SELECT *, CASE WHEN numeric_rate >= 0.8 AND n_unique > 0 THEN 'numeric' WHEN n_unique <= greatest(20.0, 0.05 * n) THEN 'categorical' ELSE 'string' END AS kind FROM ({one})"""


@query(_profile_sql("lineitem", ["l_quantity", "l_returnflag", "l_linenumber"]))
def column_profile(t):
    return profile.column_profile(t("lineitem"), ["l_quantity", "l_returnflag", "l_linenumber"])


@query("""WITH c AS (SELECT coalesce(lang, '__NULL__') AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(lang, '__NULL__')) AS place FROM documents GROUP BY 1)
SELECT value, n FROM c WHERE place <= 3 UNION ALL SELECT '__truncated_levels__', count(*) FROM c WHERE place > 3 HAVING count(*) > 0""")
def value_counts_topk(t):
    return profile.value_counts(t("documents"), "lang", 3)


@query("""WITH u AS (SELECT DISTINCT event_type || '/' || (event_id % 3) AS e, user_id AS k FROM events WHERE user_id % 3 <> 0 OR event_id % 3 = 0), f AS (SELECT DISTINCT e FROM u)
SELECT a.e AS a, b.e AS b, (SELECT count(*) FROM u x JOIN u y ON x.k = y.k WHERE x.e = a.e AND y.e = b.e) AS n FROM f a JOIN f b ON a.e < b.e""")
def pairwise_overlap(t):
    """Shared ids of all pairs of families, pairs that share none too."""
    u = t("events").filter("user_id % 3 <> 0 OR event_id % 3 = 0").select(F.concat_ws("/", "event_type", (F.col("event_id") % 3).cast("string")).alias("e"), "user_id")
    return overlap.pairwise_overlap(u, "e", "user_id")


@query("""WITH u AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1), f AS (SELECT count(DISTINCT event_type) AS n FROM events) SELECT f.n AS n_families, count(*) AS n_any, count(*) FILTER (WHERE u.n = f.n) AS n_all FROM u, f GROUP BY f.n""")
def common_ids(t):
    """Ids in any family and ids in all."""
    return overlap.common_ids(t("events"), "event_type", "user_id")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(abs(l_tax - l_discount)), 8) AS mae, round(sqrt(avg((l_tax - l_discount) ** 2)), 8) AS rmse, round(corr(l_tax, l_discount), 6) AS r,
count(*) FILTER (WHERE l_tax IS DISTINCT FROM l_discount) AS n_mismatch, round(avg(CASE WHEN abs(l_tax - l_discount) <= 0.005 THEN 1.0 ELSE 0.0 END), 6) AS within,
round(avg(CASE WHEN abs(l_tax - l_discount) <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS within1, round(avg(CASE WHEN abs(l_tax - l_discount) <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within2,
arg_max(l_orderkey, {'d': abs(l_tax - l_discount), 'k': l_orderkey}) AS worst_at FROM lineitem GROUP BY ALL""")
def source_compare(t):
    return profile.compare_sources(t("lineitem"), "l_tax", "l_discount", ["l_returnflag"], "l_orderkey")


@query("""SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_tax IS DISTINCT FROM CAST(CAST(l_tax AS FLOAT) AS DOUBLE)) AS n_changed FROM lineitem GROUP BY ALL""")
def roundtrip_compare(t):
    back = F.col("l_tax").cast("float").cast("double")
    return t("lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("l_tax").eqNullSafe(back)).alias("n_changed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(log2(least(greatest(l_discount, 1e-6), 1 - 1e-6) / (1 - least(greatest(l_discount, 1e-6), 1 - 1e-6))), 6) AS m FROM lineitem""")
def m_value(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scores.m_value(F.col("l_discount")), 6).alias("m"))


_EMB = "e AS (SELECT label AS segment, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
_POOL = {"sum": "sum(CAST(v AS DOUBLE))", "mean": "avg(CAST(v AS DOUBLE))", "sqrt_sum": "sum(CAST(v AS DOUBLE)) / sqrt(count(v))", "max": "max(CAST(v AS DOUBLE))"}


def _pool(how):
    def run(t):
        v = t("embeddings").select(F.col("label").alias("segment"), F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
        return segments.segment_pool(v, how).select("segment", "dim", F.round("pooled", 6).alias("pooled"), "present")

    run.__name__ = f"segment_pool_{how}"
    return run


for _how, _sql in _POOL.items():
    query(f"WITH {_EMB} SELECT segment, dim, round({_sql}, 6) AS pooled, count(v) > 0 AS present FROM e GROUP BY segment, dim")(_pool(_how))


@query("""WITH x AS (SELECT vec_id, label AS segment, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings), m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY segment)) AS e FROM x)
SELECT vec_id, segment, round(e / sum(e) OVER (PARTITION BY segment), 8) AS p FROM m""")
def segment_softmax(t):
    v = t("embeddings").select("vec_id", F.col("label").alias("segment"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return segments.segment_softmax(v).select("vec_id", "segment", F.round("p", 8).alias("p"))


@query("""SELECT round(coalesce(avg(CASE WHEN abs(quality - toxic - 0.25) <= 1 THEN 0.5 * (quality - toxic - 0.25) ** 2 ELSE abs(quality - toxic - 0.25) - 0.5 END), 0), 8) AS loss FROM labels""")
def masked_huber(t):
    e = F.col("quality") - F.col("toxic") - 0.25
    return t("labels").agg(F.round(scores.masked_mean(scores.huber(e), e.isNotNull()), 8).alias("loss"))


@query("""WITH n AS (SELECT c_mktsegment, greatest(count(*), 1) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n""")
def class_weights(t):
    return scores.class_weights(t("customer"), "c_mktsegment", t("customer"))


@query("""SELECT round(sum(CASE WHEN a.quality > b.quality THEN 1.0 WHEN a.quality = b.quality THEN 0.5 ELSE 0 END) / count(*), 8) AS auroc FROM labels a JOIN labels b ON a.toxic = 1 AND b.toxic = 0""")
def auroc(t):
    return scores.auroc(t("labels"), "quality", "toxic")


@query("""WITH g AS (SELECT quality AS s, sum(toxic) AS pos, count(*) AS n FROM labels GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g)
SELECT round(sum(pos * tp / seen) / sum(pos), 8) AS average_precision FROM c""")
def average_precision(t):
    return scores.average_precision(t("labels"), "quality", "toxic")


@query("""WITH k AS (SELECT DISTINCT quality AS cls FROM labels UNION SELECT DISTINCT toxic FROM labels), c AS (SELECT cls, (SELECT count(*) FROM labels WHERE quality = cls) AS support,
(SELECT count(*) FROM labels WHERE quality = cls AND toxic = cls) AS tp, (SELECT count(*) FROM labels WHERE toxic = cls) AS said FROM k)
SELECT cls, support, round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 6) AS "precision", round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
round(CASE WHEN support + said > 0 THEN 2.0 * tp / (support + said) ELSE 0 END, 6) AS f1 FROM c""")
def confusion_f1(t):
    lab = t("labels")
    classes = lab.select(F.col("quality").alias("cls")).union(lab.select("toxic")).distinct()
    return scores.class_report(lab, "quality", "toxic", classes)


@query("""SELECT lang, count(*) AS n, round(avg(abs(quality - toxic)), 6) AS mae FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def metrics_by_group(t):
    return t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("quality") - F.col("toxic"))), 6).alias("mae"))


@query("""SELECT l_suppkey, count(DISTINCT l_returnflag) AS n_roles FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def split_leakage(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("n_roles")).filter("n_roles > 1")


@query("""SELECT p_type, n, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 15)""")
def ontology_min_n(t):
    kept = t("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")
    return numbered(kept, [F.col("p_type")], "id")


@query("""WITH o AS (SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY 1) SELECT c_custkey, coalesce(price, c_acctbal) AS label, price IS NOT NULL AS has_price FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def label_cascade(t):
    o = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    j = t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("price", "c_acctbal").alias("label"), F.col("price").isNotNull().alias("has_price"))


@query("""SELECT c_custkey, regexp_replace(trim(c_name || '_TC21'), '_[A-Z]{2}[0-9]{2}$', '') AS core, split_part(c_name || '.3', '.', 1) AS bare FROM customer""")
def regex_ids(t):
    return t("customer").select("c_custkey", text.probe_stem(F.concat("c_name", F.lit("_TC21"))).alias("core"), text.strip_version(F.concat("c_name", F.lit(".3"))).alias("bare"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH g AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM g WHERE gap > 0) SELECT user_id, round(avg(gap) / 1e6, 4) AS gap_s FROM r WHERE rn <= 5 GROUP BY user_id""")
def eta_last5(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t("events").withColumn("gap", us - F.lag(us).over(w)).filter("gap > 0")
    last = g.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 5")
    return last.groupBy("user_id").agg(F.round(F.avg("gap") / 1e6, 4).alias("gap_s"))


@query("""SELECT 'both' AS part, c_custkey AS id FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'none', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_ops(t):
    c, o = t("customer").select(F.col("c_custkey").alias("id")), t("orders").select(F.col("o_custkey").alias("id"))
    return c.intersect(o).select(F.lit("both").alias("part"), "id").union(c.subtract(o).select(F.lit("none"), "id"))


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer""")
def semi_anti(t):
    c, on = t("customer"), F.col("o_custkey") == F.col("c_custkey")
    o = t("orders").select("o_custkey")
    return c.join(o, on, "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).union(c.join(o, on, "left_anti").select("c_custkey", F.lit(False)))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def last_per_key_upsert(t):
    return intervals.first_by(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(t):
    from ..streaming.monitor import windowed_counts

    return windowed_counts(t("events"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT o_custkey, (place // 4)::INT AS piece, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS items, count(*) AS n FROM r GROUP BY 1, 2""")
def ordered_pieces(t):
    """Each customer's orders as one ordered list, in pieces of four."""
    lists = ordered_lists(t("orders"), ["o_custkey"], "o_orderkey", piece=4)
    return lists.select("o_custkey", "piece", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n"))
