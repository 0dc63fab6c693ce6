"""Ranks, overlaps, stored vectors, units, heads, splits and ordered lists on small hostile tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortweave.functions import scores
from cohortweave.operators import ordered, overlap, profile, ranks, scorers, splits
from cohortweave.sources import tables, vectors


def median(xs):
    xs = sorted(x for x in xs if x is not None and x == x)
    return None if not xs else (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


def spreads():
    r = random.Random(3)
    yield "even", [r.random() for _ in range(3001)]
    yield "one value", [2.5] * 2000
    yield "two values", [1.0] * 1000 + [2.0] * 1000
    yield "powers", [10.0 ** r.randint(-300, 300) for _ in range(2500)]
    yield "holes", [None, float("nan")] * 500 + [float(i % 7) for i in range(1501)]
    yield "endless", [float("-inf")] * 900 + [float("inf")] * 1000 + [0.0]
    yield "none", [None, None]


@pytest.mark.parametrize("xs", [pytest.param(x, id=n) for n, x in spreads()])
def test_medians_by_rank_selection(spark, xs):
    df = spark.createDataFrame([(x, 1.0) for x in xs], "x double, one double").repartition(3)
    got = ranks.medians(df, ["x", "one"], bucket=100)
    assert got == {"x": median(xs), "one": 1.0}
    assert ranks.medians(df, ["x"])["x"] == median(xs)


def test_every_rank_is_found(spark):
    r = random.Random(5)
    xs = sorted([r.gauss(0, 1) for _ in range(900)] + [0.5] * 300)
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(4).cache()
    for rank in (0, 1, 17, 600, 700, 1198, 1199):
        assert ranks.value_at(df, "x", rank, len(xs), bucket=20) == xs[rank]


def test_overlap_of_many_families(spark):
    r = random.Random(2)
    names = [f"f{i:03}" for i in range(130)]
    rows = [(r.choice(names), r.choice([None, *range(40)])) for _ in range(1500)] + [(n, 1000 + i) for i, n in enumerate(names)] + [(None, 3)]
    sets = {n: {k for f, k in rows if f == n and k is not None} for n in names}
    df = spark.createDataFrame(rows, "f string, k long")
    got = {(x.a, x.b): x.n for x in overlap.pairwise_overlap(df, "f", "k").collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in names for b in names if a < b}
    one = overlap.common_ids(df, "f", "k").first()
    assert (one.n_families, one.n_any, one.n_all) == (130, len(set().union(*sets.values())), len(set.intersection(*sets.values())))
    assert overlap.pairwise_overlap(df.limit(0), "f", "k").collect() == []
    with pytest.raises(ValueError, match="families"):
        overlap.families_of(df, "f", most=5)


def test_an_id_moves_once(spark):
    df = spark.range(0, 30000, numPartitions=3).select(F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("f"), F.lit(7).alias("k"))
    plan = overlap.membership_patterns(df, "f", "k", [f"f{i}" for i in range(5)])
    assert "partial_bit_or" in plan._jdf.queryExecution().executedPlan().toString()
    assert [(tuple(r.pattern), r.n) for r in plan.collect()] == [((0, 1, 2, 3, 4), 1)]


def test_vectors_are_found_without_moving_them(spark, tmp_path):
    r = random.Random(1)
    rows = [(i * 3, [r.random() for _ in range(4)]) for i in range(500)]
    path = f"{tmp_path}/store"
    spark.sql("DROP TABLE IF EXISTS vec_a")
    vectors.write_vectors(spark.createDataFrame(rows, "locus_id long, vector array<double>"), path, "vec_a", width=4, buckets=8)
    spark.sql("DROP TABLE vec_a")
    store = vectors.open_vectors(spark, path, "vec_b")
    back = {x.locus_id: x.vector for x in store.collect()}
    assert len(back) == 500 and all(abs(a - b) < 1e-7 for k, v in rows for a, b in zip(v, back[k]))
    assert [(x.embedding_row, x.locus_id) for x in vectors.read_index(spark, path).orderBy("embedding_row").collect()] == [(i, i * 3) for i in range(500)]
    asked = spark.range(0, 60).select(F.col("id").alias("col_index"), F.col("id").alias("locus_id"))
    out = vectors.vectors_of(asked, store)
    plan = out._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("FileScan parquet") - 2000 if plan.rindex("FileScan parquet") > 2000 else 0 : plan.rindex("FileScan parquet")]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("FileScan parquet"), side
    got = {x.col_index: (x.valid, x.vector) for x in out.collect()}
    assert len(got) == 60 and got[3][0] and got[3][1] == back[3] and not got[4][0]
    spark.sql("DROP TABLE vec_b")


@pytest.mark.parametrize("rows, says", [([(1, [1.0]), (1, [1.0])], "repeat"), ([(None, [1.0])], "repeat"), ([(1, [1.0, 2.0])], "finite"), ([(1, [math.inf])], "finite"), ([(1, [None])], "finite"), ([(1, None)], "finite")])
def test_vector_contract(spark, tmp_path, rows, says):
    with pytest.raises(ValueError, match=says):
        vectors.write_vectors(spark.createDataFrame(rows, "locus_id long, vector array<double>"), f"{tmp_path}/s", "vec_c", width=1)


def test_error_function(spark):
    xs = [i / 64 for i in range(-512, 513)] + [1e-300, -1e-9, 0.46875, 4.0, 26.5, -40.0, math.inf, -math.inf]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", scores.erf(F.col("x")).alias("e")).orderBy("i").collect()]
    assert max(abs(g - math.erf(x)) for g, x in zip(got, xs)) < 1e-14
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(scores.erf(F.col("x")).alias("e")).collect()
    assert odd[0].e is None and math.isnan(odd[1].e)


def test_network_units_and_norms(spark):
    layers = [([[1.0, -1.0], [0.5, 2.0]], [0.1, -0.3]), ([[1.0, 1.0]], [0.0])]
    x = spark.createDataFrame([(1, 0.4, -0.7)], "k int, a double, b double")
    z = [1.0 * 0.4 + 0.7 + 0.1, 0.2 - 1.4 - 0.3]
    unit = {"gelu": lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))), "leaky_relu": lambda v: v if v > 0 else 0.01 * v}
    for name, f in unit.items():
        got = scorers.network(x, ["k"], ["a", "b"], layers, activation=name, norm=False).first().y0
        assert abs(got - sum(map(f, z))) < 1e-12
    mean = sum(z) / 2
    normed = [(v - mean) / math.sqrt(sum((u - mean) ** 2 for u in z) / 2 + 1e-5) for v in z]
    assert abs(scorers.network(x, ["k"], ["a", "b"], layers).first().y0 - sum(map(unit["gelu"], normed))) < 1e-12
    with pytest.raises(ValueError, match="activation"):
        scorers.network(x, ["k"], ["a", "b"], layers, activation="tanh")


def test_pools_by_name(spark):
    items = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 0, 1.5), (1, 2, 0, 4.0)], "s int, r int, kind int, v double")
    one, read = ([[1.0]], [0.0]), ([[1.0]], [0.0])
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    want = {("max", "max"): 4.0, ("sum", "sum"): 6.0, ("mean", "mean"): 2.5, ("sqrt_sum", "sum"): 2 / math.sqrt(2) + 4, ("sum", "max"): 4.0}
    for (a, b), z in want.items():
        got = scorers.layered_score(items, ["s"], "r", "kind", ["v"], {0: [0.0]}, one, ([[1.0, 0.0]], [0.0]), read, a, b).first().score
        assert abs(got - sigmoid(z)) < 1e-12
    with pytest.raises(ValueError, match="pool"):
        scorers.flat_score(items, ["s"], ["v"], one, read, "median")


def test_head_with_bias_and_covariates(spark):
    s = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1), ("b", 2, 0.2)], "sample string, gene int, score double")
    w = spark.createDataFrame([(1, 0, 2.0, True), (2, 0, 5.0, False), (1, 1, -1.0, True), (2, 1, 1.0, True)], "gene int, output int, weight double, mask boolean")
    bias = spark.createDataFrame([(0, 0.5), (1, -0.5)], "output int, bias double")
    got = {(r.sample, r.output): round(r.value, 9) for r in scorers.linear_head(s, w, "sample", "gene", bias).collect()}
    assert got == {("a", 0): 1.3, ("a", 1): -1.3, ("b", 0): 0.5, ("b", 1): -0.8}
    cw = spark.createDataFrame([(0, "age", 0.1), (1, "age", 0.2), (0, "sex", 1.0), (1, "sex", 0.0)], "output int, name string, weight double")
    cov = spark.createDataFrame([("a", "age", 10.0), ("a", "sex", 1.0), ("b", "age", 20.0), ("b", "sex", 0.0)], "sample string, name string, x double")
    more = {(r.sample, r.output): round(r.value, 9) for r in scorers.linear_head(s, w, "sample", "gene", bias, cov, cw).collect()}
    assert more == {("a", 0): 3.3, ("a", 1): 0.7, ("b", 0): 2.5, ("b", 1): 3.2}
    with pytest.raises(ValueError, match="required"):
        scorers.linear_head(s, w, "sample", "gene", bias, None, cw)
    with pytest.raises(ValueError, match="without them"):
        scorers.linear_head(s, w, "sample", "gene", bias, cov)
    for wrong in (cov.filter("name = 'age'"), cov.unionByName(spark.createDataFrame([("a", "bmi", 1.0)], cov.schema)), cov.filter("sample = 'a'")):
        with pytest.raises(Exception, match="do not fit the head"):
            scorers.linear_head(s, w, "sample", "gene", bias, wrong, cw).collect()


def test_extremes_put_unknown_scores_last(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", float("nan")), ("c", None), ("d", 0.9)], "k string, mae double")
    got = [(r.side, r.k) for r in profile.extremes(df, "mae", "k", 2).collect()]
    assert got == [("best", "a"), ("best", "d"), ("worst", "d"), ("worst", "a")]


def test_grids_are_compared_without_a_grid(spark):
    cells = "s int, p int, beta double"
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (2, 1, 0.1), (9, 1, 0.3), (1, 8, 0.2), (3, 8, 0.1)], cells)
    b = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.7), (2, 2, 0.3), (3, 7, 0.2), (8, 3, 0.1)], cells)
    out = profile.compare_grids(a, b, "s", "p")
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.s: (r.n, r.n_a, r.n_b, r.n_one_side, r.n_neither, r.mae and round(r.mae, 9)) for r in out.collect()}
    assert got == {1: (2, 1, 2, 1, 0, 0.1), 2: (2, 1, 1, 2, 0, None), 3: (2, 0, 0, 0, 2, None)}


def test_ordered_lists_of_a_hot_key(spark):
    rows = [("hot", i * 7 % 1009) for i in range(1009)] + [("b", 2), ("b", 1), ("b", 2), ("c", None)]
    got = {}
    for r in ordered.ordered_lists(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], "v", piece=100).collect():
        got.setdefault(r.k, {})[r.piece] = r["items"]
    assert [len(got["hot"][i]) for i in range(11)] == [100] * 10 + [9] and got["b"] == {0: [1, 2, 2]} and "c" not in got
    assert [v for i in range(11) for v in got["hot"][i]] == list(range(1009))


def test_auto_split_fills_every_role(spark):
    sizes = {"a": 60, "b": 3, "c": 2, "d": 1, "e": 1}
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "sample_id string, study_id string")
    seen = set()
    for seed in range(4):
        roles = {r.study_id: r.role for r in splits.auto_split(df, seed).select("study_id", "role").distinct().collect()}
        assert set(roles) == set(sizes) and set(roles.values()) == set(splits.ROLES)
        assert roles == {r.study_id: r.role for r in splits.auto_split(df.orderBy(F.rand(seed)), seed).select("study_id", "role").distinct().collect()}
        seen.add(tuple(sorted(roles.items())))
    assert len(seen) > 1
    rows, by_role = splits.split_manifest(splits.auto_split(df, 7))
    assert rows.columns == ["split_id", "sample_id", "study_id", "platform", "group_id", "role"] and rows.count() == 67
    assert sum(r.n_samples for r in by_role.collect()) == 67 and by_role.count() == 3
    with pytest.raises(ValueError, match="stays empty"):
        splits.auto_split(df.filter("study_id < 'c'"))
    with pytest.raises(ValueError, match="two roles"):
        splits.split_manifest(df.withColumn("group_id", F.col("study_id")).withColumn("role", F.when(F.col("sample_id") == "a0", "train").otherwise("validation")))


def test_phenotype_table_contract(spark, tmp_path):
    cols = ", ".join(f"{c} string" for c in tables.PHENOTYPES)
    df = spark.createDataFrame([tuple("x" for _ in tables.PHENOTYPES)], cols).withColumn("more", F.lit(1))
    tables.write_phenotypes(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == [*tables.PHENOTYPES, "more"]
    with pytest.raises(KeyError, match="age_mask"):
        tables.write_phenotypes(df.drop("age_mask"), str(tmp_path / "q"))
