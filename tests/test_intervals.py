"""Interval operators against plain Python, with wide intervals and keys over many tasks."""

import random

import pytest

from cohortweave.operators import intervals
from cohortweave.operators.ordered import numbered, running_sums


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_merge(spark, most):
    r = random.Random(3)
    rows = [(k, s, s + r.randint(0, 30)) for k in "ab" for s in (r.randint(0, 2000) for _ in range(120))] + [("c", 5, 9)]
    want = set()
    for k in "abc":
        run = None
        for s, e in sorted((s, e) for x, s, e in rows if x == k):
            if run and s <= run[1] + 1:
                run = (run[0], max(run[1], e))
            else:
                if run:
                    want.add((k, *run))
                run = (s, e)
        want.add((k, *run))
    got = intervals.merge_intervals(spark.createDataFrame(rows, "k string, start long, end long").repartition(7), "k", most=most)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_merge_with_missing_ends(spark, most):
    rows = [("a", None, None), ("a", 1, 5), ("a", 6, 9), ("a", 20, 22), ("a", None, None), ("b", None, None), ("c", 3, 4)]
    got = intervals.merge_intervals(spark.createDataFrame(rows, "k string, start long, end long").repartition(5), "k", most=most)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, 9), ("a", 20, 22), ("b", None, None), ("c", 3, 4)]


def test_points_in_narrow_and_wide_intervals(spark):
    r = random.Random(4)
    iv = [("x", s, s + w, i) for i, (s, w) in enumerate((r.randint(-500, 9000), r.choice([0, 3, 40, 900, 8000])) for _ in range(80))] + [("x", -(10**9), 10**9, 99), ("y", 0, 5, 100)]
    pts = [("x", p) for p in range(-600, 9500, 37)] + [("z", 1)]
    got = intervals.points_in_intervals(spark.createDataFrame(pts, "chrom string, pos long"), spark.createDataFrame(iv, "chrom string, start long, end long, i int"), slack=2, bin_width=8)
    want = sorted((p, i) for c, p in pts for d, s, e, i in iv if c == d and s - 2 <= p <= e + 2)
    assert sorted((x.pos, x.i) for x in got.collect()) == want


def test_running_sums_over_many_partitions(spark):
    d = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id % 13 AS v").repartition(9)
    got = {r.k: r.before_v for r in running_sums(d, [d.k], ["v"]).collect()}
    total, want = 0, {}
    for k, v in sorted((r.k, r.v) for r in d.collect()):
        want[k], total = total, total + v
    assert got == want
    assert [r.n for r in numbered(d, [d.k], "n", 1).orderBy("k").collect()] == list(range(1, 5001))
