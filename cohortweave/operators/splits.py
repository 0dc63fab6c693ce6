"""Splits that keep a study, or a donor, on one side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import donor_of
from .checks import require_none, study_roles
from .storage import written

ROLES = ("train", "validation", "external_test")


def explicit_split(samples: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """samples with role by study and group_id (the study where there is none). A study in two roles, or in none, is an error."""
    pairs = [(s, r) for r, studies in roles.items() for s in sorted(set(studies))]
    if len({s for s, _ in pairs}) != len(pairs):
        raise ValueError("a study stands in two roles")
    table = samples.sparkSession.createDataFrame(pairs, "study_id string, role string")
    require_none(samples.join(table, "study_id", "left_anti"), "studies without a role", "study_id")
    group = F.coalesce("group_id", "study_id") if "group_id" in samples.columns else F.col("study_id")
    return samples.join(F.broadcast(table), "study_id").withColumn("group_id", group)  # table: a row per study


def auto_split(samples: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """samples with role and group_id, whole studies dealt by checks.study_roles: in the order of a seeded hash, by the share of rows before.

    A role that got no study takes the smallest (ties by id) of the role that has most. Fewer than three studies cannot fill the
    roles: an error. Studies are counted, ordered and dealt in the cluster; the driver sees a row per role.
    """
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError("shares of train and validation must leave a rest")
    dealt = written(study_roles(samples, "study_id", dict(zip(ROLES, (train, val, 1 - train - val))), seed).select("study_id", "n", "role"))
    held = {r.role: r["count"] for r in dealt.groupBy("role").count().collect()}
    if sum(held.values()) < len(ROLES):
        raise ValueError(f"a role stays empty with {sum(held.values())} studies")
    moved: dict[str, str] = {}
    for role in ROLES:
        if held.get(role, 0) == 0:
            giver = max(ROLES, key=lambda r: held.get(r, 0))
            left = dealt.filter((F.col("role") == giver) & ~F.col("study_id").isin(*moved))
            moved[left.orderBy("n", "study_id").first().study_id] = role
            held[giver], held[role] = held[giver] - 1, 1
    role = reduce(lambda c, s: F.when(F.col("study_id") == s, F.lit(moved[s])).otherwise(c), moved, F.col("role"))
    group = F.coalesce("group_id", "study_id") if "group_id" in samples.columns else F.col("study_id")
    return samples.join(dealt.select("study_id", role.alias("role")), "study_id").withColumn("group_id", group)


def split_manifest(split: DataFrame, split_id: str = "study-grouped-v1") -> tuple[DataFrame, DataFrame]:
    """(rows, roles) of samples with role and group_id: a row per sample under split_id, and per role its numbers of studies and samples.

    A study in two roles is an error. Roles without a study are there with zeros.
    """
    require_none(leaking(split), "studies in two roles", "study_id")
    platform = F.col("platform") if "platform" in split.columns else F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = split.select(F.lit(split_id).alias("split_id"), text("sample_id"), text("study_id"), platform.alias("platform"), text("group_id"), "role")
    names = split.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    n = rows.groupBy("role").agg(F.count_distinct("study_id").alias("n_studies"), F.count(F.lit(1)).alias("n_samples"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows, names.join(n, "role", "left").select(F.lit(split_id).alias("split_id"), "role", zero("n_studies"), zero("n_samples"))


def donor_split(samples: DataFrame, held: list[str], title: str = "title") -> DataFrame:
    """samples with donor (after the title's last underscore) and role; a held donor that no title names is an error."""
    d = samples.withColumn("donor", donor_of(F.col(title)))
    asked = samples.sparkSession.createDataFrame([(x,) for x in held], "donor string")
    require_none(asked.join(d.select("donor"), "donor", "left_anti"), "unknown donors", "donor")
    return d.withColumn("role", F.when(F.col("donor").isin(*held), "validation").otherwise("train"))


def leaking(split: DataFrame, group: str = "study_id") -> DataFrame:
    """Groups that stand in more than one role."""
    return split.groupBy(group).agg(F.count_distinct("role").alias("n_roles")).filter("n_roles > 1")
