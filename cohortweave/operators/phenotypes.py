"""Sample labels: per-row extraction, one unified table from several label sources, merges, ontologies and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare, first_number, label_or_control, platform_name, sex_label, word_label
from .checks import require, require_none
from .intervals import first_by
from .loci import many_to_one
from .ordered import numbered

#: The two sexes and their class ids.
SEX_IDS = {"Female": 0, "Male": 1}


def ontology(labels: DataFrame, col: str, min_n: int) -> DataFrame:
    """(label, class_id): labels with at least min_n rows, in order, ids from 0; none is an error."""
    n = labels.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    return numbered(require(n.select("label"), f"no label has {min_n} rows"), [F.col("label")], "class_id")


def sex_ontology(spark) -> DataFrame:
    return spark.createDataFrame(list(SEX_IDS.items()), "label string, class_id int")


def row_labels(rows: DataFrame, sex_source: bool = False) -> DataFrame:
    """sample_id, study_id, platform, age, tissue, sex of one source; sample_id must be unique.

    Age is the first number of phenotype_value_numeric and age. Tissue is the first text of phenotype_value and tissue that is no
    number. Sex comes from phenotype_value only in a sex source, else from sex alone, as other sources hold other values there.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    sex = has("phenotype_value") if sex_source and "phenotype_value" in rows.columns else has("sex")
    tissue = F.lit(None).cast("string") if sex_source else F.coalesce(word_label(has("phenotype_value")), word_label(has("tissue")))
    study = F.nullif(bare(F.coalesce(has("study_id"), has("project_id"))), F.lit(""))
    return rows.select("sample_id", study.alias("study_id"), has("platform").alias("platform"),
        first_number(has("phenotype_value_numeric"), has("age")).alias("age"), tissue.alias("tissue"), sex_label(sex).alias("sex"))


def unified_table(index: DataFrame, age: DataFrame, tissue: DataFrame, sex: DataFrame, tissues: DataFrame) -> DataFrame:
    """One row per sample of index (row_index, sample_id) with labels, class ids and masks.

    Sources are row_labels frames. Each label has its own order of sources: age from age, tissue, sex; tissue from tissue, age, sex; sex from sex,
    age, tissue. Study and platform come from the first source that has them. A tissue outside the ontology is no
    label. A sample without a study, or without any label, fails the job.
    """
    joined = index
    for name, rows in (("age", age), ("tissue", tissue), ("sex", sex)):
        joined = many_to_one(joined, rows.select("sample_id", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "sample_id"]), ["sample_id"], "left")
    first = lambda c, *order: F.coalesce(*[F.col(f"{s}_{c}") for s in order])
    t = joined.select(
        "row_index", "sample_id", first("study_id", "age", "tissue", "sex").alias("study_id"), platform_name(first("platform", "age", "tissue", "sex")).alias("platform_id"),
        first("age", "age", "tissue", "sex").alias("age_years"), first("tissue", "tissue", "age", "sex").alias("label"), first("sex", "sex", "age", "tissue").alias("sex_label"),
    )
    t = t.join(F.broadcast(tissues.select("label", F.col("class_id").alias("tissue_class_id"))), "label", "left")  # a row per class
    known = F.col("tissue_class_id").isNotNull()
    sex_ids = F.create_map(*[F.lit(x) for kv in SEX_IDS.items() for x in kv])
    t = t.select(
        "row_index", "sample_id", "study_id", "platform_id", "age_years", F.col("age_years").isNotNull().alias("age_mask"),
        F.when(known, F.col("label")).alias("tissue_label"), "tissue_class_id", known.alias("tissue_mask"),
        "sex_label", F.try_element_at(sex_ids, F.col("sex_label")).alias("sex_class_id"), F.col("sex_label").isNotNull().alias("sex_mask"),
    )
    n = sum((F.col(m).cast("int") for m in ("tissue_mask", "sex_mask")), F.col("age_mask").cast("int"))
    family = F.when(n > 1, "multi").when(F.col("age_mask"), "age").when(F.col("tissue_mask"), "tissue").when(F.col("sex_mask"), "sex")
    fault = F.when(F.col("study_id").isNull(), F.raise_error(F.concat(F.lit("no study for sample "), F.col("sample_id")))).when(
        n == 0, F.raise_error(F.concat(F.lit("no label for sample "), F.col("sample_id"))))
    return t.withColumn("phenotype_family", F.coalesce(fault, family))


def consistency_faults(table: DataFrame, tissues: DataFrame) -> DataFrame:
    """(check_name, n_bad): a mask without its label, a label without its mask, a class id that is not the label's, repeated samples."""
    ids = table.join(F.broadcast(tissues.select(F.col("label").alias("tissue_label"), F.col("class_id").alias("want"))), "tissue_label", "left")
    bad = {
        "age_mask": F.col("age_mask") != F.col("age_years").isNotNull(),
        "tissue_mask": F.col("tissue_mask") != F.col("tissue_label").isNotNull(),
        "tissue_id": F.col("tissue_mask") & ~F.col("tissue_class_id").eqNullSafe(F.col("want")),
        "sex_mask": F.col("sex_mask") != F.col("sex_label").isNotNull(),
    }
    once = ids.agg(*[F.count_if(c).alias(k) for k, c in bad.items()], (F.count(F.lit(1)) - F.count_distinct("sample_id")).alias("repeated"))
    return once.unpivot([], [*bad, "repeated"], "check_name", "n_bad")


def family_labels(index: DataFrame, rows: DataFrame, col: str, empty_as_control: bool = False) -> DataFrame:
    """index with label and its dense class_id; a sample without a label fails the job."""
    text = many_to_one(index, rows.select("sample_id", label_or_control(F.col(col), empty_as_control).alias("label")), ["sample_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no label for sample "), F.col("sample_id")))
    named = text.withColumn("label", F.coalesce("label", missing))
    return named.join(F.broadcast(ontology(named, "label", 1)), "label")


def family_numbers(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with y, the sample's number, else its age; a sample without one fails the job."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    y = many_to_one(index, rows.select("sample_id", first_number(has("phenotype_value_numeric"), has("age")).alias("y")), ["sample_id"], "left")
    return y.withColumn("y", F.coalesce("y", F.raise_error(F.concat(F.lit("no number for sample "), F.col("sample_id")))))


def relabelled(rows: DataFrame, sidecar: DataFrame, key: str, col: str) -> DataFrame:
    """rows with `col` taken from the sidecar; a row that the sidecar lacks fails the job."""
    new = many_to_one(rows.drop(col), sidecar.select(key, F.col(col).alias("_new")), [key], "left")
    return new.select(*[c for c in rows.columns if c != col], F.coalesce("_new", F.raise_error(F.concat(F.lit("no sidecar row for "), F.col(key).cast("string")))).alias(col))


def first_seen_union(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Each key once, from the first source that has it, numbered by source and place: priority, new_index.

    sources share their columns; `order` is the place of a row in its source. The count of rows that fell out is union_counts'.
    """
    tagged = [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources)]
    kept = first_by(reduce(DataFrame.unionByName, tagged), [key], [F.col("priority"), F.col(order)])
    return numbered(kept, [F.col("priority"), F.col(order), F.col(key)], "new_index")


def union_counts(sources: list[DataFrame], merged: DataFrame) -> DataFrame:
    """n_in, n_out, n_deduped."""
    n_in = reduce(DataFrame.unionAll, [s.agg(F.count(F.lit(1)).alias("n")) for s in sources]).agg(F.sum("n").alias("n_in"))
    both = n_in.crossJoin(merged.agg(F.count(F.lit(1)).alias("n_out")))  # a row each
    return both.select("n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("n_deduped"))


def studies_of(rows: DataFrame) -> DataFrame:
    """Sorted distinct study ids: study_id, else project_id; blanks and `nan` are none."""
    has = [F.nullif(bare(F.col(c).cast("string")), F.lit("")) for c in ("study_id", "project_id") if c in rows.columns]
    study = F.coalesce(*has)
    return rows.select(study.alias("study_id")).filter("study_id IS NOT NULL AND lower(study_id) <> 'nan'").distinct()


def cohort(rows: DataFrame, studies: list[str], per_study: int) -> DataFrame:
    """The first per_study samples by name of each asked study, in the order asked (row_index). A repeated or absent study is an error."""
    if len(set(studies)) != len(studies):
        raise ValueError("a study is asked twice")
    asked = rows.sparkSession.createDataFrame(list(enumerate(studies)), "place int, study_id string")
    require_none(asked.join(rows.select("study_id").distinct(), "study_id", "left_anti"), "studies without samples", "study_id")
    own = rows.join(F.broadcast(asked), "study_id")
    top = own.withColumn("n", F.row_number().over(Window.partitionBy("study_id").orderBy("sample_id"))).filter(F.col("n") <= per_study)
    return numbered(top, [F.col("place"), F.col("sample_id")], "row_index").drop("n", "place")
