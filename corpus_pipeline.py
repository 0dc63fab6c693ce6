"""Five stages from documents to a mixed training set; each reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm.common import bounded_broadcast, release, table, text_of, written
from cohortweave.llm.dart_minhash import near_duplicates
from cohortweave.llm.line_dedup import shared_lines
from cohortweave.llm.mixing import mixed_rows
from cohortweave.llm.toxicity import score_toxicity
from cohortweave.llm.winnowing import decontaminate

ORACLE_SQL = None  # a fitted classifier and a hashed draw are not SQL; tests hold the stages against plain Python

MAX_BROADCAST_KEYS = 1_000_000


def _digest() -> Column:
    return F.unhex(F.md5(text_of().cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) under these names alone, whatever else docs holds."""
    return docs.select("doc_id", text_of().alias("text"), _digest().alias("digest"))


def _without(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of docs whose text has none of the digests; decisions are functions of the text, so null and repeated ids do no harm."""
    gone = bounded_broadcast(written(digests.distinct()), MAX_BROADCAST_KEYS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest().alias("digest"))
    return rows.join(gone, "digest", "left_anti").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is predicted toxic go. Null text is scored as empty; an empty table stays empty."""
    scored = score_toxicity(_texts(docs), table(spark, sf_dir, "labels"), carry=("digest",))
    return _without(docs, scored.filter("predicted = 1").select("digest"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept lines become the text, with n_chars (where there is one) to match; a document whose lines all went stays, empty.

    A row that loses nothing keeps its text as it is, null too.
    """
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return shared_lines(docs).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row of the smallest doc_id stays, rows without one last; of equal rows one stays.

    Rows are written once with a key of their own, so null and repeated ids are told apart.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    classes = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("key"), "class_id")
    several = written(classes.join(classes.groupBy("class_id").count().filter("count > 1").select("class_id"), "class_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    ids = several.join(keyed.select("key", F.col("row.doc_id").alias("doc_id")), "key")
    stay = ids.groupBy("class_id").agg(F.min(rank).alias("m")).select(F.col("m.key").alias("key"))
    gone = written(several.select("key").join(stay, "key", "left_anti"))
    return keyed.join(bounded_broadcast(gone, MAX_BROADCAST_KEYS), "key", "left_anti").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null text and an empty benchmark have none."""
    texts = docs.select(_digest().alias("doc_id"), text_of().alias("text"))
    hits = decontaminate(texts, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.filter("contaminated").select(F.col("doc_id").alias("digest")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents, a row each, with their topic, weight ratio, probability and how often to read them as mix_topic, mix_ratio,
    mix_prob and mix_copies, in place of any such columns."""
    new = {"mix_topic": "topic", "mix_ratio": "ratio", "mix_prob": "prob", "mix_copies": "copies"}
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return mixed_rows(docs).filter("selected").select(*kept, *[F.col(c).alias(name) for name, c in new.items()])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's table is deleted once its successor's is written."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        release(*spent)
        spent = [docs]
    return docs
