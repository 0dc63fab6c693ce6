"""Other text tables: sample sheets, association lists, trait matrices, epoch logs; and the tables they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import id_list, parse_measure
from ..operators.checks import require_columns
from ..operators.intervals import first_by
from .packs import read_zip_lines

NUMERIC_FAMILIES = ("age", "bmi")
SHEET = ("sample_id", "study_id", "platform", "sample_type", "sex", "phenotype_value", "tissue", "disease", "age", "bmi", "race", "cell_component")
#: Fields of a sample that may be shown outside; all others stay in.
SAFE_FIELDS = ("sample_id", "study_id", "platform", "tissue", "sex", "age")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A space-separated, quoted sheet whose header lacks the row-name column: all strings, NA and NaN null, row names dropped.

    The header is read alone, as the reader would otherwise cut each row to the header's width. Of a zip, the first .txt member
    is the sheet.
    """
    zipped = path.lower().endswith(".zip")
    lines = read_zip_lines(spark, path).filter("value <> ''") if zipped else spark.read.text(path).filter("value <> ''")
    names = _header(lines)
    schema = ", ".join(["_row string", *[f"`{n}` string" for n in names]])
    how = {"sep": " ", "quote": '"'}
    rows = lines.select(F.from_csv("value", schema, how).alias("r")).select("r.*") if zipped else spark.read.schema(schema).options(**how).csv(path)
    body = rows.filter(~F.col("_row").eqNullSafe(names[0]))
    return body.select(*[F.when(~F.col(f"`{n}`").isin("NA", "NaN"), F.col(f"`{n}`")).alias(n) for n in names])


def _header(lines: DataFrame) -> list[str]:
    first = lines.limit(1).first()
    return [x.strip('"') for x in first.value.split(" ")]


def normalised_sheet(sheet: DataFrame, family: str, value_col: str, source: str) -> DataFrame:
    """The sheet under common names: project_id is study_id, the family's column phenotype_value, with a number for age and bmi."""
    require_columns(sheet, ["sample_id", value_col])
    renamed = sheet.withColumnRenamed(value_col, "phenotype_value")
    if "study_id" not in renamed.columns:
        renamed = renamed.withColumnRenamed("project_id", "study_id")
    out = renamed.select(*[c for c in SHEET if c in renamed.columns], F.lit(family).alias("phenotype_family"), F.lit(source).alias("source_file"))
    return out.withColumn("phenotype_value_numeric", parse_measure(F.col("phenotype_value"))) if family in NUMERIC_FAMILIES else out


def safe_fields(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in SAFE_FIELDS if c in rows.columns])


def read_associations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a Latin-1 table, all strings. Lines with another number of fields than the header are kept where they are
    short, cut where they are long, and counted: n_lines, n_malformed."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="ISO-8859-1", mode="PERMISSIVE", quote="")
    width = len(rows.columns)
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).filter("value <> ''")
    n = lines.agg((F.count(F.lit(1)) - 1).alias("n_lines"), F.count_if(F.size(F.split("value", "\t", -1)) != width).alias("n_malformed"))
    return rows, n


def read_square(spark: SparkSession, path: str) -> DataFrame:
    """A square table with names on both sides as (row_name, col_name, value); missing cells fall out."""
    wide = spark.read.csv(path, sep="\t", header=True)
    key, *names = wide.columns
    long = wide.select(F.col(f"`{key}`").alias("row_name"), *[F.col(f"`{n}`") for n in names]).unpivot(["row_name"], [F.col(f"`{n}`") for n in names], "col_name", "raw")
    return long.select("row_name", "col_name", parse_measure(F.col("raw")).alias("value")).filter("value IS NOT NULL")


def number_of(log: DataFrame, *names: str) -> Column:
    """The first of several names that a log has and that holds a value; text that is no number is null."""
    have = [F.col(n) for n in names if n in log.columns]
    return F.coalesce(*have).cast("string").try_cast("double") if have else F.lit(None).cast("double")


def parse_epochs(lines: DataFrame, also: list[str] = ()) -> DataFrame:
    """JSON lines (column value) as epochs, with aliases of F1 and learning rate and the columns `also` of lines; broken lines, other
    values and rows without an epoch fall out."""
    keys = ("epoch", "train_loss", "val_loss", "train_macro_f1", "train_f1", "val_macro_f1", "val_f1", "learning_rate", "lr", "task")
    log = lines.filter(F.col("value").rlike(r"^\s*\{")).select(*also, F.from_json("value", ", ".join(f"{k} string" for k in keys)).alias("j")).filter("j IS NOT NULL").select(*also, "j.*")
    n = lambda *names: number_of(log, *names)
    out = log.select(
        *also, F.col("epoch").try_cast("int").alias("epoch"), n("train_loss").alias("train_loss"), n("val_loss").alias("val_loss"), n("train_macro_f1", "train_f1").alias("train_f1"),
        n("val_macro_f1", "val_f1").alias("val_f1"), n("learning_rate", "lr").alias("learning_rate"), "task",
    )
    return out.filter("epoch IS NOT NULL")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in, a row for each key: the new one where both have it, the last of `seq` where the new repeat it."""
    new = first_by(rows, [key], [F.desc("seq")]).drop("seq")
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(table.columns))


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """Parquet with just the contract's columns, which must all be there; replaces what was there."""
    require_columns(df, columns).select(*columns).write.mode("overwrite").parquet(path)


def write_index(df: DataFrame, path: str, columns: list[str], place: str, n: int) -> None:
    """write_table for an index whose place column must be 0..n-1 without gaps."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(place).alias("d"), F.min(place).alias("lo"), F.max(place).alias("hi")).first()
    if (s.n, s.d) != (n, n) or (n and (s.lo, s.hi) != (0, n - 1)):
        raise ValueError(f"{place} must be 0..{n - 1}, found {s.n} rows from {s.lo} to {s.hi}")
    write_table(df, path, columns)


#: Columns that a sample phenotype table must have.
PHENOTYPES = ("sample_id", "source_sample_id", "study_id", "source_system", "phenotype_family", "matrix_id", "row_index", "age_mask", "tissue_mask")


def write_phenotypes(df: DataFrame, path: str) -> None:
    """The label table with all its columns, of which PHENOTYPES must be there."""
    require_columns(df, list(PHENOTYPES)).write.mode("overwrite").parquet(path)


def registry_rows(entries: DataFrame) -> DataFrame:
    """Registry entries with their study ids as one sorted, comma-joined text."""
    return entries.withColumn("study_ids", F.array_join(F.array_sort(id_list(F.col("study_ids"))), ","))


def select_entries(entries: DataFrame, **wanted: str) -> DataFrame:
    """Entries that hold every wanted value (family, role, source)."""
    for c, v in wanted.items():
        entries = entries.filter(F.col(c) == v)
    return entries
