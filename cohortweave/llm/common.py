"""Column helpers and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import release, settle, shared_dir, written  # noqa: F401  used by the operators here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_SPACE = " \t\n\x0b\x0c\r"
_NOT_WORD = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Only A-Z; every other letter keeps its case."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Lower-cased runs of digits, a-z and non-ASCII characters."""
    spaced = F.translate(c, UPPER + _NOT_WORD, LOWER + " " * len(_NOT_WORD))
    return F.array_remove(F.split(spaced, " "), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast where a count proves at most max_rows; else leave the shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
