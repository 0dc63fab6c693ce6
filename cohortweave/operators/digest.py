"""Digest of a table as a multiset: the sum of its rows' hashes, which partitions add up in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType

LANES = 8  # of 16 bits: their sums fit a long for 2^47 rows


def row_text(df: DataFrame, cols: list[str]) -> Column:
    """A row's fields, each with its type, length and text, or its type and `null`: rows that differ in any field differ in this.

    Nested fields are their JSON, nulls kept.
    """
    parts = []
    for c in cols:
        kind, v = df.schema[c].dataType, F.col(f"`{c}`")
        s = F.hex(v) if isinstance(kind, BinaryType) else v.cast("string") if isinstance(kind, AtomicType) else F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
        tag = kind.simpleString()
        parts.append(F.when(v.isNull(), F.lit(f"{tag} null;")).otherwise(F.concat(F.lit(f"{tag} "), F.length(s).cast("string"), F.lit(":"), s, F.lit(";"))))
    return F.concat(*parts)


def table_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: n, and digest, the sum of the rows' 128-bit hashes modulo 2^128 as 32 hex digits.

    Order does not matter, repeated rows count each time, and a null or a value in another column or of another type is another
    row. An empty table has 0 and zeros. Each task sums its own rows; only sums move.
    """
    h = F.md5(row_text(df, cols).cast("binary"))
    lane = lambda i: F.conv(F.substring("h", 29 - 4 * i, 4), 16, 10).cast("long")
    sums = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"s{i}") for i in range(LANES)])
    carried = sums
    for i in range(1, LANES):
        carried = carried.withColumn(f"s{i}", F.col(f"s{i}") + F.shiftright(f"s{i - 1}", 16))
    digits = [F.lpad(F.lower(F.hex(F.col(f"s{i}").bitwiseAND(0xFFFF))), 4, "0") for i in reversed(range(LANES))]
    return carried.select("n", F.concat(*digits).alias("digest"))
