"""Drop lines that many documents share, keep them in one document, reassemble by position."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ASCII_SPACE, UPPER, ascii_lower, text_of, written

_TO_LOWER = str.maketrans(UPPER, UPPER.lower())


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _digest(line: str) -> bytes:
    return hashlib.md5(line.strip(ASCII_SPACE).translate(_TO_LOWER).encode(), usedforsecurity=False).digest()


@pandas_udf(StructType([StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))
def _reassemble(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, n_lines, n_dropped = [], [], []
    for t, gone in zip(text, drops, strict=True):
        lines = t.split("\n")
        n_lines.append(len(lines))
        if gone is not None and len(gone):
            gone = {bytes(h) for h in gone}
            lines = [x for x in lines if _digest(x) not in gone]
        kept.append("\n".join(lines))
        n_dropped.append(n_lines[-1] - len(lines))
    return pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: row (all its columns), text (kept lines), n_lines, n_dropped.

    Keys (128-bit hashes of the normalised lines) under min_chars code points are never dropped. A key that at least
    min_docs different documents hold stays, with all its lines, in the largest doc_id only. Rows that repeat a doc_id are
    one document and lose a key alike, each from its own text; rows without a doc_id are told apart by their text and are
    below all others. Null or empty text is one empty line. Documents of a key are counted distinct, first within
    (key, document), so a hot line spreads before it is summed; the shared keys are written, which lets AQE split a hot one
    in the join. Rows move once, to meet their dropped keys.
    """
    text = text_of()
    tag = F.when(F.col("doc_id").isNull(), F.xxhash64(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id"), tag.alias("tag")).alias("who"))
    lines = F.filter(F.transform(F.split(F.coalesce("row.text", F.lit("")), "\n", -1), line_key), lambda k: F.length(k) >= min_chars)
    keys = d.select("who", F.explode(F.array_distinct(F.transform(lines, lambda k: F.unhex(F.md5(k.cast("binary")))))).alias("h"))
    shared = written(keys.groupBy("h").agg(F.count_distinct("who").alias("n"), F.max("who").alias("holder")).filter(F.col("n") >= min_docs).select("h", "holder"))
    drops = keys.join(shared, "h").filter("who <> holder").groupBy("who").agg(F.collect_set("h").alias("drops"))
    both = d.alias("d").join(drops.alias("x"), F.expr("d.who = x.who"), "left")
    return both.select("row", _reassemble(F.coalesce("row.text", F.lit("")), "drops").alias("new")).select("row", "new.*")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, text (kept lines), n_lines, n_dropped; see shared_lines."""
    return shared_lines(docs, min_chars, min_docs).select("row.doc_id", "text", "n_lines", "n_dropped")
