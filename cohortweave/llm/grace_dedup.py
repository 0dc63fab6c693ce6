"""Grace hash deduplication on complete content."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of


class ContentTable:
    """Open addressing with linear probing; a slot is taken only by equal complete content."""

    def __init__(self, slots: int = 1024):
        self.slot = np.full(slots, -1, np.int64)
        self.rows: list[list] = []  # hash, text, largest id, count
        self.bytes = 0

    def _find(self, h: int, text: str) -> int:
        mask = len(self.slot) - 1
        i = (h ^ (h >> 29)) & mask
        while (at := self.slot[i]) >= 0 and not (self.rows[at][0] == h and self.rows[at][1] == text):
            i = (i + 1) & mask
        return i

    def add(self, h: int, text: str, top, n: int) -> None:
        i = self._find(h, text)
        if (at := self.slot[i]) >= 0:
            row = self.rows[at]
            row[2] = top if row[2] is None else row[2] if top is None else max(row[2], top)
            row[3] += n
            return
        self.slot[i] = len(self.rows)
        self.rows.append([h, text, top, n])
        self.bytes += 2 * len(text) + 200
        if 2 * len(self.rows) > len(self.slot):
            self.slot = np.full(2 * len(self.slot), -1, np.int64)
            mask = len(self.slot) - 1
            for k, r in enumerate(self.rows):
                i = (r[0] ^ (r[0] >> 29)) & mask
                while self.slot[i] >= 0:
                    i = (i + 1) & mask
                self.slot[i] = k


def grace(records: Iterator[tuple], budget: int, fan: int = 16, level: int = 0) -> Iterator[list]:
    """Distinct rows of (hash, text, id, count); what outgrows the budget is dealt to spill files, each taken alone.

    Once the table is full, rows equal to one it holds still join it; the others go to fan files by the next
    bits of the hash. Each level's table empties before its files are read, so memory holds one table. At the
    last level, where hashes agree in all bits, the table just grows.
    """
    seen, files = ContentTable(), []
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for h, text, top, n in records:
            if files and seen.slot[seen._find(h, text)] < 0:
                pickle.dump((h, text, top, n), files[(h >> (4 * level + 8)) % fan])
                continue
            seen.add(h, text, top, n)
            if not files and seen.bytes > budget and level < 12:
                files = [open(os.path.join(folder, str(i)), "w+b") for i in range(fan)]
        yield from seen.rows
        del seen
        for f in files:
            f.seek(0)
            yield from grace(_read(f), budget, fan, level + 1)
            f.close()


def _read(f) -> Iterator[tuple]:
    try:
        while True:
            yield pickle.load(f)
    except EOFError:
        return


def _stage(budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for b in batches:
                for h, t, i, n in zip(b["h"].tolist(), b["text"], b["top"], b["n"].tolist(), strict=True):
                    yield h, t, None if i is None or i != i else int(i), n

        out, held = [], 0
        for r in grace(records(), budget):
            out.append(r)
            held += len(r[1])
            if held > 1 << 22:
                yield _frame(out)
                out, held = [], 0
        if out:
            yield _frame(out)

    return run


def _frame(rows: list) -> pd.DataFrame:
    h, t, top, n = zip(*rows, strict=True)
    return pd.DataFrame({"h": h, "text": t, "top": pd.array(top, "Int64"), "n": n})


def grace_dedup(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty. The largest doc_id stays (a null
    doc_id only where no other is there; then kept is true for it). Rows that repeat the largest doc_id are all
    kept. Every map task first folds its own copies, so a hot text sends one row per task; the shuffle
    deals by content hash, and each bucket is reduced within `budget` bytes, spilling recursively. doc_id is integral.
    """
    norm = ascii_lower(text_of())
    rows = docs.select(F.xxhash64(norm).alias("h"), norm.alias("text"), F.col("doc_id").cast("long").alias("top"), F.lit(1).cast("long").alias("n"))
    schema = "h long, text string, top long, n long"
    folded = rows.mapInPandas(_stage(budget), schema)
    groups = folded.repartition("h").mapInPandas(_stage(budget), schema).select(
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("top").alias("keep_id"), F.col("n").alias("group_size")
    )
    ids = docs.select("doc_id", F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    return ids.join(groups, ids.text_sha256 == groups.sha).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
