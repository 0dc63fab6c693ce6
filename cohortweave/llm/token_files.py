"""Token files: ids of all documents in doc_id order, in shards of Re-Pair blocks that can be read from any position."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import bounded_broadcast, shared_dir, text_of
from .repair import compress, dump, load
from .tokens import BYTE_BPE, byte_bpe

END = np.zeros(1, np.uint32).tobytes()
SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, ends array<long>, block_ids long, blocks array<binary>"
_MAX_SHARDS = 2_000_000  # rows of 16 bytes each that the offsets' broadcast may hold
_TEXTS = 4 << 20  # characters encoded at a time


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    began, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _TEXTS:
            yield began, i + 1
            began, held = i + 1, 0
    if began < len(texts):
        yield began, len(texts)


def _encode(path: str, shard_ids: int, block_ids: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = byte_bpe(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[bytes] = []

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids])
            flat = np.frombuffer(b"".join(ids), np.uint32)
            blocks = [dump(compress(flat[i : i + block_ids], coder.size, rounds=rounds)) for i in range(0, flat.size, block_ids)]
            row = {"part": part, "seq": seq, "n_ids": flat.size, "doc_ids": list(doc_ids), "ends": ends.tolist(), "block_ids": block_ids, "blocks": blocks}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        held = 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in _slices(texts):
                for key, x in zip(keys[a:b], coder.encode(texts[a:b]), strict=True):
                    doc_ids.append(key)
                    ids.append(x + END)
                    held += len(x) // 4 + 1
                    if held >= shard_ids:
                        yield shard()
                        seq, held = seq + 1, 0
                        doc_ids.clear()
                        ids.clear()
        if ids:
            yield shard()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, shard_ids: int = 4 << 20, block_ids: int = 1 << 20, rounds: int = 4) -> None:
    """Encode the texts (null as empty), an end id 0 after each, and write them in ascending doc_id order to Parquet files.

    A row of the files is a shard: part and seq (its place), n_ids, the doc_ids and where each one's ids end, and Re-Pair blocks of
    block_ids ids each (repair.dump says how their bytes lie). Rows without doc_id come first; rows that repeat one lie by text.
    An empty table writes no shard. doc_id is integral. Documents range over the tasks once; one is never cut between shards, but over
    blocks it is, so a task holds shard_ids ids, or one document's.
    """
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("at")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
    dealt.mapInArrow(_encode(tokenizer, shard_ids, block_ids, rounds), SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `before`: ids of all earlier shards."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select(F.col("part").alias("_part"), F.col("seq").alias("_row"), "n_ids")
    places = running(sizes, F.sum, ["n_ids"], first=0).select(F.col("_part").alias("part"), F.col("_row").alias("seq"), F.col("before_n_ids").alias("before"))
    return shards.join(bounded_broadcast(places, _MAX_SHARDS), ["part", "seq"])


def _decoded(row: dict, begin: int, end: int) -> np.ndarray:
    """Ids begin to end of a shard, from the blocks that hold them alone."""
    size = row["block_ids"]
    parts = [load(row["blocks"][b]).decode(max(0, begin - b * size), min(size, end - b * size)) for b in range(begin // size, -(-end // size))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        flat = _decoded(row, 0, row["n_ids"]).astype("<u4").tobytes()
        ends = np.array(row["ends"], np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        crc = [zlib.crc32(memoryview(flat)[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["before"]), pa.array(ends - begins), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _spans(begin: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = max(0, begin - row["before"]), min(row["n_ids"], end - row["before"])
            yield pa.RecordBatch.from_arrays([pa.array([row["before"] + a]), pa.array([_decoded(row, a, b).astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return run


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens (with the end id), ids_crc32 of its ids as little-endian 32 bits."""
    return read_shards(spark, path).mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(start, ids) per shard that reaches into ids begin to end (exclusive) of the whole; only blocks that hold some are decoded."""
    hit = read_shards(spark, path).filter((F.col("before") < end) & (F.col("before") + F.col("n_ids") > begin))
    return hit.mapInArrow(_spans(begin, end), "start long, ids array<int>")


def token_sums(docs: DataFrame) -> DataFrame:
    """Write the documents' token files to a new shared folder and sum up what is read back; see write_token_files."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    return document_sums(docs.sparkSession, path)
