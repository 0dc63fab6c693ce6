"""Two tokenizers' ids of the same texts, cut where both end a token, with links counted over the corpus.

Both tokenizers start anew at a blank between two characters that are no white space, so tokens, cuts and links of a text are those
of its segments one after the other. Each different segment is tokenised once and its tokens are joined as relations; a document
adds up its segments.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, release, settle, text_of, written
from .tokens import BYTE_BPE, PIECE_BPE, ByteBpe, PieceBpe, segments

MAX_PAIRS = 2_000_000  # id pairs with their counts that a broadcast may hold
_STEP = 50_000  # segments tokenised at a time


PACKED = "bucket long, doc_id long, good boolean, at array<int>, place int, segment string, n long"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _packed(piece_file: str, bucket_bytes: int):
    """Documents (doc_id, good, at) and segments (place, segment, n) of buckets of about bucket_bytes of text, in one pass over the texts.

    at has the places of a document's segments in its bucket's list; it is empty where the tokenizers do not spell the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bucket, held, places, counts = PieceBpe(piece_file), TaskContext.get().partitionId() << 32, 0, {}, np.zeros(0, np.int64)

        def rows(size: int, **cols) -> pa.RecordBatch:
            arrays = [cols[c].cast(k) if c in cols else pa.nulls(size, k) for c, k in zip(_NAMES, _KINDS, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

        def listed() -> pa.RecordBatch:
            n = len(places)
            return rows(n, bucket=pa.array(np.full(n, bucket)), place=pa.array(np.arange(n, dtype=np.int32)), segment=pa.array(list(places), pa.string()), n=pa.array(counts[:n]))

        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            first = 0
            while first < len(texts):
                fresh, at, good, last = itertools.count(len(places)), [], [], first
                places = defaultdict(fresh.__next__, places)
                while last < len(texts) and (held < bucket_bytes):
                    t = texts[last]
                    held += len(t) + 1
                    good.append(bool(t) and model.spells(t))
                    at.append(np.fromiter(map(places.__getitem__, segments(t)), np.int32) if good[-1] else np.empty(0, np.int32))
                    last += 1
                used = np.bincount(np.concatenate(at), minlength=max(len(places), counts.size))
                used[: counts.size] += counts
                counts = used
                own = pa.array(np.full(last - first, bucket))
                yield rows(last - first, bucket=own, doc_id=ids.slice(first, last - first), good=pa.array(good, pa.bool_()), at=pa.array(at, _KINDS[3]))
                if held >= bucket_bytes:
                    yield listed()
                    bucket, held, places, counts = bucket + 1, 0, {}, np.zeros(0, np.int64)
                first = last
        if places:
            yield listed()

    return run


def _tokenised(byte_file: str, piece_file: str):
    """(sid, segment, n) with both tokenizers' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, sid = ByteBpe(byte_file, special_as_text=True, keep=0), PieceBpe(piece_file), TaskContext.get().partitionId() << 40
        long, kind = a.lengths(), pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                texts = part.column("segment").to_pylist()
                ids = [[np.frombuffer(x, np.uint32).astype(np.int32) for x in a.spaced_ids(texts)], [np.array(x, np.int32) for x in b.encode(texts)]]
                for t, i, j in zip(texts, *ids, strict=True):
                    if b"".join(map(b.pieces.__getitem__, j)) != (whole := (" " + t).encode()) or long[i].sum() != len(whole):
                        raise ValueError("the tokenizers do not spell a segment of a text that they spell")
                own = pa.array(np.arange(sid, sid + len(texts)))
                yield pa.RecordBatch.from_arrays([own, *part.columns, *[pa.array(x, kind) for x in ids]], names=["sid", "segment", "n", "a", "b"])
                sid += len(texts)

    return run


def cuts(tokens: DataFrame, sizes: dict[str, DataFrame]) -> DataFrame:
    """(sid, part, a, b, a_pos, b_pos): the tokens of a (ids a) and b (ids b) of one sid that end at the same byte; part counts the cuts before.

    tokens: sid, a, b. sizes: for a and b, the vocabulary's (id, len). Tokens explode by position, their cumulative lengths are their
    ends, and the two sides join where sid and end are equal. A sid's rows are those of one text, and stay in its partition.
    """
    ends = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def side(name: str) -> DataFrame:
        rows = tokens.select("sid", name).repartition("sid").select("sid", F.posexplode(name).alias("pos", "id"))
        long = rows.join(F.broadcast(sizes[name]), "id")  # a row per entry of the vocabulary
        return long.select("sid", F.sum("len").over(ends).alias("at"), F.col("id").alias(name), F.col("pos").alias(f"{name}_pos"))

    before = Window.partitionBy("sid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    both = side("a").join(side("b"), ["sid", "at"])
    return both.select("sid", F.count(F.lit(1)).over(before).cast("int").alias("part"), "a", "b", "a_pos", "b_pos")


def groups(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """tokens (sid, segment, n, a, b) with their cuts joined back: segment, n, links (the ids that end together), groups (`a1,a2|b1;a3|b2`).

    The ids between two cuts are a group, so the last of each side are its link.
    """
    parts = found.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "a_pos", "b_pos"))).alias("parts"))

    def ids(name: str, p, i):
        since = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("parts"), i - 1)[f"{name}_pos"])
        return F.array_join(F.slice(name, since + 2, p[f"{name}_pos"] - since), ",")

    text = F.transform("parts", lambda p, i: F.concat(ids("a", p, i), F.lit("|"), ids("b", p, i)))
    links = F.transform("parts", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    return tokens.join(parts, "sid").select("segment", "n", links.alias("links"), F.array_join(text, ";").alias("groups"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links, best) of aligned segments (n, links): how many links of the corpus hold the pair, and whether no pair of its b has more."""
    pairs = aligned.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("links"))
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).cast("int").alias("best"))


def _numbers(groups: str) -> tuple[int, int, int]:
    """How many ids of a and of b, and groups, a text of groups holds."""
    n = groups.count(";") + 1
    n_a = sum(g.count(",", 0, g.index("|")) for g in groups.split(";")) + n
    return n_a, groups.count(",") + 2 * n - n_a, n


def _documents(docs: pa.Table, known: pa.Table) -> pa.Table:
    """A bucket's documents, each the sum of its segments."""
    order = np.argsort(known.column("place").to_numpy())
    known = known.take(pa.array(order))
    text = known.column("groups").to_pylist()
    sized = np.array([_numbers(g) for g in text], np.int64).reshape(-1, 3)
    numbers = np.concatenate([sized, sized[:, 2:], *[known.column(c).to_numpy().astype(np.int64)[:, None] for c in ("n_best", "count_sum")]], 1)
    sums, shas = np.zeros((docs.num_rows, 6), np.int64), []
    for i, (at, good) in enumerate(zip(docs.column("at"), docs.column("good").to_pylist(), strict=True)):
        if not good:
            shas.append("")
            continue
        at = at.values.to_numpy()
        sha = hashlib.sha256()
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            sums[i] += numbers[part].sum(0)
            sha.update((";" * (k > 0) + ";".join(map(text.__getitem__, part.tolist()))).encode())
        shas.append(sha.hexdigest())
    named = dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), sums.T, strict=True))
    return pa.table({"doc_id": docs.column("doc_id"), **named, "groups_sha256": pa.array(shas, pa.string())})


@contextmanager
def co_partitioned(spark: SparkSession):
    """Let joins on (sid, end) run in partitions by sid, as ends of one sid are few; the session's own setting comes back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def vocabulary_sizes(spark: SparkSession, byte_file: str, piece_file: str) -> dict[str, DataFrame]:
    """(id, len) of each vocabulary: the bytes of its entries."""
    both = {"a": ByteBpe(byte_file).lengths(), "b": PieceBpe(piece_file).lengths}
    return {name: spark.createDataFrame([(i, int(n)) for i, n in enumerate(long)], "id int, len int") for name, long in both.items()}


def align_tokenizers(docs: DataFrame, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Blank + text by the byte-level file (a), text by the piece file (b), special tokens' strings as plain text. A group ends where
    tokens of both end; those two are linked (so a group has one link). A pair's count is its links in all rows, repeated rows
    too; n_best counts links whose pair is the commonest of its b (ties included). Null or empty texts, and texts whose bytes b
    does not give back, have zeros and ''. Segments' counts are folded bucket by bucket before they move, so one of every row is
    a row per bucket; a bucket is what one task holds, a document the least of it. doc_id is integral.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = written(rows.mapInArrow(_packed(piece_file, bucket_bytes), PACKED), "zstd")
    uses = packed.filter("segment IS NOT NULL").select("bucket", "place", "segment", "n")
    tokens = written(uses.groupBy("segment").agg(F.sum("n").alias("n")).mapInArrow(
        _tokenised(byte_file, piece_file), "sid long, segment string, n long, a array<int>, b array<int>"), "zstd")
    settle(spark)
    with co_partitioned(spark):
        aligned = written(groups(tokens, cuts(tokens, vocabulary_sizes(spark, byte_file, piece_file))), "zstd")
    release(tokens)
    settle(spark)
    pairs = written(pair_counts(aligned))
    links = aligned.select("segment", F.inline("links")).join(bounded_broadcast(pairs, MAX_PAIRS), ["a", "b"])
    scored = links.groupBy("segment").agg(F.sum("best").cast("int").alias("n_best"), F.sum("links").alias("count_sum"))
    known = aligned.select("segment", "groups").join(scored, "segment")
    needed = written(uses.select("bucket", "place", "segment").join(known, "segment").drop("segment"), "zstd")
    release(aligned, pairs)
    settle(spark)
    found = packed.filter("segment IS NULL").select("bucket", "doc_id", "good", "at")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return found.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(_documents, out)
