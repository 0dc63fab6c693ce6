"""Spelling variants: words of the corpus one edit apart, each led to the frequent form it varies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, release, text_of, written

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
SLIP = 97  # of so many (document, run) hashes one loses a letter
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_BLOCK = 1 << 20  # code points hashed at a time


def corpus_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): runs of letters, a hashed few short of one letter, that reach min_chars code points and min_count occurrences.

    Counts are of occurrences in all rows; rows that repeat count again. Null or empty text has no run; a null doc_id hashes as
    the empty text. Occurrences are summed map-side, so a word of every row is a row per task in the exchange.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(LETTERS), F.lit(0))).alias("run"))
    low = F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run")))
    hashed = runs.select(low.alias("run"), F.crc32(F.concat("id", F.lit(":"), low).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.expr("left(run, cast(h % length(run) as int))"), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def deletion_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of hashes of each word, all hashes): of the word itself, then of each different text that it is with one letter gone.

    A polynomial modulo 2^64, so all deletions of a word of any length take time and memory in its length; deletions of either of two
    equal neighbours are the same text and hash once. Equal texts hash alike; what else does is for the join to tell apart.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    mixed = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    at = np.arange(points.size, dtype=np.int64) - np.repeat(start, size)
    longest = int(size.max(initial=0))
    power = np.full(longest + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    term = mixed * power[at]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
    whole = upto[start + size] - upto[start]
    first = np.ones(points.size, bool)
    first[1:] = (points[1:] != points[:-1]) | (at[1:] == 0)
    i = np.flatnonzero(first)
    of = np.repeat(np.arange(size.size), size)[i]
    before = upto[i] - upto[start[of]]
    after = (upto[(start + size)[of]] - upto[i + 1]) * np.uint64(_inverse(_BASE))
    counts = np.bincount(of, minlength=size.size) + 1
    out = np.empty(int(counts.sum()), np.uint64)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    head = np.zeros(out.size, bool)
    head[heads] = True
    length = size.astype(np.uint64)
    out[head] = whole + length
    out[~head] = before + after + length[of] - np.uint64(1)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return counts, (out ^ (out >> np.uint64(32))).view(np.int64)


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    began, chars = 0, 0
    for i, w in enumerate(words):
        if chars and chars + len(w) > _BLOCK:
            yield began, i
            began, chars = i, 0
        chars += len(w)
    if began < len(words):
        yield began, len(words)


def _emit(carry: str):
    """Batches of (word, carry, n) to rows of (key, carry, n); the carried column stands for the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for a, b in _blocks(words):
                counts, keys = deletion_hashes(words[a:b])
                of = np.repeat(np.arange(a, b), counts)
                for i in range(0, keys.size, _BLOCK):
                    rows = batch.select([carry, "n"]).take(pa.array(of[i : i + _BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + _BLOCK]), *rows.columns], names=["key", carry, "n"])

    return run


def near_pairs(words: DataFrame, short: int = 64) -> DataFrame:
    """(word, n, other, other_n) for all pairs of different words at edit distance one, each once, word < other.

    Every word emits itself and its deletions; words that share a key meet, and the exact distance decides. A key's words are the
    texts that one letter more makes of it, so their number is bound by its length and the alphabet, not by the corpus. Two words at
    distance one share one key only: the shorter word, or what both leave without the letter that differs. Words of over `short` code
    points send a digest with each key, else they would move their own length squared; their pairs fetch the texts after the join.
    The joins are by merge, whatever Spark takes the tables for: it knows the files of the words, in which they are packed, and not the
    rows that each becomes, one a letter and more, so it would broadcast those.
    """
    near, size = F.expr("levenshtein(x.word, y.word, 1) = 1"), F.length("word")
    keys = words.filter(size <= short).mapInArrow(_emit("word"), "key long, word string, n long")
    meet = keys.alias("x").join(keys.alias("y").hint("merge"), F.expr("x.key = y.key AND x.word < y.word AND abs(length(x.word) - length(y.word)) <= 1"))
    pairs = [meet.filter(near)]
    long = words.filter(size >= short).withColumn("id", F.unhex(F.md5(F.col("word").cast("binary"))))
    ids = long.mapInArrow(_emit("id"), "key long, id binary, n long").select("key", "id")
    met = ids.alias("a").join(ids.alias("b").hint("merge"), F.expr("a.key = b.key AND a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    texts = long.select("id", F.struct("word", "n").alias("w")).hint("merge")
    found = met.join(texts.select(F.col("id").alias("a"), F.col("w").alias("v")), "a").join(texts.select(F.col("id").alias("b"), "w"), "b")
    ordered = found.select(F.least("v", "w").alias("x"), F.greatest("v", "w").alias("y"))
    pairs.append(ordered.filter(near & F.expr(f"greatest(length(x.word), length(y.word)) > {short}")))
    return pairs[0].select("x.word", "x.n", F.col("y.word").alias("other"), F.col("y.n").alias("other_n")).unionAll(
        pairs[1].select("x.word", "x.n", F.col("y.word").alias("other"), F.col("y.n").alias("other_n")))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where the forms lead. Each round a root is replaced by its own, so the way left halves.

    A form is at least twice as frequent as its word, so there are no rings and a chain has at most 63 steps: 7 rounds. Links grow with
    the words, so nothing is broadcast.
    """
    state = written(links.select("word", F.col("form").alias("root")))
    while True:
        a, b = state.alias("a"), state.alias("b")
        hop = a.join(b.hint("merge"), F.expr("a.root = b.word"), "left")
        after = written(hop.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        release(state)
        state = after
        if after.filter("moved").isEmpty():
            return state.select("word", "root")


def group_variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, times: int = 2) -> DataFrame:
    """One row per word of the corpus: word, n, n_near, form, form_n, root; see corpus_words and near_pairs.

    The form is the near word of largest n (of equal ones the first in code-point order) where that is `times` the word's n or more.
    An empty corpus has no rows. Columns of docs other than doc_id and text play no part.
    """
    words = written(corpus_words(docs, min_chars, min_count))
    pairs = near_pairs(words)
    ends = F.array(
        F.struct("word", "n", F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")).alias("best")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best")),
    )
    sides = pairs.select(F.inline(ends))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    formed = written(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    release(words)
    roots = follow(formed.filter("form IS NOT NULL").select("word", "form"))
    out = formed.join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
