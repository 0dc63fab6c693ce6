"""Benchmark decontamination by winnowing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, release, text_of, words, written

#: Fingerprint rows (16 bytes each) that a broadcast may hold.
MAX_BROADCAST_ROWS = 1_000_000


def _windows(h: str, size: int) -> Column:
    """The winnowing minimum of each window of `size` words, as an array by start."""
    k = size // 2
    gram = F.transform(
        F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(k)])
    )
    return F.transform(
        F.sequence(F.lit(0), F.size(h) - size), lambda i: F.least(*[F.get(F.col("gram"), i + j) for j in range(size - k + 1)])
    ), gram


def _runs(df: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Rows (keep, start, stop, fp, span): a fingerprint once for the run of windows whose minimum it is."""
    mins, gram = _windows("h", size)
    d = df.filter(F.size("h") >= size).withColumn("gram", gram).withColumn("mins", mins)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("mins") - 1),
        lambda i: (i == 0) | (F.get(F.col("mins"), i) != F.get(F.col("mins"), i - 1)),
    )
    d = d.withColumn("starts", starts)
    run = F.transform(
        F.col("starts"),
        lambda s, j: F.struct(
            s.alias("start"),
            F.get(F.col("mins"), s).alias("fp"),
            F.slice(F.col("h"), s + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size("mins")) - s + size - 1).alias("span"),
        ),
    )
    return d.select(*keep, F.explode(run).alias("r")).select(*keep, "r.*")


def _exact_windows(runs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Extend each fingerprint to its windows: key is the word hashes of the whole window."""
    each = F.transform(
        F.sequence(F.lit(0), F.size("span") - size),
        lambda i: F.struct((F.col("start") + i).alias("pos"), F.slice(F.col("span"), i + 1, size).alias("key")),
    )
    return runs.select(*keep, F.explode(each).alias("w")).select(*keep, "w.pos", "w.key")


def _item_keys(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the items, and their distinct windows (key, n, group); items below `size` words are one window of their own."""
    runs = _runs(items, size, ["item_id"])
    own = _exact_windows(runs, size, ["item_id"]).select("item_id", "key")
    short = items.filter((F.size("h") > 0) & (F.size("h") < size)).select("item_id", F.col("h").alias("key"))
    return runs.select("fp").distinct(), own.unionByName(short).distinct()


def _matches(doc: DataFrame, fps: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(row, pos, n, group) for every window of `size` words that a document and an item share."""
    near = _exact_windows(_runs(doc, size, ["row"]).join(bounded_broadcast(fps, MAX_BROADCAST_ROWS), "fp", "left_semi"), size, ["row"])
    return near.join(bounded_broadcast(keys.filter(F.col("n") == size), MAX_BROADCAST_ROWS // 10), "key").select("row", "pos", "n", "group")


def _short_matches(doc: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The same for items of `size` words, below the winnowing length: every such gram is looked up."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size("h") - size),
        lambda i: F.struct(i.alias("pos"), F.slice(F.col("h"), i + 1, size).alias("key")),
    )
    all_grams = doc.filter(F.size("h") >= size).select("row", F.explode(grams).alias("g")).select("row", "g.pos", "g.key")
    return all_grams.join(bounded_broadcast(keys.filter(F.col("n") == size), MAX_BROADCAST_ROWS // 10), "key").select("row", "pos", "n", "group")


def group_sets(found: DataFrame) -> DataFrame:
    """(row, set, groups): the different groups that a row meets, in order, and the digest of that list."""
    met = found.groupBy("row").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    return met.select("row", F.md5(F.to_json("groups").cast("binary")).alias("set"), "groups")


def items_of_sets(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(set, item): each different set of groups lists its items once, however many rows have met it."""
    each = sets.groupBy("set").agg(F.first("groups").alias("groups")).select("set", F.explode("groups").alias("group"))
    return each.join(bounded_broadcast(groups, MAX_BROADCAST_ROWS // 10), "group").select("set", F.explode("items").alias("item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted item ids), spans (merged hit word ranges), contaminated.

    Grams of window/2 words, minimum over each window: two texts that share a whole window share its minimum,
    so every shared span of `window` words is found; the windows are then compared by all their word hashes.
    An item of fewer words is one window of its own length; items with a null id are searched but not named. Null or empty text has no words.
    Texts are hashed once into a written table, where each row gets a key of its own, so rows that repeat a doc_id or have none stay
    apart. Windows that the same items hold form a group; documents meet groups, and each different set of groups is made a list of
    items once, so a passage of many items in many documents costs their sum, not their product.
    """
    hashed = F.transform(words(text_of()), lambda x: F.xxhash64(x)).alias("h")
    doc = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", hashed).withColumn("n_words", F.size("h").cast("long")))
    items = written(benchmark.select("item_id", hashed))
    fps, own = _item_keys(items, window)
    lists = own.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    lists = lists.withColumn("group", F.md5(F.to_json("items").cast("binary"))).withColumn("n", F.size("key"))
    lists = written(lists)
    keys, groups = lists.select("key", "n", "group"), lists.select("group", "items").distinct()
    short = sorted(r.n for r in keys.select("n").filter(F.col("n") < window).distinct().collect())  # at most window - 1 lengths
    hashes = doc.select("row", "h")
    found = _matches(hashes, fps, keys, window)
    for n in short:
        found = found.unionByName(_short_matches(hashes, keys, n))
    found = written(found)
    slim = written(doc.select("row", "doc_id", "n_words"))
    release(items, doc)
    at = found.groupBy("row", "pos").agg(F.max("n").alias("n")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n")).alias("end")))).alias("at")
    )
    sets = written(group_sets(found))
    names = sets.select("row", "set").join(items_of_sets(sets, groups).groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items")), "set").select("row", "items")
    merged = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], a["end"]))).cast("long").alias("n"),
            F.greatest(a["end"], x["end"]).alias("end"),
        ),
    )["n"]
    hits = written(at.join(names, "row", "left").select("row", merged.alias("n_hit"), "items", F.col("at").alias("spans")))
    release(found, sets)
    rows = slim.join(bounded_broadcast(hits, MAX_BROADCAST_ROWS // 100), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", (n_hit > 0).alias("contaminated"),
    )
