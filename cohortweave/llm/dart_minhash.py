"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, release, text_of, words, written

SHINGLE = 5
ROWS, BANDS = 4, 20
MAX_BROADCAST_IDS = 1_000_000  # of 8 bytes
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) / float(1 << 53)


def shingles(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of all runs of `size` words, repeats kept; a shorter text is one run, an empty one has none."""
    h = np.asarray(word_hashes, np.int64).view(np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(size, len(h))):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.sort(out)


def occurrences(run: np.ndarray) -> np.ndarray:
    """The i-th use of a shingle as an element of its own: Jaccard of these sets is weighted Jaccard of the counts."""
    at = np.arange(len(run))
    first = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), at, 0)) if len(run) else at
    with np.errstate(over="ignore"):
        return np.unique(np.where(at > first, mix64(run + (at - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), run))


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k) of weighted sets given as parallel arrays.

    Darts are a Poisson process on each element's weight x rank plane, drawn cell by cell (both axes
    double) from hashes of the element and cell alone, so documents agree on them. A document takes darts
    under its weight with rank up to phi, about k ln k + 2k of them, and keeps the earliest per coordinate. Where a
    coordinate stays empty, phi doubles for that document. Time is about elements + k ln k. 0 marks no elements.
    """
    sig = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    phi = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n_docs), where=total > 0)
    todo = total > 0
    base = 2.0**-4
    while todo.any():
        pick = todo[doc]
        d, e, x = doc[pick], element[pick], weight[pick]
        limit = phi[d]
        found = []
        w_lo, w_hi, nu = 0.0, 1.0, 0
        heavy = np.arange(len(x))
        while (heavy := heavy[x[heavy] > w_lo]).size:
            r_lo, r_hi, rho = 0.0, base, 0
            cell = heavy
            while (cell := cell[limit[cell] > r_lo]).size:
                area = (w_hi - w_lo) * (r_hi - r_lo)
                # Poisson counts by inversion; parts of at most 4 keep exp(-area) well scaled
                parts = max(1, int(np.ceil(area / 4)))
                with np.errstate(over="ignore"):
                    salt = (np.arange(1, parts + 1, dtype=np.uint64) + _U((nu << 12) + rho << 20)) * _U(0x9E3779B97F4A7C15)
                s = mix64((e[cell][:, None] ^ salt).ravel())
                p, j = np.exp(-area / parts), 0
                cum = p
                live = np.flatnonzero(s >> _U(11) > _U(int(cum * (1 << 53))))
                s, cell_of = s[live], cell[live // parts]
                u, live = _unit(s), np.arange(len(live))
                while live.size:
                    z = mix64(s[live] + _U(j + 0x51ED))
                    a, b, c = mix64(z + _U(1)), mix64(z + _U(2)), mix64(z + _U(3))
                    at = cell_of[live]
                    rank = r_lo + _unit(b) * (r_hi - r_lo)
                    ok = (w_lo + _unit(a) * (w_hi - w_lo) < x[at]) & (rank <= limit[at])
                    found.append((d[at][ok], rank[ok], (c % _U(k)).astype(np.int64)[ok], z[ok]))
                    j += 1
                    p *= area / parts / j
                    cum += p
                    live = live[u[live] > cum] if j < 64 else live[:0]
                r_lo, r_hi, rho = r_hi, r_hi * 2, rho + 1
            w_lo, w_hi, nu = w_hi, w_hi * 2, nu + 1
        if found:
            fd, fr, fc, fz = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.argsort(-fr)  # the earliest dart is written last
            part = np.zeros((n_docs, k), np.uint64)
            part[fd[order], fc[order]] = fz[order] | _U(1)
            full = todo & (part != 0).all(axis=1)
            sig[full] = part[full]
            todo &= ~full
        phi = np.where(todo, phi * 2, phi)
    return sig


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, lo = b["doc_id"], 0
        sizes = b["h"].map(len).to_numpy()
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), 200_000)) + lo)
            sets = [np.unique(shingles(h), return_counts=True) for h in b["h"].iloc[lo:hi]]
            doc = np.repeat(np.arange(hi - lo), [len(e) for e, _ in sets])
            weight = np.concatenate([c for _, c in sets]).astype(np.float64)
            n = np.array([c.sum() for _, c in sets])
            sig = dart_minhash(doc, np.concatenate([e for e, _ in sets]), weight, hi - lo, ROWS * BANDS)
            band = np.zeros((hi - lo, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    band = mix64(band * _U(31) + sig[:, r * BANDS : (r + 1) * BANDS])
                band = mix64(band + np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
            yield pd.DataFrame({"doc_id": ids.iloc[lo:hi].to_numpy(), "n": n, "content": b["content"].iloc[lo:hi].to_numpy(), "bands": list(band.view(np.int64))})
            lo = hi


def _members(ex: DataFrame) -> DataFrame:
    """Members of buckets of more than one id, each with its bucket's smallest and largest; later steps read only these."""
    member = F.struct("doc_id", "n")
    lead = ex.groupBy("bucket").agg(F.min(member).alias("low"), F.max(member).alias("high")).filter("low.doc_id <> high.doc_id")
    return ex.join(lead, "bucket")


def _leader_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Each bucket's members with its smallest and its largest id, where the sizes allow the threshold.

    The same two leaders serve all of a group's buckets, so a group of m texts gives about 2 m pairs.
    """
    both = members.select("doc_id", "n", F.explode(F.array("low", "high")).alias("l")).filter(F.col("doc_id") != F.col("l.doc_id"))
    near = both.filter(F.least("n", "l.n") >= F.greatest("n", "l.n") * threshold - 1e-9)
    return near.select(F.least("doc_id", "l.doc_id").alias("a"), F.greatest("doc_id", "l.doc_id").alias("b")).distinct()


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, label) of texts that share a bucket with a text of another class, neither being the bucket's leader."""
    rest = members.filter("doc_id <> low.doc_id AND doc_id <> high.doc_id").select("doc_id", "bucket")
    own = rest.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    several = own.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    return own.join(several.select("bucket"), "bucket", "left_semi").select("doc_id", "label").distinct()


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Every pair (a, b) of different labels that may reach the threshold, by an exact prefix filter.

    Shingles are ordered from the rarest. Sets of sizes x >= y at the threshold share at least
    need = t / (1 + t) * (x + y) shingles, so the first one they share has need - 1 others behind it in either set. It is thus
    early in both, where shingles of one text or few stand, and what a whole group shares meets no one. Shingles of a
    single set only move the others back.
    """
    each = sets.select("doc_id", "label", F.size("s").alias("n"), F.explode("s").alias("t"))
    common = sets.select(F.explode("s").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    order = each.join(common, "t").groupBy("doc_id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    size = F.col("n").cast("double")
    head = F.floor(size - threshold * size + 1e-6) + 1 - (F.col("n") - F.size("o"))
    entry = order.filter(head > 0).select("doc_id", "label", "n", (F.col("n") - F.size("o")).alias("lone"), F.posexplode(F.slice("o", F.lit(1), head.cast("int"))).alias("i", "e"))
    entry = written(entry.select("e.t", "doc_id", "label", "n", (F.col("n") - F.col("lone") - F.col("i")).alias("rest")))
    x = entry.select("t", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "label", "n", "rest")])
    y = entry.filter(F.col("rest") >= 2 * threshold / (1 + threshold) * F.col("n") - 1e-6)
    larger = (F.col("x_n") > F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x_doc_id") > F.col("doc_id")))
    enough = F.least("x_rest", "rest") >= threshold / (1 + threshold) * (F.col("x_n") + F.col("n")) - 1e-6
    near = x.join(y, (x.t == y.t) & (F.col("x_label") != F.col("label")) & larger & enough)
    return near.select(F.least("doc_id", "x_doc_id").alias("a"), F.greatest("doc_id", "x_doc_id").alias("b")).distinct()


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    return run


def _to_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "s": [occurrences(shingles(h)).view(np.int64) for h in b["h"]]})


def _sets_of(ids: DataFrame, hashed: DataFrame) -> DataFrame:
    return written(hashed.join(bounded_broadcast(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi").mapInPandas(_to_shingles, "doc_id long, s array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose shingle sets reach the threshold exactly."""
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"
    )
    return written(full.select("a", "b", "sa", "sb").mapInPandas(_compare(threshold), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id of each connected component, by min-label steps with pointer jumps."""
    arcs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
    label = written(arcs.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("doc_id"), F.least("x", "m").alias("label")))
    while True:
        near = arcs.join(label, arcs.y == label.doc_id).groupBy("x").agg(F.min("label").alias("m"))
        step = label.join(near, label.doc_id == near.x).select("doc_id", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        root = label.select(F.col("doc_id").alias("mid"), F.col("label").alias("up"))
        new = written(step.join(root, "mid").select("doc_id", "old", F.least("mid", "up").alias("label")))
        label = new.select("doc_id", "label")
        if new.filter("old != label").isEmpty():
            return label


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: components of the classes, a far smaller graph, then one lookup a document."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    nodes = written(label.unionByName(ends.join(label, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label"))))
    at = lambda end: nodes.select(F.col("doc_id").alias(end), F.col("label").alias(f"of_{end}"))
    between = edges.join(at("a"), "a").join(at("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    up = components(between).select(F.col("doc_id").alias("label"), F.col("label").alias("up"))
    return written(nodes.join(up, "label", "left").select("doc_id", F.coalesce("up", "label").alias("label")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs with a non-null id: doc_id, class_id (its class's smallest doc_id), kept.

    Texts are bags of five-word shingles, weighted by their counts; a weighted Jaccard of at least `threshold` links
    two of them, and classes are connected components. Copies with the same words fold first. In each bucket of equal
    bands the members are compared with the two leaders, which folds large groups in linear work. Texts that still share a bucket
    with another class, without having been compared, then go through an exact prefix filter, so no pair of a bucket at the
    threshold is left out. Shingles of bucket members are computed and written once. A text without words is a class of
    its own; rows that repeat a doc_id share its class, and rows with a null doc_id get a null class and are kept.
    doc_id is integral.
    """
    w = words(text_of())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), w.alias("w")).filter("doc_id is not null")
    hashes = F.transform("w", lambda x: F.xxhash64(x)).alias("h")
    inputs = d.filter(F.size("w") > 0).select("doc_id", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))).alias("content"), hashes)
    signed = written(inputs.mapInPandas(_sign, "doc_id long, n long, content binary, bands array<long>"))
    low = F.min(F.struct("doc_id", "n", "bands")).alias("m")
    reps = written(signed.groupBy("content").agg(low).select("content", F.col("m.doc_id").alias("rep"), "m.n", "m.bands"))
    members = written(_members(reps.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("bucket"))))
    ids = written(members.select("doc_id").distinct())
    own = d.join(bounded_broadcast(ids, MAX_BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", hashes)
    sets = written(own.mapInPandas(_to_shingles, "doc_id long, s array<long>"))
    done = written(_leader_pairs(members, threshold))
    label = components(_verified(done, sets, threshold))
    left = written(_open(members, label))
    if not left.isEmpty():
        rest = _prefix_pairs(sets.join(left, "doc_id"), threshold).join(done, ["a", "b"], "left_anti")
        label = _merged(label, _verified(written(rest), sets, threshold))
    release(members, ids, sets, done)
    member = signed.select("doc_id", "content").join(reps.select("content", "rep"), "content").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    classes = member.join(label.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    out = docs.select("doc_id").join(classes.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
