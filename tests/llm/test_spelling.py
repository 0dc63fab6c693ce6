"""Spelling variants against a plain Python version that compares all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortweave.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, root string"


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if distance_one(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(near), words[best] if forms[w] else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def noisy_rows():
    r = random.Random(7)
    stems = ["".join(r.choices("abcdeé", k=r.randint(5, 8))) for _ in range(25)] + ["Naïve", "ÉLANS", "aaaaaa", "straße"]
    rows = []
    for i in range(400):
        out = []
        for _ in range(30):
            w = stems[min(int(r.expovariate(0.15)), len(stems) - 1)]
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÀ") + w[k:], w[:k] + r.choice("ab") + w[k + 1 :]]) or w
            out.append(r.choice([w, w.upper(), w]))
        rows.append((r.choice([i, i, None, 5]), " ".join(out)))
    long = "".join(r.choices("ab", k=50_000))
    rows += [(9_000 + i, long + ("" if i < 9 else "b")) for i in range(12)]
    return rows + [(None, None), (1, ""), (2, "12 _ Ā×x"), rows[0], rows[0]]


@pytest.mark.parametrize("rows", [noisy_rows(), [], [(1, None)]], ids=["noisy", "empty", "null"])
def test_variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 3, "clash") for i, t in rows], SCHEMA)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs).collect()}
    assert got == brute(rows)
    if len(rows) > 5:
        assert len(got) > 100 and sum(v[0] is None for v in got.values()) > 5 and any(v[0] not in (None, v[1]) for v in got.values())


def test_no_words_are_broadcast(spark, monkeypatch):
    """Small files of words are large once each word is its deletions, so Spark's own choice by size must not count, at any step."""
    trees, written = [], spelling.written

    def seen(df):
        df.collect()
        trees.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(spelling, "written", seen)
    rows = [(i, "wander wanders sander " + "a" * 70 + " " + "a" * 71) for i in range(12)]
    rows += [(i, "wander " + "a" * 70) for i in range(12, 40)]
    out = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()}
    assert got == brute(rows) and got["a" * 71][0] == "a" * 70
    trees.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(t.count("SortMergeJoin") for t in trees) >= 6 and not any("Broadcast" in t for t in trees)


def test_follow_long_chain(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("x", "y")], "word string, form string")
    got = {r.word: r.root for r in spelling.follow(links).collect()}
    assert got == {**{f"w{i:03}": "w040" for i in range(40)}, "x": "y"}


def test_deletion_hashes_are_those_of_the_texts():
    r = random.Random(1)
    words = ["".join(r.choices("abé🙂", k=r.randint(1, 12))) for _ in range(200)] + ["a", "aaaa"]
    counts, keys = spelling.deletion_hashes(words)
    ends = np.cumsum(counts)
    of = {}
    for w, n, e in zip(words, counts, ends):
        texts = [w, *dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))]
        assert n == len(texts)
        for t, k in zip(texts, keys[e - n : e]):
            assert of.setdefault(t, k) == k
    assert len(set(of.values())) == len(of)
