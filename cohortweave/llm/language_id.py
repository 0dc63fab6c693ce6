"""Language identification: multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_of

DIM = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 400  # labelled texts of each language that the fit may take, about
MAX_FIT = 40_000  # and of all languages, shared evenly
UNKNOWN = "und"


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 1- to 3-grams of the whole lower-cased text: distinct buckets and their counts."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIM, np.int64)
    step = 1 << 20
    for lo in range(0, len(codes), step):  # bounded memory for very long texts
        c = codes[lo : lo + step + ORDERS[-1] - 1].astype(np.uint32)
        own = min(step, len(codes) - lo)
        h = np.zeros(len(c), np.uint32)
        for k in range(ORDERS[-1]):
            h = (h[: len(c) - k] * np.uint32(0x01000193)) ^ c[k:]
            if k + 1 in ORDERS:
                x = h[:own] * np.uint32(0x9E3779B1)
                total += np.bincount(x >> np.uint32(18), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


def _tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf[at]
    return v / max(1e-12, float(np.sqrt(v @ v)))


def fit_ftrl(rows, y, idf, classes: int, epochs: int = 3, a: float = 0.5, b: float = 1.0, l1: float = 0.01, l2: float = 0.01) -> np.ndarray:
    """FTRL-proximal with an elastic net; weights (DIM x classes) are exactly 0 where the evidence is under l1."""
    z, sq = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((b + np.sqrt(sq[at])) / a + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, n = rows[i]
            v, w = _tfidf(at, n, idf), weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(sq[at] + g * g) - np.sqrt(sq[at])) / a
            z[at] += g - sigma * w
            sq[at] += g * g
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least held-back log loss, on a fixed grid."""
    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    return min(np.geomspace(0.05, 5, 60), key=loss) if len(y) else 1.0


def _document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(DIM, np.int64), 0
    for b in batches:
        for t in b["text"]:
            df[ngram_counts(t)[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        f = [ngram_counts(t) for t in b["text"]]
        yield pd.DataFrame({"lang": b["lang"], "o": b["o"], "at": [x[0].astype(np.int32) for x in f], "n": [x[1].astype(np.int32) for x in f]})


def identify_language(docs: DataFrame, mod: int = 3, held: int = 1, per_language: int = PER_LANGUAGE, max_fit: int = MAX_FIT) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score (calibrated probability of lang_pred).

    Learns from text and non-null lang of rows whose id remainder is not `held`, all languages among them. Inverse document
    frequencies cover all such rows; the weights are fitted on about per_language different texts a language, or max_fit over
    the number of languages if less, chosen by text hash, a fifth of them held back for the temperature. Texts that
    are null or have no letter, and all texts where nothing can be learned, get `und` with score 0. Ties go to the
    language first in order. The driver and each task hold DIM x languages weights.
    """
    t = text_of()
    held_out = remainder(F.col("doc_id"), mod) == held
    known = docs.filter(~held_out).filter("lang is not null").select(t.alias("text"), "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    each = max(2, min(per_language, max_fit // max(1, len(sizes))))
    langs = sorted(sizes)
    counted = known.select("text").mapInPandas(_document_frequency, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = {r.bucket: r.df for r in counted}
    total = df.pop(-1, 0)
    idf = np.full(DIM, np.log(1.0 + total) + 1)
    for k, v in df.items():
        idf[k] = np.log((1 + total) / (1 + v)) + 1
    order = F.xxhash64("text")
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sizes.items()], "lang string, share double")
    unit = F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)
    picked = known.join(F.broadcast(shares), "lang").filter(unit < F.col("share")).withColumn("o", F.xxhash64(F.lit(5), "text"))  # a row a language
    one = picked.groupBy("lang", "o").agg(F.max("text").alias("text"))  # equal texts once
    sample = one.mapInPandas(_featurise, "lang string, o long, at array<int>, n array<int>").toPandas().sort_values(["o", "lang"], ignore_index=True)
    weights, heat = np.zeros((DIM, max(1, len(langs)))), 1.0
    if len(sample):
        rows = [(np.asarray(a), np.asarray(n, float)) for a, n in zip(sample["at"], sample["n"], strict=True)]
        y = np.array([langs.index(x) for x in sample["lang"]])
        back = np.arange(len(rows)) % 5 == 4
        weights = fit_ftrl([r for r, k in zip(rows, back, strict=True) if not k], y[~back], idf, len(langs))
        held_rows = [r for r, k in zip(rows, back, strict=True) if k]
        if held_rows:
            heat = fit_temperature(np.array([_tfidf(a, n, idf) @ weights[a] for a, n in held_rows]), y[back])
    weights = weights.astype(np.float32)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best, score = [], []
            for text in b["text"]:
                if not langs or not any(map(str.isalpha, text)):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, n = ngram_counts(text)
                s = _tfidf(at, n, idf) @ weights[at] / heat
                p = np.exp(s - s.max())
                best.append(langs[int(s.argmax())])
                score.append(float(p.max() / p.sum()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": best, "score": score})

    return docs.select("doc_id", held_out.alias("held_out"), t.alias("text")).mapInPandas(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
