"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, remainder, text_of, written

#: Lexicons of insults; each is one voter.
LEXICONS = {
    "intellect": ("idiot", "moron", "stupid", "imbecile", "dumb", "fool"),
    "worth": ("worthless", "pathetic", "loser", "useless", "failure"),
    "disgust": ("disgusting", "trash", "scum", "filth", "vermin", "garbage"),
    "ridicule": ("clown", "joke", "buffoon", "freak", "creep"),
    "german": ("abschaum", "dummkopf", "erbärmlich", "trottel", "versager", "wertlos"),
    "french": ("abruti", "crétin", "débile", "imbécile", "minable", "ordure"),
    "spanish": ("basura", "escoria", "estúpido", "imbécil", "inútil", "patético"),
}
#: Words that address the reader.
ADDRESS = frozenset("you your yours du dich dir dein tu te toi ton vous tú ti usted ustedes".split())
STEMS = (4, 5, 6)  # word beginnings that may be learned as lexicon entries
LEARNED = ("word", *[f"stem{k}" for k in STEMS], "weak")  # voters that hold the learned entries, by form; weak: of lesser share
PATTERNS = ("repeated", "several", "dense", "loud", "shouting", "aimed", "curt")
VOTERS = (*LEXICONS, *LEARNED, *PATTERNS)
STRONG, WEAK = 0.9, 0.8  # shares of toxic texts among those that hold an entry
FALSE_ALARM = 0.004  # of a voter on texts that are not toxic, held against the data with equal weight: none is thought perfect
MAX_LABELLED = 20_000  # labelled texts, about, that entries are learned from
_WORD_OF: dict[str, list[int]] = {}
for _i, _ws in enumerate(LEXICONS.values()):
    for _w in _ws:
        _WORD_OF.setdefault(_w, []).append(_i)
_WORD = re.compile(r"[^\W\d_]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
N_LEX = len(LEXICONS) + len(LEARNED)
WIDTH = N_LEX + 7


def entries_of(word: str) -> list[str]:
    """The forms under which a word may be an entry: itself, and its beginnings marked by *."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


def _form(entry: str) -> int:
    return STEMS.index(len(entry) - 1) + 1 if entry.endswith("*") else 0


def features(text: str, learned: dict[str, int], heads: set[str]) -> np.ndarray:
    """Per lexicon the log count; then log hits, distinct words, density, exclamation runs, capitals, address, length.

    heads: the first letters of the learned entries, to pass over other words fast.
    """
    n, hits, distinct, size, address = np.zeros(N_LEX), 0, 0, 0, 0
    for w, k in Counter(_WORD.findall(text.translate(_LOWER))).items():
        size += k
        address += k * (w in ADDRESS)
        if w not in _WORD_OF and w[: STEMS[0]] not in heads:
            continue
        voters = set(_WORD_OF.get(w, ()))
        if learned:
            voters |= {len(LEXICONS) + learned[e] for e in entries_of(w) if e in learned}
        for i in voters:
            n[i] += k
        sure = bool(voters - {N_LEX - 1})
        hits += k * sure
        distinct += sure
    capitals = len(re.findall(r"\b[A-Z]{3,}\b", text)) / max(1, size)
    rest = [np.log1p(hits), min(8, distinct), min(1.0, 50 * hits / max(1, size)), min(3, text.count("!!")),
        min(1.0, 5 * capitals), min(1.0, 20 * address / max(1, size)), 1 / (1 + size / 50)]
    return np.concatenate([np.log1p(n), rest])


def votes(f: np.ndarray) -> np.ndarray:
    """1 toxic, 0 not, -1 abstain, in the order of VOTERS. Pattern voters that speak of style abstain where no entry is hit."""
    hits, distinct, dense, loud, capitals, address, brief = f[N_LEX:]
    style = lambda x: (1 if x else 0) if hits > 0 else -1
    return np.concatenate([
        (f[:N_LEX] > 0).astype(int), [int(hits > np.log(3.5)), int(distinct >= 2), int(dense > 0.2)],
        [style(loud > 0), style(capitals > 0.5), style(address > 0.1), style(brief > 0.3)],
    ])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pos: Counter = Counter()
        every: Counter = Counter()
        for text, y in zip(b["text"], b["toxic"], strict=True):
            own = {e for w in set(_WORD.findall(text.translate(_LOWER))) for e in entries_of(w)}
            every.update(own)
            if y:
                pos.update(own)
        yield pd.DataFrame({"entry": list(every), "pos": [pos[e] for e in every], "n": list(every.values())})


def learn_entries(labelled: DataFrame, prior: float) -> dict[str, int]:
    """Lexicon entries whose share of toxic among the labelled texts that hold them is beyond chance, with their voter.

    An entry needs a share over WEAK and n * KL(share, prior) over the log of the number of entries tested, so chance yields about
    one. Its voter is set by its form, or is the weak one up to STRONG. Their number is bounded by the labelled texts.
    """
    counts = written(
        labelled.mapInPandas(_entries, "entry string, pos long, n long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter("pos >= 2")
    )
    tested = counts.count()
    share = F.least(F.col("pos") / F.col("n"), F.lit(1 - 1e-9))
    kl = share * F.log(share / prior) + (1 - share) * F.log((1 - share) / (1 - prior))
    best = counts.filter(share > max(WEAK, prior)).filter(F.col("n") * kl > math.log(tested + 1.0)).select("entry", (share > STRONG).alias("strong"))
    return {r.entry: _form(r.entry) if r.strong else len(LEARNED) - 1 for r in best.collect()}


def _tree(x: np.ndarray, w: list[np.ndarray]) -> list[int]:
    """Parent of each voter (-1: none) in the spanning forest of greatest mutual information given the class."""
    v, share = x.shape[1], sum(k.sum() for k in w)
    hot = np.stack([x == s for s in range(3)], axis=2).astype(float)
    info = np.zeros((v, v))
    for k in w:
        joint = np.einsum("p,pia,pjb->ijab", k, hot, hot) / max(k.sum(), 1e-9)
        one = np.einsum("p,pia->ia", k, hot) / max(k.sum(), 1e-9)
        ratio = np.divide(joint, one[:, None, :, None] * one[None, :, None, :], out=np.ones_like(joint), where=joint > 0)
        info += k.sum() / share * (joint * np.log(ratio)).sum(axis=(2, 3))
    parent, inside = [-1] * v, [0]
    while len(inside) < v:
        out = [j for j in range(v) if j not in inside]
        i, j = max(((i, j) for i in inside for j in out), key=lambda e: info[e])
        parent[j] = i if info[i, j] > 1e-6 else -1
        inside.append(j)
    return parent


def _tables(x: np.ndarray, w: np.ndarray, parent: list[int], fire: float, strength: float) -> list[np.ndarray]:
    """Per voter P(vote | parent's vote) in one class; row 0 alone counts without a parent. Rare rows lean on the voter's own rates,
    and these on the rate `fire` with the weight `strength`."""
    out = []
    for i, j in enumerate(parent):
        own = np.array([w[x[:, i] == s].sum() for s in range(3)]) + strength * np.array([0.02, 0.98 - fire, fire])
        own /= own.sum()
        rows = [np.array([w[(x[:, j] == r) & (x[:, i] == s)].sum() for s in range(3)]) for r in range(3)] if j >= 0 else [np.zeros(3)] * 3
        out.append(np.array([(r + 2 * own) / (r.sum() + 2) for r in rows]))
    return out


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 30, init: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """Posterior of toxic for each vote pattern, and the voters' tree, by EM on a two-class generative model.

    In either class a voter has its own rates of votes given the vote of its parent in a tree, which holds the strongest
    correlations that the classes leave; the tree is fitted anew as the posterior moves. The prior is fixed,
    and no text that no voter speaks against is above it.
    """
    x = patterns + 1
    post = np.where((patterns[:, :N_LEX] == 1).any(axis=1), 0.9, 0.02) if init is None else init
    parent = [-1] * x.shape[1]
    for k in range(rounds):
        w = [counts * (1 - post), counts * post]
        if k % 10 == 5:
            parent = _tree(x, w)
        t0, t1 = _tables(x, w[0], parent, FALSE_ALARM, 1.5 + w[0].sum()), _tables(x, w[1], parent, 0.5, 1.5)
        log_odds = np.full(len(x), np.log(prior / (1 - prior)))
        for i, j in enumerate(parent):
            row = x[:, j] if j >= 0 else 0
            log_odds += np.log(t1[i][row, x[:, i]] / t0[i][row, x[:, i]])
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        post[(patterns < 1).all(axis=1)] = np.minimum(post, prior)[(patterns < 1).all(axis=1)]
    return post, parent


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x1 = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x1.shape[1])
    reg = np.append(np.full(x.shape[1], ridge), 1e-6) * w.sum() / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        hess = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(reg + 1e-9)
        step = np.linalg.solve(hess, x1.T @ (w * (y - p)) - reg * beta)
        beta += np.clip(step, -2, 2)
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, carry: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 where score >= 0.5), and the `carry` columns.

    Of rows whose id remainder is not `held`, labels set the class prior; about max_labelled of them, by a hash of the id, add lexicon
    entries, equal texts counted once. The label model takes the vote patterns of all such rows, counted in the shuffle.
    The classifier is fitted on each pattern's posterior, with the pattern's mean features, weighted by the log of its count.
    Null or empty text has no hit and is scored as such. Labels may be empty: the prior is then 0.1 and only
    the fixed lexicons vote. A null toxic or doc_id is no label.
    """
    learn = remainder(F.col("doc_id"), mod) != held
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = labels.filter("toxic is not null AND doc_id is not null").filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    about = known.agg(F.avg(F.col("toxic").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    prior = min(0.5, max(0.01, 0.1 if about["p"] is None else about["p"]))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(23), "doc_id"), 11).cast("double") / float(1 << 53)
    some = known.filter(unit < max_labelled / max(1, about["n"]))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")  # some is bounded by max_labelled
    learned = learn_entries(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("text", "toxic"), prior)
    heads = {e.rstrip("*")[: STEMS[0]] for e in learned}

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [features(t, learned, heads) for t in b["text"]]
            v = ["".join("a01"[k + 1] for k in votes(x)) for x in f]
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: b[c] for c in carry}, "learn": b["learn"], "f": f, "v": v})

    carried = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    rows = docs.select("doc_id", *carry, learn.alias("learn"), text_of().alias("text"))
    rows = written(rows.mapInPandas(vote, f"doc_id {id_type}, {carried}learn boolean, f array<double>, v string"))
    means = [F.avg(F.get("f", F.lit(i))).alias(f"f{i}") for i in range(WIDTH)]
    patterns = rows.filter("learn").groupBy("v").agg(F.count(F.lit(1)).alias("n"), *means).orderBy("v").collect()
    beta = np.append(np.zeros(WIDTH), -2.0)
    if patterns:
        v = np.array([["a01".index(c) - 1 for c in r.v] for r in patterns])
        n = np.array([r.n for r in patterns], float)
        x = np.array([[r[f"f{i}"] for i in range(WIDTH)] for r in patterns])
        beta = fit_linear(x, fit_label_model(v, n, prior)[0], np.log1p(n))
    z = F.lit(float(beta[-1]))
    for i in range(WIDTH):
        z = z + F.get("f", F.lit(i)) * float(beta[i])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *carry)
