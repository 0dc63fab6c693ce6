"""Document probability with every segmentation of each word counted, over an existing subword vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, remainder, text_of, written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACES = "\t\n\x0b\x0c\r"  # each becomes a blank
START = "▁"
END = "\n"  # no word holds it
PRIOR = 200.0  # uses of pieces that the file's order counts for
STEPS = 2  # expectation steps, each over every training word
LONG = 200  # characters from which a word is run alone
BLOCK_BYTES = 16 << 20


def load_scores(path: str = PIECES) -> dict[str, float]:
    """Natural-log unigram scores of the file's pieces, lower-cased: the file's order gives a Zipf weight."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mass: Counter = Counter()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i)):
            mass[p if model.is_byte(i) else p.translate(str.maketrans(UPPER, UPPER.lower()))] += 1 / (i + 10)
    total = math.log(sum(mass.values()))
    return {p: math.log(m) - total for p, m in mass.items()}


def _edges(s: str, i: int, scores: dict, longest: int, byte: list[float]):
    known = False
    for j in range(i + 1, min(len(s), i + longest) + 1):
        v = scores.get(s[i:j])
        if v is not None:
            known = known or j == i + 1
            yield j, v
    if not known:  # the bytes of one character
        yield i + 1, sum(byte[b] for b in s[i].encode("utf-8", "replace"))


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def forward(word: str, scores: dict[str, float], longest: int, byte: list[float]) -> list[float]:
    """Log-space forward recursion: entry i is the log sum over all segmentations of the first i characters."""
    s = START + word
    alpha = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        for j, v in _edges(s, i, scores, longest, byte):
            alpha[j] = _log_add(alpha[j], alpha[i] + v)
    return alpha


class Lattice:
    """The same recursion for many words at once: words of one length run together, substrings are found by hash."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest, self.byte = scores, max(map(len, scores)), _bytes_of(scores)
        self.pieces = sorted(scores)
        keys = np.zeros(len(self.pieces), np.uint64)
        size = np.array([len(p) for p in self.pieces])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            keys[at] = _hash_rows(_codes([self.pieces[k] for k in at], int(n)))
        self.order = np.argsort(keys)
        self.keys, self.value = keys[self.order], np.array([scores[p] for p in self.pieces])[self.order]
        self.place = {self.pieces[k]: i for i, k in enumerate(self.order)}
        self.byte_place = [self.place.get(f"<0x{b:02X}>") for b in range(256)]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece, and the pieces."""
        rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
        ok = self.keys[at] == h[rows]
        return rows[ok], at[ok]

    def run(self, words: list[str], counts: np.ndarray | None = None, uses: np.ndarray | None = None) -> np.ndarray:
        """Log marginals; with counts, the expected uses of each piece, in words used `uses` times, are added to it."""
        out, by_len = np.zeros(len(words)), {}
        uses = np.ones(len(words)) if uses is None else uses
        for k, w in enumerate(words):
            by_len.setdefault(len(w) + 1, []).append(k)
        for n, ks in by_len.items():
            if n > LONG:
                for k in ks:
                    out[k] = self._alone(START + words[k], counts, uses[k])
                continue
            step = max(1, 200_000 // n)
            for lo in range(0, len(ks), step):
                part = ks[lo : lo + step]
                out[part] = self._same_length([START + words[k] for k in part], n, counts, uses[part])
        return out

    def _alone(self, s: str, counts: np.ndarray | None, uses: float) -> float:
        """One very long word, in time linear in its length."""
        edges = [list(_edges(s, i, self.scores, self.longest, self.byte)) for i in range(len(s))]
        alpha, beta = [0.0] + [-math.inf] * len(s), [-math.inf] * len(s) + [0.0]
        for i, out in enumerate(edges):
            for j, v in out:
                alpha[j] = _log_add(alpha[j], alpha[i] + v)
        if counts is not None:
            at = self.place
            for i in range(len(s) - 1, -1, -1):
                for j, v in edges[i]:
                    beta[i] = _log_add(beta[i], v + beta[j])
                    share = uses * math.exp(min(0.0, alpha[i] + v + beta[j] - alpha[-1]))
                    if (k := at.get(s[i:j])) is not None:
                        counts[k] += share
                    else:
                        self._count_bytes(s[i], share, counts)
        return alpha[-1]

    def _count_bytes(self, char: str, share: float, counts: np.ndarray) -> None:
        """The uses of a character outside the vocabulary are uses of its bytes' pieces."""
        for b in char.encode("utf-8", "replace"):
            if (k := self.byte_place[b]) is not None:
                counts[k] += share

    def _same_length(self, texts: list[str], n: int, counts: np.ndarray | None, uses: np.ndarray) -> np.ndarray:
        codes = _codes(texts, n)
        alpha = np.full((n + 1, len(texts)), -np.inf)
        alpha[0] = 0
        edges, free = [], np.ones(len(texts), bool)
        for i in range(n):
            h = np.zeros(len(texts), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = _hash_step(h, codes[:, j - 1])
                rows, at = self._find(h)
                if j == i + 1:
                    free[:] = True
                    free[rows] = False
                    lone = np.flatnonzero(free)
                    if lone.size:
                        chars, back = np.unique(codes[lone, i], return_inverse=True)
                        cost = np.array([sum(self.byte[b] for b in chr(int(c)).encode("utf-8", "replace")) for c in chars])[back]
                        alpha[j, lone] = np.logaddexp(alpha[j, lone], alpha[i, lone] + cost)
                        edges.append((i, j, lone, None, cost))
                if rows.size:
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.value[at])
                    edges.append((i, j, rows, at, None))
            if counts is None:
                edges.clear()
        if counts is not None:
            beta = np.full((n + 1, len(texts)), -np.inf)
            beta[n] = 0
            for i, j, rows, at, cost in sorted(edges, key=lambda e: -e[0]):
                v = (self.value[at] if cost is None else cost) + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], v)
                share = uses[rows] * np.exp(np.minimum(0, alpha[i, rows] + v - alpha[n, rows]))
                if at is not None:
                    counts += np.bincount(at, share, len(counts))
                else:
                    chars, back = np.unique(codes[rows, i], return_inverse=True)
                    for c, x in zip(chars, np.bincount(back, share), strict=True):
                        self._count_bytes(chr(int(c)), x, counts)
        return alpha[n]


def _hash_step(h, c):
    with np.errstate(over="ignore"):
        h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = _hash_step(h, codes[:, j])
    return h


def _codes(texts: list[str], n: int) -> np.ndarray:
    """Code points of texts of n characters, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), n).astype(np.uint64)


def _bytes_of(scores: dict) -> list[float]:
    return [scores.get(f"<0x{b:02X}>", -20.0) for b in range(256)]


def refit(counted: DataFrame, scores: dict[str, float], ends: int) -> dict[str, float]:
    """One expectation step over words with their counts; a row per piece of the file returns. `ends` documents end."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(scores)
        got = np.zeros(len(lattice.keys))
        for b in batches:
            lattice.run(list(b["word"]), got, b["c"].to_numpy(np.float64))
        at = np.flatnonzero(got)
        if at.size:
            yield pd.DataFrame({"piece": [lattice.pieces[lattice.order[k]] for k in at], "x": got[at]})

    counts = counted.filter(F.col("word") != END).select("word", "c").mapInPandas(run, "piece string, x double")
    found = {r.piece: r.x for r in counts.groupBy("piece").agg(F.sum("x").alias("x")).collect()}
    mass = {p: found.get(p, 0.0) + PRIOR * math.exp(v) for p, v in scores.items() if p != END}
    mass[END] = ends + 1.0
    total = math.log(sum(mass.values()))
    return {p: math.log(m) - total for p, m in mass.items()}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words of each block's part, with training counts."""
    for b in batches:
        for block, g in b.groupby("block"):
            every: Counter = Counter()
            train: Counter = Counter()
            for text, learn in zip(g["text"], g["learn"], strict=True):
                ws = [w for w in text.split(" ") if w]
                (train if learn else every).update(ws)
                (train if learn else every)[END] += 1
            names = list(train.keys() | every.keys())
            yield pd.DataFrame({"block": block, "word": names, "n": [train.get(w, 0) for w in names]})


class Fitted:
    """Words of the corpus by block, their training counts, and the pieces' log probabilities fitted on the training rows."""

    def __init__(self, docs: DataFrame, train_rest: tuple[int, int] = (10, 0), pieces: str = PIECES):
        n_mod, out = train_rest
        t = F.translate(text_of(), UPPER + SPACES, UPPER.lower() + " " * len(SPACES))
        size = docs.select(F.sum(F.length(text_of())).alias("s")).first()["s"] or 0
        blocks = max(1, math.ceil(size / BLOCK_BYTES))
        learn = remainder(F.col("doc_id"), n_mod) != out
        self.rows = docs.select("doc_id", learn.alias("learn"), t.alias("text"), F.pmod(F.xxhash64("doc_id", t), F.lit(blocks)).cast("int").alias("block"))
        self.per_block = written(self.rows.repartition("block").mapInPandas(_count, "block int, word string, n long"))
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, blocks)  # the lattice costs far more than its bytes
        self.vocab = written(self.per_block.groupBy("word").agg(F.sum("n").alias("c")).repartition(tasks, "word"))
        ends = F.max(F.when(F.col("word") == END, F.col("c")))
        row = self.vocab.agg(F.sum("c").alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V"), ends.alias("ends")).first()
        self.N, self.V = row["N"] or 0, row["V"] or 0
        scores = load_scores(pieces)
        for _ in range(STEPS):
            scores = refit(self.vocab.filter(F.col("c") >= 1), scores, row["ends"] or 0)
        self.scores = scores


def score_documents(docs: DataFrame, train_rest: tuple[int, int] = (10, 0), pieces: str = PIECES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The score is the log10 marginal probability of the text: a forward recursion over the lattice of all segmentations into the
    file's pieces, which splits at word starts since no piece crosses one, times the end piece. The file's own scores are
    merge ranks, so its order gives Zipf weights, and two expectation steps over the training rows' words fit the pieces'
    probabilities; nothing else is tuned. Corpus counts are kept per distinct word and joined by word; documents and
    the counts and prices of their words meet in blocks of about 16 MB. Null or empty text is the end token alone;
    repeated rows are each scored and each counted.
    """
    fit = Fitted(docs, train_rest, pieces)
    scores, N, V = fit.scores, fit.N, fit.V

    def lattice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Lattice(scores)
        for b in batches:
            lp = np.where(b["word"] == END, scores[END], model.run(list(b["word"])))
            yield pd.DataFrame({"word": b["word"], "c": b["c"], "lp": lp / math.log(10)})

    priced = fit.vocab.mapInPandas(lattice, "word string, c long, lp double")
    prices = fit.per_block.select("block", "word").distinct().join(priced, "word").select("block", "word", "c", "lp")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def price(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {w: i for i, w in enumerate(right["word"])}
        c, lp = right["c"].to_numpy(np.float64), right["lp"].to_numpy()
        base, known = np.log10((c + 0.1) / (N + 0.1 * (V + 1))), c > 0
        rows = []
        for text in left["text"]:
            own = np.array([at[w] for w in text.split(" ") if w] + [at[END]])
            rows.append((len(own), int(known[own].sum()), float(base[own].sum()), float(lp[own].sum())))
        n, k, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"doc_id": left["doc_id"], "held_out": ~left["learn"].astype(bool), "n_tokens": n, "n_known": k, "train_tokens": N, "base_score": b, "score": s})

    return fit.rows.groupBy("block").cogroup(prices.groupBy("block")).applyInPandas(
        price, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
