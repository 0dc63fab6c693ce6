"""Mix sources to target weights by iterative proportional fitting; DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, release, text_of, written

DIMS = ("source", "lang", "topic")
TOPICS = 6
MAX_CELLS = 200_000  # that a broadcast may hold
FEATURES = ("symbols", "line", "word")
_SYMBOLS = "0123456789\"'()*+,-./:;<=>?[]_{|}!#"


def text_counts(text: Column) -> list[Column]:
    """White-space tokens, characters, digits and marks, and lines of a text: two passes over it besides the searches for line ends."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return [
        F.size(F.array_remove(F.split(blank, " "), "")).cast("long").alias("n_tokens"), F.length(text).alias("n_letters"),
        F.length(F.translate(text, _SYMBOLS, "")).alias("n_plain"), F.length(F.replace(text, F.lit("\n"), F.lit(""))).alias("n_in_lines"),
    ]


def register_features() -> list[Column]:
    """What tells prose, lists, tables, code and logs apart in any language, from text_counts: the share of digits and marks, log line and word length."""
    n = F.greatest(F.col("n_letters"), F.lit(1)).cast("double")
    values = [
        (F.col("n_letters") - F.col("n_plain")) / n, F.log(1 + n / (1 + F.col("n_letters") - F.col("n_in_lines"))),
        F.log(1 + n / F.greatest(F.col("n_tokens"), F.lit(1))),
    ]
    return [v.alias(name) for v, name in zip(values, FEATURES, strict=True)]


def nearest(point: list[Column], centres: list[list[float]], scale: list[float]) -> Column:
    """Index of the nearest centre, the first of ties."""
    gap = lambda c: sum(((x - F.lit(v)) / F.lit(s)) * ((x - F.lit(v)) / F.lit(s)) for x, v, s in zip(point, c, scale, strict=True))
    return F.array_min(F.array(*[F.struct(gap(c).alias("gap"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def fit_topics(features: DataFrame, k: int = TOPICS, rounds: int = 4) -> tuple[list[list[float]], list[float]]:
    """k centres by Lloyd's steps over all rows, from quantiles of each feature on; and the features' spreads.

    The driver holds k centres only. A centre without rows stays where it was.
    """
    at = [(i + 0.5) / k for i in range(k)]
    row = features.agg(*[F.struct(F.stddev_pop(f).alias("sd"), F.percentile_approx(f, at, 1000).alias("q")).alias(f) for f in FEATURES]).first()
    if row[FEATURES[0]]["q"] is None:
        return [[0.0] * len(FEATURES)] * k, [1.0] * len(FEATURES)
    scale = [max(row[f]["sd"] or 0.0, 1e-6) for f in FEATURES]
    centres = [[row[f]["q"][i] for f in FEATURES] for i in range(k)]
    for _ in range(rounds):
        own = features.withColumn("i", nearest([F.col(f) for f in FEATURES], centres, scale))
        for r in own.groupBy("i").agg(*[F.avg(f).alias(f) for f in FEATURES]).collect():
            centres[r.i] = [r[f] for f in FEATURES]
    return centres, scale


def goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float) -> DataFrame:
    """cells with goal_d, the share of all tokens that the cell's value of each dimension d shall have.

    targets: for some dimensions the weight of each value; values not named have 0. Other dimensions take tokens^alpha. A named value
    with a weight but no tokens cannot be met: an error.
    """
    for d in DIMS:
        named = (targets or {}).get(d)
        have = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("of_value"))
        if named is None:
            goal = F.pow(F.col("of_value"), F.lit(alpha))
        else:
            wanted = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in named.items() if v > 0], f"{d} string, goal double")
            lost = [r[0] for r in wanted.join(have.filter("of_value > 0"), d, "left_anti").select(d).orderBy(d).limit(5).collect()]
            if lost:
                raise ValueError(f"no tokens for the targets of {d}: {lost}")
            have, goal = have.join(F.broadcast(wanted), d, "left"), F.coalesce("goal", F.lit(0.0))  # wanted: the caller's own dict
        have = have.select(d, goal.alias(f"goal_{d}"))
        total = have.agg(F.sum(f"goal_{d}").alias("all"))
        share = F.when(F.col("all") > 0, F.col(f"goal_{d}") / F.col("all")).otherwise(F.lit(0.0))
        cells = cells.join(have.crossJoin(total).select(d, share.alias(f"goal_{d}")), d)  # total is one row
    return cells


def rake(cells: DataFrame, tolerance: float = 1e-5, most: int = 100, passes: int = 5) -> tuple[DataFrame, float]:
    """Weights of the cells (with goals) whose marginals are the goals, and the largest error of a marginal share.

    One row per cell; each pass scales one dimension after the other, and the state is written every few passes so that the plan stays
    short. Passes end when no marginal is off by more than `tolerance`, or after `most`.
    """
    cells = written(cells.withColumn("weight", F.col("tokens").cast("double")))
    error, r = math.inf, 0
    while error > tolerance and r < most:
        for d in DIMS * passes:
            now = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"goal_{d}") / now).otherwise(F.lit(0.0)))
        cells, r = written(cells), r + passes
        off = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"goal_{d}")).alias("e")).select("e") for d in DIMS]
        error = off[0].union(off[1]).union(off[2]).agg(F.max("e").alias("e")).first()["e"] or 0.0
    return cells, error


def calibrated(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float) -> DataFrame:
    """The raked cells. Targets that no weights can meet, as where a source has one language, are an error if they are the caller's;
    powers of the tokens go half-way to the present shares, which always fit, until they can be met."""
    while True:
        fitted, error = rake(goals(cells, targets, alpha))
        if error <= 1e-5:
            return fitted
        if targets or alpha > 0.999:
            raise ValueError(f"the targets cannot be met together: a marginal share stays off by {error:.2g}")
        alpha = (1 + alpha) / 2 if alpha < 0.99 else 1.0


def mixed_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, keep: float = 0.8, seed: int = 17) -> DataFrame:
    """One row per row of docs: row (all its columns), source, lang, topic, n_tokens, ratio, expected, prob, copies, selected.

    Tokens are white-space words; null source, lang or text counts as ''. The tables name no topic: a document's is the nearest of
    TOPICS centres of register features (prose, lists, code and so on), fitted over all rows. targets gives weights by dimension and
    value, else a value's is tokens^alpha; see goals and calibrated. The raked share of a cell over its present share is its ratio;
    expected = keep * ratio is how often a document is to be read, so the expected tokens are `keep` of all and have the raked marginals.
    It is read as often as expected has wholes, and once more when the hash of its id and text falls under the rest: copies. Copies
    under other ids are drawn apart, repeated rows together. selected is copies > 0, prob its probability. A document without tokens
    takes its cell's figures, or 1 where the cell has no tokens. The sampling is the feature: unselected rows are marked. Rows do not move; cells (sources x languages x TOPICS) are broadcast where a count bounds them.
    """
    t = text_of()
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    seen = written(docs.select(label("source"), label("lang"), *text_counts(t)).select("source", "lang", "n_tokens", *register_features()))
    centres, scale = fit_topics(seen)
    topic = lambda point: F.concat(F.lit("t"), nearest(point, centres, scale).cast("string")).alias("topic")
    cells = written(seen.select("source", "lang", topic([F.col(f) for f in FEATURES]), "n_tokens").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    release(seen)
    fitted = calibrated(cells, targets, alpha)
    total = fitted.agg(F.sum("tokens").alias("all")).first()["all"] or 1
    some = F.col("tokens") > 0
    ratio = F.when(some, F.col("weight") * total / F.col("tokens")).otherwise(F.lit(1.0)).alias("ratio")
    rates = written(fitted.select(*DIMS, ratio, some.alias("some")).select(*DIMS, "ratio", F.when(F.col("some"), F.col("ratio") * keep).otherwise(F.lit(1.0)).alias("expected")))
    rates = bounded_broadcast(rates, MAX_CELLS)
    # counts and features are projections of their own, as each is read several times
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), label("source"), label("lang"),
        *text_counts(t), F.xxhash64(F.lit(seed), F.col("doc_id"), t).alias("draw"),
    ).select("row", "source", "lang", "n_tokens", "draw", *register_features()).withColumn("topic", topic([F.col(f) for f in FEATURES]))
    unit = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    whole = F.floor("expected")
    copies = (whole + F.when(unit < F.col("expected") - whole, 1).otherwise(0)).cast("int")
    # no key is null; null-safe keys keep Spark from looking for nulls, which would work out the topic's expression before the projections
    same = reduce(Column.__and__, [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in DIMS])
    drawn = d.alias("d").join(rates.alias("r"), same, "left").withColumn("copies", copies)
    return drawn.select("row", *[f"d.{c}" for c in DIMS], "n_tokens", "ratio", "expected", F.least(F.lit(1.0), F.col("expected")).alias("prob"), "copies", (F.col("copies") > 0).alias("selected"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = 0.7, keep: float = 0.8, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, n_tokens, ratio, expected, prob, copies, selected; see mixed_rows."""
    return mixed_rows(docs, targets, alpha, keep, seed).select("row.doc_id", *DIMS, "n_tokens", "ratio", "expected", "prob", "copies", "selected")
