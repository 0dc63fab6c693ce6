"""Set scorers as column expressions: element encoder, pooling by shuffle, read-out, masked linear head.

Layers are small literal matrices (up to about 20 wide), so that they stay inside generated code; the data
moves only for the poolings, which combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import gelu, layer_norm, leaky_relu, sigmoid

SLOPE = 0.01  # of the leaky rectifier
NEUTRAL = 0.5  # score of an absent set
UNITS = {"gelu": gelu, "leaky_relu": leaky_relu}
POOLS = {"sum": F.sum, "mean": F.avg, "sqrt_sum": lambda c: F.sum(c) / F.sqrt(F.count(c)), "max": F.max}

Layer = tuple[list[list[float]], list[float]]  # rows of weights, biases


def dense(v: list[Column], layer: Layer, activate: bool = True) -> list[Column]:
    """One linear layer over scalar columns, with a leaky rectifier unless it is the last."""
    out = []
    for row, bias in zip(*layer, strict=True):
        if len(row) != len(v):
            raise ValueError(f"layer takes {len(row)} inputs, got {len(v)}")
        z = F.lit(float(bias))
        for x, w in zip(v, row, strict=True):
            z = z + x * float(w)
        out.append(F.when(z > 0, z).otherwise(z * SLOPE) if activate else z)
    return out


def _pooled(rows: DataFrame, keys: list[str], cols: list[str], how: str) -> DataFrame:
    """Each column pooled by keys: sum, mean, sqrt_sum (sum by the root of the number) or max; all combine on the map side."""
    if how not in POOLS:
        raise ValueError(f"unknown pool {how!r}")
    return rows.groupBy(*keys).agg(*[POOLS[how](c).alias(c) for c in cols])


def flat_score(items: DataFrame, keys: list[str], v: list[str], encode: Layer, read: Layer, pool: str = "max") -> DataFrame:
    """keys and score: encode each item, pool per unit by keys, read out, squash.

    Items with a null input are not observed; a set left without items is absent from the result.
    """
    seen = items.dropna(subset=[*v, *keys])
    h = dense([F.col(c) for c in v], encode)
    names = [f"h{i}" for i in range(len(h))]
    pooled = _pooled(seen.select(*keys, *[x.alias(n) for n, x in zip(names, h, strict=True)]), keys, names, pool)
    return pooled.select(*keys, sigmoid(dense([F.col(f"h{i}") for i in range(len(h))], read, False)[0]).alias("score"))


def layered_score(items: DataFrame, keys: list[str], region: str, kind: str, v: list[str], kinds: dict[int, list[float]], encode: Layer, encode_region: Layer, read: Layer,
                  item_pool: str = "max", region_pool: str = "max") -> DataFrame:
    """keys and score: items pool into regions, regions with their kind's vector are encoded and pool into sets; each pool is chosen by name."""
    h = dense([F.col(c) for c in v], encode)
    n = len(h)
    parts = items.dropna(subset=[*v, *keys, region, kind]).select(*keys, region, kind, *[x.alias(f"h{i}") for i, x in enumerate(h)])
    regions = _pooled(parts, [*keys, region, kind], [f"h{i}" for i in range(n)], item_pool)
    of_kind = []
    for j in range(len(next(iter(kinds.values())))):
        c = F.lit(0.0)  # an unknown kind has the zero vector
        for k, vec in kinds.items():
            c = F.when(F.col(kind) == k, F.lit(float(vec[j]))).otherwise(c)
        of_kind.append(c)
    g = dense([*[F.col(f"h{i}") for i in range(n)], *of_kind], encode_region)
    return flat_pool(regions.select(*keys, *[x.alias(f"g{i}") for i, x in enumerate(g)]), keys, [f"g{i}" for i in range(len(g))], read, region_pool)


def flat_pool(encoded: DataFrame, keys: list[str], cols: list[str], read: Layer, pool: str = "max") -> DataFrame:
    pooled = _pooled(encoded, keys, cols, pool)
    return pooled.select(*keys, sigmoid(dense([F.col(c) for c in cols], read, False)[0]).alias("score"))


def masked_head(scores: DataFrame, weights: DataFrame, sample: str, gene: str) -> DataFrame:
    """Per sample and output: sum of (score - 0.5) * weight over genes whose mask is set; absent genes add 0.

    weights: gene, output, weight, mask.
    """
    used = weights.filter("mask").select(gene, "output", "weight")
    return scores.join(used, gene).groupBy(sample, "output").agg(F.sum((F.col("score") - NEUTRAL) * F.col("weight")).alias("value"))


def linear_head(scores: DataFrame, weights: DataFrame, sample: str, gene: str, bias: DataFrame, covariates: DataFrame | None = None, covariate_weights: DataFrame | None = None) -> DataFrame:
    """(sample, output, value) for every sample and output: masked_head plus the output's bias, plus its weighted covariates.

    scores: sample, gene, score. bias: output, bias. covariates: sample, name, x; covariate_weights: output, name, weight. A sample
    without masked genes has its bias. A head with covariate weights needs covariates, one without takes none, and a sample that lacks
    one of the names, or has another, fails the job.
    """
    if covariate_weights is not None and covariates is None:
        raise ValueError("covariates are required for this head")
    if covariate_weights is None and covariates is not None:
        raise ValueError("covariates were supplied to a head configured without them")
    grid = scores.select(sample).distinct().crossJoin(F.broadcast(bias))  # a row a value of the result
    out = grid.join(masked_head(scores, weights, sample, gene), [sample, "output"], "left").withColumn("value", F.col("bias") + F.coalesce("value", F.lit(0.0)))
    if covariates is None:
        return out.select(sample, "output", "value")
    names = covariate_weights.select("name").distinct()
    n = names.count()
    known = covariates.join(F.broadcast(names.withColumn("known", F.lit(True))), "name", "left")  # a row per covariate
    have = known.groupBy(sample).agg(F.count_distinct(F.when(F.col("known"), F.col("name"))).alias("n_known"), F.count(F.lit(1)).alias("n_all"))
    add = known.filter("known").join(F.broadcast(covariate_weights), "name").groupBy(sample, "output").agg(F.sum(F.col("x") * F.col("weight")).alias("of_covariates"))
    full = (F.coalesce("n_known", F.lit(0)) == n) & (F.coalesce("n_all", F.lit(0)) == n)
    checked = F.when(full, F.col("value") + F.col("of_covariates")).otherwise(F.raise_error(F.concat(F.lit("covariates of a sample do not fit the head: "), F.col(sample).cast("string"))).cast("double"))
    return out.join(have, sample, "left").join(add, [sample, "output"], "left").select(sample, "output", checked.alias("value"))


def task_heads(scores: DataFrame, weights: DataFrame, sample: str, gene: str) -> DataFrame:
    """Per sample, both kinds of head: raw, the sum of score * weight over the sets that are there (regression and two-class tasks), and
    centred, that of (score - 0.5) * weight over masked ones (class tasks)."""
    j = scores.join(weights, gene)
    return j.groupBy(sample).agg(F.sum(F.col("score") * F.col("weight")).alias("raw"), F.sum(F.when(F.col("mask"), (F.col("score") - NEUTRAL) * F.col("weight"))).alias("centred"))


def with_absent(scores: DataFrame, samples: DataFrame, sets: DataFrame, sample: str, name: str) -> DataFrame:
    """Every sample with every set: sets that were not observed score NEUTRAL and are not present. The grid is the result's own size."""
    grid = samples.select(sample).crossJoin(sets.select(name))
    j = grid.join(scores, [sample, name], "left")
    return j.select(sample, name, F.coalesce("score", F.lit(NEUTRAL)).alias("score"), F.col("score").isNotNull().alias("present"))


def network(rows: DataFrame, keys: list[str], v: list[str], layers: list[Layer], activation: str = "gelu", norm: bool = True) -> DataFrame:
    """keys and y0, y1, ...: linear layers with layer norm (unless norm is off) and a unit (gelu or leaky_relu) between, none after the last.

    Each layer is a projection of its own.
    """
    if activation not in UNITS:
        raise ValueError(f"unsupported activation: {activation}")
    names = v
    for i, layer in enumerate(layers):
        z = dense([F.col(c) for c in names], layer, False)
        rows = rows.select(*keys, *[x.alias(f"y{j}") for j, x in enumerate(z)])
        names = [f"y{j}" for j in range(len(z))]
        if i < len(layers) - 1:
            if norm:
                rows = rows.select(*keys, *[x.alias(f"y{j}") for j, x in enumerate(layer_norm([F.col(c) for c in names]))])
            rows = rows.select(*keys, *[UNITS[activation](F.col(c)).alias(c) for c in names])
    return rows


def cross_entropy(logits: list[Column], cls: Column) -> Column:
    """Negative log likelihood of class cls (0-based) under the logits, shifted by their maximum."""
    top = F.greatest(*logits)
    total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
    return F.log(total) + top - F.get(F.array(*logits), cls)
