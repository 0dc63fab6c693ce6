"""Transforms, losses and evaluation metrics as columns and aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sums


def m_value(beta: Column, eps: float = 1e-6) -> Column:
    b = F.least(F.greatest(beta, F.lit(eps)), F.lit(1 - eps))
    return F.log2(b / (1 - b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def masked_mean(loss: Column, mask: Column) -> Column:
    """0, not null, where the mask is empty."""
    return F.coalesce(F.avg(F.when(mask, loss)), F.lit(0.0))


def by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    """Counts per distinct score, so that later windows see scores and not rows."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def two_classes(df: DataFrame, y: str) -> DataFrame:
    """df with y as 0 and 1, the greater class being 1; other than two classes is an error."""
    found = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"binary metrics need two classes, got {found}")
    return df.withColumn(y, (F.col(y) == found[1]).cast("int"))


def auroc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve, ties half; sums run over range partitions of the distinct scores."""
    c = running_sums(by_score(df, score, y), [F.col("s")], ["neg"])
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)
    return c.agg(F.round(F.sum(won) / F.sum("pos") / F.sum("neg"), 8).alias("auroc"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    c = running_sums(by_score(df, score, y).withColumn("both", F.col("pos") + F.col("neg")), [F.desc("s")], ["pos", "both"])
    precision = (F.col("before_pos") + F.col("pos")) / (F.col("before_both") + F.col("both"))
    return c.agg(F.round(F.sum(F.col("pos") * precision) / F.sum("pos"), 8).alias("average_precision"))


def confusion(df: DataFrame, y: str, p: str, k: int) -> DataFrame:
    """All k x k cells (true_class, said_class, n); rows with a class outside 0..k-1 are left out."""
    spark = df.sparkSession
    grid = spark.range(k).select(F.col("id").alias("true_class")).crossJoin(spark.range(k).select(F.col("id").alias("said_class")))  # k x k cells
    inside = df.filter(F.col(y).between(0, k - 1) & F.col(p).between(0, k - 1))
    n = inside.groupBy(F.col(y).cast("long").alias("true_class"), F.col(p).cast("long").alias("said_class")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["true_class", "said_class"], "left").select("true_class", "said_class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def macro_scores(cells: DataFrame) -> DataFrame:
    """accuracy, macro_f1 and balanced_accuracy over all classes of a confusion table, empty ones counting 0."""
    rows = cells.groupBy(F.col("true_class").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("said_class"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("said_class").alias("c")).agg(F.sum("n").alias("said"))
    j = rows.join(cols, "c")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    f1, recall = ratio(2 * F.col("tp"), F.col("support") + F.col("said")), ratio(F.col("tp"), F.col("support"))
    return j.agg(
        F.round(ratio(F.sum("tp"), F.sum("support")), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.avg(recall), 6).alias("balanced_accuracy"),
    )


def regression_scores(df: DataFrame, y: str, p: str, keys: list[str]) -> DataFrame:
    """n, mae, rmse and r by keys; r only with two rows or more and spread on both sides."""
    e = F.col(p) - F.col(y)
    spread = (F.count(F.lit(1)) >= 2) & (F.stddev_pop(y) > 0) & (F.stddev_pop(p) > 0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.when(spread, F.corr(y, p)), 6).alias("r"),
    )


def standardise(df: DataFrame, x: str, train: Column, name: str = "z") -> DataFrame:
    """(x - mean) / sd with population statistics of the training rows; an sd under 1e-6 counts as 1."""
    s = df.agg(F.avg(F.when(train, F.col(x))).alias("m"), F.stddev_pop(F.when(train, F.col(x))).alias("sd"))
    sd = F.when(F.col("sd") >= 1e-6, F.col("sd")).otherwise(F.lit(1.0))
    return df.crossJoin(s).withColumn(name, (F.col(x) - F.col("m")) / sd).drop("m", "sd")  # s is one row


#: The published rational pieces of the error function (W. J. Cody, Mathematics of Computation 23, 1969), highest power first
#: but for the lone leading terms: up to 0.46875 in x^2; up to 4 in x; beyond in 1 / x^2.
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03),
    (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
     1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
     3.43936767414372164e03, 1.23033935480374942e03),
)
ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(x: Column, pieces: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + c, p[1:], F.lit(p[0])) for p in pieces)
    return top / bottom


def erf(x: Column) -> Column:
    """The error function to about 1e-15; null and NaN stay, infinities are 1 and -1."""
    y = F.abs(x.cast("double"))
    sq = y * y
    far = F.exp(-sq) / y * (1 / math.sqrt(math.pi) - _ratio(1 / sq, ERFC_FAR) / sq)
    tail = F.when(y <= 4.0, F.exp(-sq) * _ratio(y, ERFC_MIDDLE)).when(y > 26.0, F.lit(0.0)).otherwise(far)
    return F.when(F.isnan(y), y).when(y <= 0.46875, x * _ratio(sq, ERF_NEAR)).when(x > 0, 1 - tail).otherwise(tail - 1)


def gelu(x: Column) -> Column:
    """Gaussian error linear unit, by the error function itself."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def rms_norm(v: list[Column], eps: float = 1e-6) -> list[Column]:
    mean = sum((x * x for x in v[1:]), v[0] * v[0]) / len(v)
    return [x / F.sqrt(mean + eps) for x in v]


def layer_norm(v: list[Column], eps: float = 1e-5) -> list[Column]:
    mean = sum(v[1:], v[0]) / len(v)
    var = sum(((x - mean) * (x - mean) for x in v[1:]), (v[0] - mean) * (v[0] - mean)) / len(v)
    return [(x - mean) / F.sqrt(var + eps) for x in v]


def multitask_loss(df: DataFrame, tasks: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """One row: loss_t and n_t per task (loss, mask, weight), and their weighted sum; an unobserved task adds 0."""
    each = [x for t, (loss, mask, _) in tasks.items() for x in (masked_mean(loss, mask).alias(f"loss_{t}"), F.count_if(mask).alias(f"n_{t}"))]
    total = sum((F.lit(w) * F.col(f"loss_{t}") for t, (_, _, w) in tasks.items()), F.lit(0.0))
    return df.agg(*each).withColumn("loss", total)


def class_report(df: DataFrame, y: str, p: str, classes: DataFrame) -> DataFrame:
    """Per class of `classes` (column cls): support, precision, recall and F1, 0 where undefined."""
    true = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(y) == F.col(p)).alias("tp"))
    said = df.groupBy(F.col(p).alias("cls")).agg(F.count(F.lit(1)).alias("said"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = classes.join(true, "cls", "left").join(said, "cls", "left").select("cls", zero("support").alias("support"), zero("tp").alias("tp"), zero("said").alias("said"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("said") > 0, 2 * F.col("tp") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return j.select("cls", "support", F.round(part("tp", "said"), 6).alias("precision"), F.round(part("tp", "support"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def class_weights(df: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    """Balanced weights of all classes (column `col` of classes), counts clamped to 1: their sum over K times the class's."""
    n = classes.select(col).distinct().join(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), col, "left").select(col, F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    every = Window.partitionBy()  # a row per class
    return n.select(col, F.round(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), 6).alias("weight"))
