"""Confusion counts, threshold sweeps, losses and running means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import ranked

#: Image-level thresholds.
CLASS_THRESHOLDS = tuple(round(0.2 + 0.05 * i, 2) for i in range(14))


def rates(tp: Column, fp: Column, fn: Column, eps: float, harmonic: bool) -> dict[str, Column]:
    """Precision, recall, IoU and F1, either as 2 TP over the sum of its parts or as a harmonic mean."""
    p, r = tp / (tp + fp + F.lit(eps)), tp / (tp + fn + F.lit(eps))
    f1 = 2 * p * r / (p + r + F.lit(eps)) if harmonic else 2 * tp / (2 * tp + fp + fn + F.lit(eps))
    return {"precision": p, "recall": r, "f1": f1, "iou": tp / (tp + fp + fn + F.lit(eps))}


def confusion(df: DataFrame, gt: Column, hit: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(n(gt & hit).alias("tp"), n(~gt & hit).alias("fp"), n(gt & ~hit).alias("fn"), n(~gt & ~hit).alias("tn"))


def pixel_metrics(df: DataFrame, gt: Column, hit: Column) -> DataFrame:
    c = confusion(df, gt, hit)
    return c.select("tp", "fp", "fn", "tn", *(F.round(v, 9).alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn"), 1e-8, False).items()))


def image_metrics(df: DataFrame, image: str, gt: Column, probability: Column) -> DataFrame:
    """At each of the class thresholds: an image is positive if any part is, and found if its largest probability is over the threshold."""
    per = df.groupBy(image).agg(F.bool_or(gt).alias("gt"), F.max(probability).alias("p"))
    each = per.withColumn("threshold", F.explode(F.array(*map(F.lit, CLASS_THRESHOLDS))))
    return confusion(each, F.col("gt"), F.col("p") > F.col("threshold"), ["threshold"])


def threshold_sweep(df: DataFrame, gt: Column, level: Column, steps: int = 99) -> DataFrame:
    """Counts at thresholds 0.01 to 0.99 of levels 0 to 255: two histograms of 256 bins, summed from above; a level is found from floor(255 t) + 1 on."""
    hist = df.groupBy(level.cast("int").alias("v")).agg(F.count(F.when(gt, 1)).alias("fg"), F.count(F.when(~gt, 1)).alias("bg"))
    bins = df.sparkSession.range(257).select(F.col("id").cast("int").alias("v")).join(hist, "v", "left").na.fill(0)
    above = Window.orderBy(F.desc("v"))  # of 257 rows
    ge = bins.select("v", F.sum("fg").over(above).alias("tp"), F.sum("bg").over(above).alias("fp"), F.sum("fg").over(Window.partitionBy()).alias("n_fg"), F.sum("bg").over(Window.partitionBy()).alias("n_bg"))
    t = df.sparkSession.range(1, steps + 1).select(F.col("id").alias("step"), (F.expr("cast((255 * id) div 100 as int)") + 1).alias("v"))
    c = t.join(ge, "v").select((F.col("step") / 100).alias("threshold"), "tp", "fp", (F.col("n_fg") - F.col("tp")).alias("fn"), (F.col("n_bg") - F.col("fp")).alias("tn"))
    return c.select("threshold", "tp", "fp", "fn", "tn", *(F.round(v, 9).alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn"), 1e-12, True).items()))


def segment_stats(values: Column, share: float = 0.05) -> dict[str, Column]:
    """Mean, maximum and mean of the largest share of an array."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    k = F.greatest(F.lit(1), F.floor(F.size(values) * share).cast("int"))
    return {"mean": mean(values), "max": F.array_max(values), "top": mean(F.slice(F.sort_array(values, False), F.lit(1), k))}


def focal(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.75) -> Column:
    """Of a probability and a 0/1 label."""
    q = F.when(y == 1, p).otherwise(1 - p)
    return F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - q, F.lit(gamma)) * -F.log(F.greatest(q, F.lit(1e-12)))


def overlap_losses(df: DataFrame, p: Column, y: Column, by: list[str] = [], a: float = 0.3, b: float = 0.7, smooth: float = 1.0) -> DataFrame:  # noqa: B006
    """Dice and Tversky losses."""
    s = lambda x: F.sum(x)
    d = df.groupBy(*by).agg(s(p * y).alias("tp"), s(p * (1 - y)).alias("fp"), s((1 - p) * y).alias("fn"), s(p * p).alias("pp"), s(y * y).alias("yy"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.select(*by, F.round(1 - (2 * tp + smooth) / (F.col("pp") + F.col("yy") + smooth), 9).alias("dice"), F.round(1 - (tp + smooth) / (tp + a * fp + b * fn + smooth), 9).alias("tversky"))


def lovasz(df: DataFrame, by: list[str], p: Column, y: Column, key: str) -> DataFrame:
    """Of each group: errors from large to small, weighted by how the Jaccard loss grows with each."""
    e = df.select(*by, key, y.cast("double").alias("y"), (-F.abs(y - p)).alias("e"))
    r = ranked(e, by, ["e", key], ("y",))
    jaccard = lambda found, k: 1 - (F.col("y_all") - found) / F.nullif(F.col("y_all") + k - found, F.lit(0.0))
    before = F.coalesce(F.when(F.col("at") > 0, jaccard(F.col("y_to") - F.col("y"), F.col("at"))), F.lit(0.0))
    return r.withColumn("grad", jaccard(F.col("y_to"), F.col("at") + 1) - before).groupBy(*by).agg(F.round(F.sum(-F.col("e") * F.col("grad")), 9).alias("lovasz"))


def hard_mean(df: DataFrame, by: list[str], p: Column, y: Column, key: str, threshold: float = 0.7, least: int = 20) -> DataFrame:
    """Mean cross entropy of the hard examples: probability of the truth up to the larger of threshold and the least-th smallest one."""
    q = ranked(df.select(*by, key, F.when(y == 1, p).otherwise(1 - p).alias("q")), by, ["q", key])
    at = q.where(F.col("at") == F.least(F.lit(least), F.col("n_rows") - 1)).select(*by, F.greatest("q", F.lit(threshold)).alias("bound"))
    kept = q.join(at, by).where("q <= bound")
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hard"), F.round(F.avg(-F.log(F.greatest("q", F.lit(1e-12)))), 9).alias("loss"))


def running_mean(df: DataFrame, by: str, order: list[str], value: str, width: int, block: int = 100_000) -> DataFrame:
    """running: mean of the last width values up to each, anew for each by.

    Rows are taken in blocks of their places, each with the width - 1 rows before it, so no task sees all rows of a hot by.
    """
    block = max(block, width)
    r = ranked(df, [by], order).withColumn("block", F.floor(F.col("at") / block))
    tail = (F.col("at") % block >= block - width + 1) & ((F.col("block") + 1) * block < F.col("n_rows"))
    both = r.withColumn("in", F.explode(F.when(tail, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))))
    w = Window.partitionBy(by, "in").orderBy("at").rowsBetween(-(width - 1), 0)
    return both.withColumn("running", F.avg(value).over(w)).where(F.col("in") == F.col("block")).select(*df.columns, "running")


def learning_rate(step: Column, warm: int, total: int, base: float, floor: float) -> Column:
    """Linear up to warm, then half a cosine down; at least floor times base."""
    rise = step / warm
    fall = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warm) / max(1, total - warm)))
    return base * F.greatest(F.lit(floor), F.when(step < warm, rise).otherwise(fall))
