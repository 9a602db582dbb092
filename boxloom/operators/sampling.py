"""Samples by hash: with and without replacement, by factor, by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .groups import ranked


def sample(df: DataFrame, groups: list[str], key: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows of each group without replacement, with their place in the draw."""
    w = Window.partitionBy(*groups).orderBy(uniform(key, salt), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def fill(df: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    """Each group's rows in order of key, and rows drawn with replacement until there are n; place from 0."""
    placed = ranked(df, groups, [key]).withColumn("have", F.col("n_rows").cast("int")).drop("n_rows")
    group = placed.groupBy(*groups).agg(F.max("have").alias("have")).withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(F.col("have"), F.lit(n)) - 1)))
    name = F.concat_ws(":", *(F.col(g).cast("string") for g in groups), F.col("place").cast("string"))
    group = group.withColumn("at", F.when(F.col("place") < F.col("have"), F.col("place")).otherwise(F.floor(uniform(name, "fill") * F.col("have")).cast("int")))
    return group.join(placed.drop("have"), [*groups, "at"]).drop("at", "have")


def upsample(df: DataFrame, key: str, factor: str) -> DataFrame:
    """Rows as often as their factor says, numbered from 1; a factor under 1 is the chance to stay. Other factors must be whole."""
    times = F.when(F.col(factor) < 1, F.when(uniform(key, "upsample") < F.col(factor), 1).otherwise(0)).otherwise(F.col(factor).cast("int"))
    return df.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def balanced(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """Of each class as many rows, by hash, as the smallest class has, and at most most."""
    least = df.groupBy(label).count().agg(F.least(F.min("count"), F.lit(most)).alias("cap"))
    cap = least.first()["cap"] or 0
    return sample(df, [label], key, cap, "balanced")
