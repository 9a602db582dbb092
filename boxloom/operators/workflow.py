"""Validation of image and mask pairs, resumption of unfinished work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Outcomes in order of the checks.
REASONS = ("ok", "missing_image", "missing_mask", "read_fail_image", "read_fail_mask", "too_small_image", "shape_mismatch")
LEAST_BYTES = 2048


def validate(images: DataFrame, masks: DataFrame) -> DataFrame:
    """name, reason, delete_image, delete_mask of each name of either side (name, bytes, w, h); a null width means unreadable."""
    i, m = (df.select("name", *(F.col(c).alias(f"{p}_{c}") for c in ("bytes", "w", "h")), F.lit(True).alias(p)) for df, p in ((images, "i"), (masks, "m")))
    reason = (
        F.when(F.col("i").isNull(), "missing_image").when(F.col("m").isNull(), "missing_mask")
        .when(F.col("i_bytes") < LEAST_BYTES, "too_small_image").when(F.col("i_w").isNull(), "read_fail_image").when(F.col("m_w").isNull(), "read_fail_mask")
        .when((F.col("i_w") != F.col("m_w")) | (F.col("i_h") != F.col("m_h")), "shape_mismatch").otherwise("ok")
    )
    bad = F.col("reason") != "ok"
    return i.join(m, "name", "full_outer").withColumn("reason", reason).select(
        "name", "reason", (bad & F.col("i").isNotNull()).alias("delete_image"), (bad & F.col("m").isNotNull()).alias("delete_mask")
    )


def report(validated: DataFrame) -> DataFrame:
    """Every reason and how often it is, 0 included."""
    all_ = validated.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    counts = validated.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("delete_image"), 1)).alias("n_images"), F.count(F.when(F.col("delete_mask"), 1)).alias("n_masks"))
    return F.broadcast(all_).join(counts, "reason", "left").na.fill(0)


def resume(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """item, tag, factor, n (produced), left to make and over the factor."""
    n = produced.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"))
    d = expected.join(n, "item", "left").na.fill(0, ["n"])
    return d.withColumns({"left": F.greatest(F.lit(0), F.col("factor") - F.col("n")), "over": F.greatest(F.lit(0), F.col("n") - F.col("factor"))})


def over_production(resumed: DataFrame) -> DataFrame:
    """Of each tag what is left and over, and the item of most over (of ties the first)."""
    worst = F.max_by("item", F.struct("over", -F.col("item")))
    return resumed.groupBy("tag").agg(F.sum("left").cast("long").alias("left"), F.sum("over").cast("long").alias("over"), F.when(F.max("over") > 0, worst).alias("worst"))


def expand(resumed: DataFrame) -> DataFrame:
    """Items as often as they are left to make."""
    return resumed.where("left > 0").withColumn("idx", F.explode(F.expr("sequence(0, left - 1)")))


def in_order(by: str, *order: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(*order)


def costly_tries(df: DataFrame, by: str, order: list[str], seconds: str) -> DataFrame:
    """tries: of each by up to each row, one a row and one less than the whole seconds that it took, if that is more than none."""
    cost = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0))).cast("long") - 1)
    return df.withColumn("tries", F.sum(1 + cost).over(in_order(by, *order).rowsBetween(Window.unboundedPreceding, 0)))


def memory_bank(df: DataFrame, by: str, step: str, item: str, steps: int = 3, most: int = 512) -> DataFrame:
    """What a bank of each by holds after each step: of each of the last steps steps at most most items, by hash.

    n_held, oldest (the first step of which something is held) and items; banks that hold nothing have no row. A bank is one row of at most
    steps * most items.
    """
    first = Window.partitionBy(by, step).orderBy(F.md5(F.concat(F.col(item).cast("string"), F.lit(":bank")).cast("binary")), item)
    kept = df.select(by, step, item).withColumn("bank_place", F.row_number().over(first)).where(F.col("bank_place") <= most)
    held = kept.select(by, F.col(step).alias("bank_of"), item, F.explode(F.sequence(F.col(step), F.col(step) + steps - 1)).alias(step))
    there = df.select(step).distinct()
    return held.join(there, step).groupBy(by, step).agg(F.count(F.lit(1)).alias("n_held"), F.min("bank_of").alias("oldest"), F.array_sort(F.collect_list(F.struct((-F.col("bank_of")).alias("age"), item))).alias("items"))
