"""Pairs for contrastive training: positives on a line, tiered negatives, stratified bins, quotas, ill-defined crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform


def positive_pairs(lines: DataFrame, near: int = 600, anchors: int = 32) -> DataFrame:
    """Boxes of one line, text length and size, at most a pixel apart in height, less than near apart and side by side; both ways, for the first anchors of a document by hash."""
    keys = ["filename", "line_id", "len_text", "Height", "Width"]
    a, b = lines.alias("a"), lines.alias("b")
    on = F.col("a.box_id") != F.col("b.box_id")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    apart = (F.col("a.W_g") <= F.col("b.W_d")) | (F.col("b.W_g") <= F.col("a.W_d"))
    pairs = a.join(b, on & (F.abs(F.col("a.H_b") - F.col("b.H_b")) <= 1) & (F.abs(F.col("a.W_d") - F.col("b.W_d")) < near) & apart)
    found = pairs.groupBy("a.filename", F.col("a.box_id").alias("anchor")).agg(F.array_sort(F.collect_list("b.box_id")).alias("positives"))
    w = Window.partitionBy("filename").orderBy(uniform(F.concat_ws(":", "filename", F.col("anchor").cast("string")), "anchor"), "anchor")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= anchors)


def negatives(anchors: DataFrame, df: DataFrame, cap: int = 256) -> DataFrame:
    """For each anchor (with positives) other boxes of its document in tiers of ratio: 1 within a tenth, 2 within 0.8 to 1.25, 3 any of equal length; rows nearer than gap in height and its positives are out; the first cap by tier, ratio and box."""
    a, b = anchors.alias("a"), df.alias("b")
    gap = F.greatest(F.lit(40), F.expr("cast(a.page_h div 4 as int)"))
    far = (F.abs(F.col("a.H_b") - F.col("b.H_b")) >= gap) & (F.abs(F.col("a.H_h") - F.col("b.H_h")) >= gap)
    on = (F.col("a.filename") == F.col("b.filename")) & (F.col("a.len_text") == F.col("b.len_text")) & far & ~F.array_contains("a.positives", F.col("b.box_id"))
    q = F.col("b.ratio") / F.col("a.ratio")
    tier = F.when(q.between(0.9, 1.1), 1).when(q.between(0.8, 1.25), 2).otherwise(3)
    diff = F.round(F.abs(F.col("b.ratio") - F.col("a.ratio")), 6)
    pairs = a.join(b, on).select("a.filename", "a.anchor", F.col("b.box_id").alias("negative"), tier.alias("tier"), diff.alias("diff"))
    w = Window.partitionBy("filename", "anchor").orderBy("tier", "diff", "negative")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def quotas(sizes: DataFrame, group: list[str], bin: str, n: str, total: int) -> DataFrame:
    """Even quotas of bins: each gets its share of what is left in order of size, so small bins give what they lack to larger ones."""
    w = Window.partitionBy(*group)
    s = sizes.withColumn("k", F.row_number().over(w.orderBy(n, bin))).withColumn("bins", F.count(F.lit(1)).over(w))
    packed = s.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("k", F.col(bin).alias("bin"), F.col(n).cast("int").alias("n")))).alias("b"))
    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(x["n"], F.floor(a["left"] / (F.size("b") - x["k"] + 1)).cast("int"))
        return F.struct((a["left"] - take).alias("left"), F.concat(a["out"], F.array(take)).alias("out"))

    z = packed.select(*group, F.arrays_zip(F.col("b.bin").alias("bin"), F.aggregate("b", start, step)["out"].alias("quota")).alias("z"))
    return z.select(*group, F.inline("z")).toDF(*group, bin, "quota")


def stratified(df: DataFrame, group: list[str], bin: str, key: str, total: int) -> DataFrame:
    """Of each group about total rows, spread evenly over bins, by hash."""
    q = quotas(df.groupBy(*group, bin).count(), group, bin, "count", total)
    w = Window.partitionBy(*group, bin).orderBy(uniform(F.concat_ws(":", *(F.col(g).cast("string") for g in group), F.col(key).cast("string")), "bin"), key)
    return df.withColumn("place", F.row_number().over(w)).join(q, [*group, bin]).where("place <= quota")


def ill_defined(df: DataFrame, most: int = 4) -> DataFrame:
    """Each box with its four sides moved out or in by up to most pixels, all alike with probability a half; gt 1 if any side moved in."""
    key = F.concat_ws(":", "filename", F.col("box_id").cast("string"))
    one = uniform(key, "alike") < 0.5
    move = {}
    for c in ("W_d", "W_g", "H_b", "H_h"):
        u = F.when(one, uniform(key, "move-all")).otherwise(uniform(key, f"move-{c}"))
        move[c] = F.floor(u * (2 * most + 1)).cast("int") - most
    out = df.withColumn("cut", F.least(*move.values()) < 0)
    return out.withColumns({c: F.col(c) + (-m if c in ("W_d", "H_b") else m) for c, m in move.items()}).withColumn("gt", F.col("cut").cast("int")).drop("cut")
