"""Shards, groups of boxes of one shape, chunks of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable

SHAPE = ["len_text", "Width", "Height"]


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """at: each row's place from 0 among those of its keys in order; n_rows: how many there are; of each column c of sums c_to, its sum up to the row, and c_all.

    Rows are sorted by range partitioning, which splits hot keys; a place is the rank in the partition plus the rows of the key in
    partitions before it. The sorted rows are checkpointed, as ranks and counts must come from one and the same division.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", *keys).orderBy(*order)
    run = here.rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"rank": F.row_number().over(here), **{f"{c}_own": F.sum(c).over(run) for c in sums}})
    sizes = placed.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("n_part"), *(F.sum(c).alias(f"{c}_part") for c in sums))
    # a row for each partition and key
    w = Window.partitionBy(*keys)
    before = lambda c: F.coalesce(F.sum(c).over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = [x for c in sums for x in (before(f"{c}_part").alias(f"{c}_before"), F.sum(f"{c}_part").over(w).alias(f"{c}_all"))]
    sizes = sizes.select("part", *keys, before("n_part").alias("before"), F.sum("n_part").over(w).alias("n_rows"), *totals)
    same = F.col("x.part") == F.col("y.part")
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    joined = own.alias("x").join(sizes.alias("y"), same)
    summed = [x for c in sums for x in ((F.col(f"y.{c}_before") + F.col(f"x.{c}_own")).alias(f"{c}_to"), F.col(f"y.{c}_all"))]
    return joined.select(*(F.col(f"x.{c}") for c in df.columns), (F.col("y.before") + F.col("x.rank") - 1).alias("at"), F.col("y.n_rows").alias("n_rows"), *summed)


def array_split(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """shard from 0: rows in order in parts of sizes that differ by one at most, the larger ones first."""
    small, larger = F.floor(F.col("n_rows") / shards), F.col("n_rows") % shards
    edge = larger * (small + 1)
    shard = F.when(F.col("at") < edge, F.floor(F.col("at") / (small + 1))).otherwise(larger + F.floor((F.col("at") - edge) / F.greatest(small, F.lit(1))))
    return ranked(df, [], order).withColumn("shard", shard.cast("int")).drop("n_rows")


def valid_groups(df: DataFrame, keys: list[str] = SHAPE, least: int = 4) -> DataFrame:
    """Groups of at least least rows from two files and with two texts."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("filename").alias("n_files"), F.count_distinct("text").alias("n_texts"))
    return g.where((F.col("n") >= least) & (F.col("n_files") >= 2) & (F.col("n_texts") >= 2))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of a column without nulls; quartiles between two places in proportion.

    The values are sorted by range, so no task holds them all.
    """
    r = ranked(df.select(column), [], [column])

    def quartile(q: float) -> Column:
        place = (F.col("n_rows") - 1) * F.lit(q)
        low, high = F.max(F.when(F.col("at") == F.floor(place), F.col(column).cast("double"))), F.max(F.when(F.col("at") == F.ceil(place), F.col(column).cast("double")))
        part = F.max(place - F.floor(place))
        return (low + (high - low) * part).alias(f"p{int(q * 100)}")

    return r.agg(
        F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).alias("min"), *map(quartile, (0.25, 0.5, 0.75)), F.max(column).alias("max")
    )


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int = 2000) -> DataFrame:
    """chunk from 0 of each group's rows in order; the last two chunks of a group are one."""
    last = F.greatest(F.ceil(F.col("n_rows") / size) - 2, F.lit(0))
    return ranked(df, keys, order).withColumn("chunk", F.least(F.floor(F.col("at") / size), last).cast("int")).drop("at", "n_rows")


def chunk_ends(counted: DataFrame, keys: list[str], item: str, size: int = 2000) -> DataFrame:
    """Of each chunk that chunks makes of rows in order of item: n, its first and last item. counted: n rows of each of keys and item, nulls last.

    A row of counted stands for n neighbours, so its places are those from the sum before it to its own.
    """
    r = ranked(counted.withColumnRenamed("n", "held"), keys, [F.col(item).asc_nulls_last()], ("held",))
    last = F.greatest(F.ceil(F.col("held_all") / size) - 2, F.lit(0))
    at = lambda place: F.least(F.floor(place / size), last)
    r = r.withColumn("start", F.col("held_to") - F.col("held")).withColumn("last", last)
    r = r.select(*keys, item, "start", "held_to", "last", F.explode(F.sequence(at(F.col("start")), at(F.col("held_to") - 1))).alias("chunk"))
    end = F.when(F.col("chunk") < F.col("last"), F.least("held_to", (F.col("chunk") + 1) * size)).otherwise(F.col("held_to"))
    r = r.withColumn("n", end - F.greatest("start", F.col("chunk") * size))
    return r.groupBy(*keys, F.col("chunk").cast("int").alias("chunk")).agg(F.sum("n").alias("n"), F.min(item).alias("first"), F.max(item).alias("last"))
