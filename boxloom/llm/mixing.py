"""Mixing sources to target weights: each document's copies are an inverted, hash-seeded Poisson count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucket_count, durable, read

#: Without explicit weights a source weighs its documents to this power.
SMOOTHING = 0.7
#: Sources in a broadcast rate table; beyond it the join shuffles, and AQE splits hot sources.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """52 bits of an md5 of the parts, as a number in [0, 1)."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution up to where it is 1 in double precision; in logarithms, for any rate."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    # in blocks of about the root of their number, so that an array grows by few copies of itself
    block = F.ceil(F.sqrt(most)).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(a["cdf"], F.array(total)).alias("cdf"))

    def steps(a: Column, first: Column) -> Column:
        empty = F.struct(a["log"].alias("log"), a["sum"].alias("sum"), F.array().cast("array<double>").alias("cdf"))
        one = F.aggregate(F.sequence(first, F.least(first + block - 1, most)), empty, step)
        return F.struct(one["log"].alias("log"), one["sum"].alias("sum"), F.concat(a["cdf"], one["cdf"]).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most, block), start, steps, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, total: float | None) -> tuple[DataFrame, float]:
    """source, n, rate: mean copies of its documents, so that sources come out by weight and total documents in all (default: as many); and copies a document."""
    by = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(SMOOTHING))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("mix_source")] if pairs else F.lit(0.0), F.lit(0.0))
    by = durable(by.withColumn("w", weight))
    sums = by.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    scale = (sums["n"] if total is None else total) / sums["w"] if sums["w"] else 0.0
    return by.select("mix_source", "n", (F.col("w") / F.col("n") * F.lit(float(scale))).alias("rate")), 1.0 if total is None or not sums["n"] else total / sums["n"]


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, total: float | None = None,
    seed: str = "mix", copy: str = "copy", order: str = "shuffle_key",
) -> DataFrame:
    """docs, each row as often as its Poisson count says, in a global random order; with the copy's number from 1 and its shuffle key.

    The count inverts the Poisson distribution of the source's rate at a hash of seed and key, so it is the same in every run and
    on any cluster. Sources without a weight have rate 0. A null source is one of its own (its weight comes from its count; explicit
    weights have none for it); a null key is hashed as such; rows with equal keys get equal counts; an empty table gives an empty
    one; columns called like copy or order are an error. Texts, however long, aren't looked at.

    A count is looked up in its source's steps one by one, which takes no longer than making the copies does.

    Rows are dealt out by hash of the shuffle key and sorted by it in each partition: one exchange, no sampling pass.
    """
    if clash := {copy.lower(), order.lower(), "mix_source", "mix_cdf"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already: choose other names")
    table, copies_each = rates(docs, source, weights, total)
    table = table.select("mix_source", poisson_steps(F.col("rate")).alias("mix_cdf"))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    u = uniform(seed, k)
    rated = docs.join(table, F.col(source).eqNullSafe(F.col("mix_source")))
    n = F.size(F.filter("mix_cdf", lambda c: c <= u))
    copies = rated.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).drop("mix_source", "mix_cdf")
    keyed = copies.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), k, F.col(copy).cast("string")).cast("binary")))
    return keyed.repartition(bucket_count(docs, 2.0 * max(1.0, copies_each)), order).sortWithinPartitions(order)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE = """
WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / n * ((SELECT sum(n) FROM s) / (SELECT sum(w) FROM s)) AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, md5('mix/order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
