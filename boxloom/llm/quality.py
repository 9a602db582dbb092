"""Quality rules: per-document rules, failure rates of hosts shrunk towards an empirical beta prior, host verdicts joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, read

WORD_GAP = r"[\x20\x09-\x0D]+"
#: A rejected host has at least this shrunk rate of failing documents.
MAX_RATE = 0.5
#: Hosts in a broadcast verdict table; beyond it the join shuffles, and AQE splits hot hosts.
BROADCAST_HOSTS = 100_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def repeat_words(w: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows sorted with their places, equal neighbours, covered places.

    Windows are sorted by a hash, since longs compare fast; in a text where neighbours of equal hash aren't equal words, by their words.
    """
    three = lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"))
    grams = lambda g: F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(g(i).alias("g"), i.alias("i")))
    hashed, exact = grams(lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])), grams(three)

    def again(s: Column) -> Column:
        """Windows with an equal neighbour, still in order."""
        return F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))

    def covered(s: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        places = F.sort_array(F.transform(s, lambda x: x["i"]))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def clash(s: Column) -> Column:
        differ = lambda x, y: F.when(x["g"] == y["g"], three(x["i"]) != three(y["i"])).otherwise(False)
        return F.exists(F.transform(s, lambda x, k: (k > 0) & differ(F.get(s, k - 1), x)), lambda x: F.coalesce(x, F.lit(False)))

    found = lambda g: let(F.sort_array(g), again)
    return F.when(n < 3, F.lit(0)).otherwise(let(found(hashed), lambda s: F.when(clash(s), covered(found(exact))).otherwise(covered(s))))


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, text: str = "text", prefix: str = "q_", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with the base counts and base_failed of each row's whole text."""
    t = F.col(text)
    carried = docs.columns if keep is None else keep
    w = docs.select(*carried, words(t).alias(f"{prefix}w"), *([] if text in carried else [text]))
    n = F.size(f"{prefix}w")
    made = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(F.coalesce(t, F.lit("")), WORD_GAP, "")),
        "n_symbols": F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"[^#*$%&|<>]+", "")),
        "n_dup_lines": dup_lines(t),
        "n_repeat_words": repeat_words(F.col(f"{prefix}w"), n),
    }
    # a generator: predicates are not pushed through it, which would split the text anew for each word
    out = w.select(*carried, F.inline(F.array(F.struct(*(made[x].cast("long").alias(f"{prefix}{x}") for x in COUNTS)))))
    c = lambda x: F.col(f"{prefix}{x}")
    return out.withColumn(f"{prefix}base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))


def failed_only(docs: DataFrame, text: str, prefix: str, carried: list[str]) -> DataFrame:
    """docs' columns carried with base_failed alone.

    Of windows beyond the first of each kind there are as many as windows in all less kinds; those that occur twice or more are at most twice, and
    the words in them at most six times as many. Only a text for which that isn't too few is looked at closely.
    """
    w = docs.select(*carried, words(F.col(text)).alias(f"{prefix}w"))
    n, a = F.size(f"{prefix}w"), F.col(f"{prefix}w")
    spare = let(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(a[i], a[i + 1], a[i + 2])), lambda h: F.size(h) - F.size(F.array_distinct(h)))
    failed = F.when(n < 50, True).when(12 * spare <= n, False).otherwise(100 * repeat_words(a, n) > 50 * n)
    return w.select(*carried, F.inline(F.array(F.struct(failed.alias(f"{prefix}base_failed")))))


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Host, n, failed (k) and the shrunk rate of each host, (k + a) / (n + a + b).

    The beta prior (a, b) is fitted to all hosts by moments of a beta-binomial: of the variance between hosts' rates the part that sampling
    n documents each explains is taken off first. With m the mean rate, r = 1 / (a + b + 1) is the rest's share of m (1 - m): 0 if hosts
    differ no more than by chance (then every rate is m), 1 if a host fails as a whole or not at all. A null host is a host of its own.
    """
    by = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("k"))
    by = durable(by)
    mean = by.agg((F.sum("k") / F.sum("n")).alias("m")).first()["m"] or 0.0
    off = F.col("k") / F.col("n") - F.lit(mean)
    x = by.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("n") * off * off).alias("between")).first()
    share = overdispersion(mean, x["hosts"], x["n"] or 0, x["squares"] or 0, x["between"] or 0.0)
    rate = (F.col("k") * F.lit(share) + F.lit(mean * (1 - share))) / (F.col("n") * F.lit(share) + F.lit(1 - share))
    return by.select("host", "n", "k", rate.alias("rate"))


def overdispersion(mean: float, hosts: int, n: int, squares: int, between: float) -> float:
    """The share r from the sum over hosts of n (rate - mean) ** 2, whose mean is mean (1 - mean) (hosts - 1 + r (n - squares / n - hosts + 1))."""
    if not 0 < mean < 1:
        return 0.0
    room = n - squares / n - (hosts - 1)
    return min(1.0, max(0.0, (between / (mean * (1 - mean)) - (hosts - 1)) / room)) if room > 0 else 0.0


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_RATE, prefix: str = "q_", keep: list[str] | None = None, counts: bool = True
) -> DataFrame:
    """docs (or its columns keep) with base counts (unless counts is false), base_failed, the host's verdict and kept.

    kept: the document doesn't fail the base rules and its host's shrunk rate is at most max_rate. Null and empty texts have no
    words and fail; a null host is a host of its own; repeated rows count each; an empty table gives an empty one. A column
    called like a new one is an error; a very long text is one row, so its counts are made in one task.

    The rates need every row's base_failed. Where texts aren't carried the counts are computed once and checkpointed; where they are,
    base_failed is computed twice instead of writing whole texts.
    """
    carried = docs.columns if keep is None else keep
    if clash := [c for c in carried if c.lower().startswith(prefix.lower())]:
        raise ValueError(f"columns {clash} are there already: choose another prefix")
    needed = list(dict.fromkeys([*carried, host]))
    judged = features(docs, text, prefix, needed) if counts else failed_only(docs, text, prefix, needed)
    if text in carried:
        seen = failed_only(docs, text, prefix, [host])
    else:
        judged = seen = durable(judged)
    bad = host_rates(seen, host, f"{prefix}base_failed").where(F.col("rate") > max_rate).select(F.col("host").alias(f"{prefix}host"))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    out = judged.join(bad.withColumn(f"{prefix}host_failed", F.lit(True)), F.col(host).eqNullSafe(F.col(f"{prefix}host")), "left")
    host_failed = F.coalesce(f"{prefix}host_failed", F.lit(False))
    return out.select(
        *carried,
        *(f"{prefix}{x}" for x in (*COUNTS, "base_failed") if counts or x == "base_failed"),
        host_failed.alias(f"{prefix}host_failed"),
        (~F.col(f"{prefix}base_failed") & ~host_failed).alias(f"{prefix}kept"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return d.select("doc_id", *(F.col(f"q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c
  FROM (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
x AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN x USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
y AS (SELECT source, base_failed::INT AS y, avg(base_failed::INT) OVER (PARTITION BY source) AS host_mean, count(*) OVER (PARTITION BY source) AS host_n FROM b),
v AS (
  SELECT avg(y) AS m, count(*)::DOUBLE AS n, var_pop(y) AS total, var_pop(host_mean) AS between_hosts, avg(host_n) AS usual_n,
         (SELECT count(*) FROM (SELECT DISTINCT source FROM y)) - 1 AS free FROM y),
q AS (SELECT m, CASE WHEN total = 0 OR n - usual_n - free <= 0 THEN 0 ELSE least(1, greatest(0, (n * between_hosts / total - free) / (n - usual_n - free))) END AS r FROM v),
z AS (SELECT source, (sum(y) * any_value(r) + any_value(m) * (1 - any_value(r))) / (count(*) * any_value(r) + 1 - any_value(r)) AS rate FROM y, q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""
