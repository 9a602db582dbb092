"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its possible hits; fixed rules first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, read

#: Rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Sites of the query's list, under each of the domains kept for examples: the names are those of the test tables' unwanted sites.
SITES, DOMAINS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track"), ("example.com", "example.net", "example.org")
LISTED = tuple(f"{site}.{domain}/" for site in SITES for domain in DOMAINS)
BITS_PER_KEY, BLOCK_BITS, PROBES = 16, 512, 8
#: Keys whose filter (2 bytes each) and whose exact table are broadcast; a longer list is joined by shuffling.
BROADCAST_KEYS = 1_000_000


def host_and_path(url: str) -> tuple[Column, Column]:
    """Of the url in that column; both empty for a null url or one without ://; only A-Z are lower-cased in the host."""
    at = F.locate("://", F.col(url))
    after = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Rule and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def plain_host(host: Column) -> Column:
    """The host without user, port and last dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def canonical(url: str) -> Column:
    """Of a listed URL, with or without a scheme: host/ for a whole host, else host/path without a last slash; query and fragment don't count; null without a host."""
    u = F.regexp_replace(F.regexp_replace(F.col(url), r"^[^/?#]*://", ""), r"[?#].*$", "")
    host = plain_host(F.translate(F.regexp_extract(u, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.when(host != "", F.concat(host, F.lit("/"), F.regexp_extract(u, r"^[^/]*/*(.*?)/*$", 1)))


def lookups(host: Column, path: Column) -> Column:
    """Canonical URLs under which a list can name this one: the host and its parent domains as a whole; the path and what it lies under."""
    host = plain_host(host)
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    parts = F.split(F.regexp_extract(path, r"^/*(.*?)/*$", 1), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(hosts, paths)))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A row for each block in use: its number and its BLOCK_BITS bits as longs."""
    at = keys.select(*_probes(F.col(key), blocks))
    words = at.select("block", F.explode("bits").alias("bit"))
    words = words.groupBy("block", F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    return words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _probes(key: Column, blocks: int) -> tuple[Column, Column]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
    bits = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda i: F.pmod(F.xxhash64(key, i), F.lit(BLOCK_BITS))).alias("bits")
    return block, bits


def judge_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", rules=RULES, prefix: str = "u_", keep: list[str] | None = None
) -> DataFrame:
    """pages (or its columns keep) with host, path, rule, verdict and listed (the listed URL that fits, the longest, else null).

    A rule's verdict stands; else a page is blocked if a listed canonical URL fits it, and allowed otherwise. Both sides are made
    canonical: hosts in lower case without user, port and last dot, paths without last slashes, no query or fragment; escapes stay as they are.
    A listed host (alone or with a slash) fits itself and all subdomains; a listed path fits its host's pages at it and below it. Every URL is
    looked up under its path's beginnings and its host's parent domains: a blocked Bloom filter lets possible hits pass, an exact join
    on the listed URLs removes the false ones. Null urls and ones without :// have an empty host and are allowed; empty, null
    and repeated listed URLs add nothing; repeated pages are judged each; empty tables are fine; a column called like a
    new one is an error. A very long URL makes as many lookups as it has labels and path segments.
    """
    carried = pages.columns if keep is None else keep
    if clash := [c for c in carried if c.lower().startswith(prefix.lower())]:
        raise ValueError(f"columns {clash} are there already: choose another prefix")
    keys = durable(listed.select(canonical(listed_url).alias("key")).where("key IS NOT NULL").distinct())
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_KEYS else (lambda df: df)
    p = pages.select(*carried, *(x.alias(f"{prefix}{y}") for x, y in zip(host_and_path(url), ("host", "path"))))
    host, path = f"{prefix}host", f"{prefix}path"
    p = p.withColumn(f"{prefix}r", rule_of(F.col(host), F.col(path), rules))
    # each host and path, and each lookup of them, once, whatever number of pages has it
    places = p.where(F.col(f"{prefix}r").isNull()).select(host, path).distinct().withColumn("key", F.explode(lookups(F.col(host), F.col(path))))
    probed = places.select("key").distinct().select("key", *_probes(F.col("key"), blocks))
    passed = probed.join(small(bloom(keys, "key", blocks)), "block").where(
        "forall(bits, b -> coalesce(shiftright(words[b div 64], cast(b % 64 as int)) & 1L, 0L) = 1L)"
    )
    hits = durable(passed.select("key").join(small(keys), "key", "left_semi"))
    if hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hits = F.broadcast(hits)
    fits = places.join(hits, "key").groupBy(host, path).agg(F.max_by("key", F.struct(F.length("key"), "key")).alias(f"{prefix}listed"))
    r = F.col(f"{prefix}r")
    return p.join(fits, [host, path], "left").select(
        *carried, host, path, r["rule"].alias(f"{prefix}rule"),
        F.coalesce(r["verdict"], F.when(F.col(f"{prefix}listed").isNotNull(), "block").otherwise("allow")).alias(f"{prefix}verdict"),
        F.when(r.isNull(), F.col(f"{prefix}listed")).alias(f"{prefix}listed"),
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("url"))
    d = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), listed, keep=["page_id"])
    return d.select("page_id", *(F.col(f"u_{x}").alias(x) for x in ("host", "path", "rule", "verdict")))


ORACLE = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS a FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(a, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(h, p, v) AS (VALUES {', '.join(str(r) for r in RULES)}),
l(h) AS (VALUES {', '.join(f"('{x[:-1]}')" for x in LISTED)}),
q AS (SELECT page_id, host, path,
        (SELECT max_by(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
        (SELECT max_by(v, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS v FROM p)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM l WHERE plain = h OR ends_with(plain, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS plain FROM q)
"""
